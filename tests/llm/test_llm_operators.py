"""The operators against brute force on small fixtures with nulls, empty and
very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
import struct
import textwrap
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from docweave.llm import bpe, decontaminate, licenses, near_dedup, pii, quality, queries, secrets, sharding, token_counts, token_files

SCHEMA = "doc_id long, text string, n long, digest string, row string, m string, rep long, comp long, unit string, shard string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def fixture_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Été", "straße", "日本", "x" * 300]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 30, 200)))) for _ in range(40)]
    near = []
    for t in base[:12]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[rng.randrange(len(v))] = rng.choice(words)
            near.append(" ".join(v))
    passage = " ".join(rng.choice(words) for _ in range(60))
    shared = [passage + " " + " ".join(rng.choice(words) for _ in range(40)) for _ in range(15)]
    odd = [None, None, "", "   ", "one", "one", "Two words", "two WORDS", "\x85\xa0", "a\tb\nc\rd\x0be\x0cf g h", " ".join(rng.choice(words) for _ in range(30000))]
    return base + near + shared + odd + base[:3] + [base[0]] * 20


@pytest.fixture(scope="session")
def docs(spark, fixture_texts):
    rows = [(i, t, 7, "d", "r", "m", 1, 2, "u", "s") for i, t in enumerate(fixture_texts)]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, width):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("width", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, fixture_texts, width, num):
    sets = [shingle_set(t, width) for t in fixture_texts]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    got = near_dedup.near_duplicates(docs, width=width, num=num).collect()
    assert len(got) == len(fixture_texts) + 1
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_near_duplicates_chain_and_null_ids(spark):
    # a chain: each text is close to the next only
    w = [f"t{i}" for i in range(200)]
    rows = [(10 - i, " ".join(w[3 * i : 3 * i + 120])) for i in range(8)] + [(None, " ".join(w[:120])), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=85).collect()
    assert {r.component_id for r in got if r.doc_id is not None} == {3}
    assert sorted((r.component_id or -1, r.kept) for r in got if r.doc_id is None) == [(-1, False), (3, False)]


def test_near_duplicates_large_group(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        v = list(base)
        for _ in range(rng.choice((0, 1, 2, 6))):
            v[rng.randrange(150)] = f"r{rng.random()}"
        rows.append((i, " ".join(v)))
    sets = {i: shingle_set(t, 3) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(sets, 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=85).collect()
    assert all(r.component_id == find(r.doc_id) for r in got)


def test_near_duplicates_at_the_threshold(spark):
    """Sets of over three sketches: pairs just above the threshold are links, just below not."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    rows = []
    for pair in range(120):
        common, k = [word() for _ in range(602)], 52 if pair % 2 else 53  # 600 / 704 and 600 / 706
        rows += [(2 * pair + side, " ".join(common + [word() for _ in range(k)])) for side in (0, 1)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=85).collect()}
    assert got == {i: i - 1 if i % 4 == 3 else i for i in range(240)}


def test_near_duplicates_empty(empty):
    assert near_dedup.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(got.select(order).collect()) == sorted(want.project(", ".join(order)).fetchall())


BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a <|endoftext|> b", "x  <|endoftext|>", "日本 'S it's\r\n  ok ", " x \t y", "\n\n a\n", "é é  z", "don't  WON'T", "\x85 \xa0x", "a" * 5000]


def test_encoder_equals_library(fixture_texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE)
    texts = [t for t in fixture_texts if t] + ODD
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert list(token_files.Encoder(BYTE).encode(texts)) == want


def test_levels_random_access():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 2**20, 5000), rng.integers(0, 256, 700), np.array([0]), np.array([2**32 - 1, 0, 255, 256, 65535, 65536])):
        levels = token_files.Levels(token_files.pack(ids.astype("<u4")))
        assert (levels.all() == ids).all() and all(levels[i] == ids[i] for i in range(len(ids)))


def test_token_output(spark, docs, fixture_texts, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE)
    order = sorted([*enumerate(fixture_texts), (5, fixture_texts[5])], key=lambda x: x[0])
    files = token_files.write(docs, f"file://{tmp_path}/out", tokenizer=BYTE, end_id=2)
    got = sorted(token_files.read_digests(spark, files).collect(), key=lambda r: r.start)
    at = 0
    every = []
    for r, (i, t) in zip(got, order):
        ids = [*(lib.encode(t, add_special_tokens=False).ids if t else []), 2]
        every += ids
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(order)
    path, before, n = files[-1]
    with token_files.open_file(path) as f:
        assert len(f) == n and [f.token(i) for i in range(0, n, max(1, n // 50))] == [every[before + i] for i in range(0, n, max(1, n // 50))]


def test_token_output_equal_ids(spark, tmp_path):
    """Rows without an id, and rows of one id, spread over files; a token is read
    from a few bytes."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE)
    rows = [(i, f"text {n} é " * (n % 9)) for i in (None, 7) for n in range(200)] + [(None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    files = token_files.write(docs, f"file://{tmp_path}/out", tokenizer=BYTE, end_id=2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 2 and max(n for _, _, n in files) < 0.6 * sum(n for _, _, n in files)
    got = token_files.read_digests(spark, files).collect()
    size = lambda t: (len(lib.encode(t, add_special_tokens=False).ids) if t else 0) + 1
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, size(t)) for i, t in rows)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    for path, _, n in files:
        with token_files.open_file(path) as f:
            ids = [i for _, _, part in f.documents() for i in part.tolist()]
            reads = []
            f.source = type("Counted", (), {"read_at": lambda self, size, at, real=f.source: (reads.append(size), real.read_at(size, at))[1]})()
            assert [f.token(i) for i in range(0, n, 37)] == ids[::37]
            assert sum(reads) < 200 * len(range(0, n, 37))


def test_token_output_empty(empty):
    assert token_files.token_output(empty, tokenizer=BYTE, end_id=2).collect() == []


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"][0]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper()),
        (2, "# " + mit.replace("\n", "\n# ")),
        (3, "words\nReleased under the MIT Licence!\nmore"),
        (4, mit + " and more"),
        (5, None),
        (6, ""),
        (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
    ]
    got = {(r.doc_id, r.license, r.unit, r.n_units) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, lic) for i, lic, _, _ in got} == {(1, "MIT"), (2, "MIT"), (3, "MIT notice"), (7, "CC-BY-NC-4.0 notice")}
    assert (7, "CC-BY-NC-4.0 notice", "line", 2) in got and (1, "MIT", "text", 1) in got


def test_licenses_published(spark):
    mit, isc, bsd2, bsd3, zlib_ = (licenses.KNOWN[k][0] for k in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib"))
    wrap = lambda t, w: "\n\n".join(textwrap.fill(p, w) for p in t.split("\n\n"))
    long = {k: v[0] for k, v in licenses.published().items() if k in licenses.LONG}
    apache = long["Apache-2.0"]
    owned = bsd3.replace("the copyright holder nor", "Acme, Inc. nor").replace("THE COPYRIGHT HOLDERS AND", "ACME AND").replace("THE COPYRIGHT HOLDER OR", "ACME OR")
    head = "Copyright (c) 2020, Some Body\n\n"
    rows = [
        ("MIT", "MIT License\n\n" + head + wrap(mit, 78)),
        ("MIT", "The MIT License (MIT)\r\n\r\nCopyright The Acme Authors\r\n\r\n" + wrap(mit, 70).replace("\n", "\r\n")),
        ("BSD-2-Clause", "BSD 2-Clause License\n\n" + head + "All rights reserved.\n\n" + wrap(bsd2, 79)),
        ("BSD-3-Clause", "BSD 3-Clause License\n\n" + head + wrap(bsd3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), 79)),
        ("BSD-3-Clause", head + wrap(owned, 76)),
        ("Zlib", "zlib License\n\n(C) 1995 Some Body\n\n" + wrap(zlib_, 70)),
        ("Apache-2.0", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Some Body")),
        ("Apache-2.0", apache[: apache.index("APPENDIX")]),
        ("Apache-2.0 notice", "".join(f"// {x}\n" for x in ("Copyright 2021 Some Body\n\n" + apache[apache.index("Licensed under") :]).strip().split("\n"))),
        *(("ISC", "ISC License\n\n" + head + wrap(isc, w)) for w in range(40, 100)),
        *long.items(),
    ]
    # a line may begin with the word at each of its places
    for name, text in {"MIT": mit, "ISC": isc, "BSD-2-Clause": bsd2, "BSD-3-Clause": bsd3, **long}.items():
        rows += [(name, text[: m.start()] + "\n" + text[m.start() + 1 :]) for m in re.finditer(r"(?i)(?<! {2})(?<!name of) (?=copyright)(?!copyright \(C\))", text)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect() if r.unit in ("text", "paragraph")}
    assert got == {(i, name) for i, (name, _) in enumerate(rows)}
    kept = licenses.scan(docs.limit(1).selectExpr("doc_id", "replace(text, 'without restriction', 'with restriction') AS text")).count()
    assert kept == 0


def test_licenses_odd_rows(spark, docs, empty):
    """Null ids, repeated rows, long texts and clashing columns; a catalogue of
    more anchors than are looked for one by one finds the same."""
    isc = licenses.KNOWN["ISC"][0]
    long = "word " * 20000 + "\nReleased under the MIT Licence!\n" + "word " * 20000
    rows = [(i, t, 7, "d", "r", "m", 1, 2, "u", "s") for i, t in ((None, isc), (None, isc), (1, long), (2, isc), (2, isc), (3, "no licence"))]
    texts = docs.union(spark.createDataFrame(rows, SCHEMA))
    got = {(r.doc_id, r.license, r.unit, r.n_units) for r in licenses.scan(texts).collect()}
    assert got == {(None, "ISC", "text", 2), (1, "MIT notice", "line", 1), (2, "ISC", "text", 2)}
    many = {f"L{i}": [f"this text of {chr(97 + i % 26) * 5}{chr(97 + i // 26) * 9} is a licence"] for i in range(150)} | {"ISC": licenses.KNOWN["ISC"]}
    wide = licenses.scan(texts, known=licenses.known_licenses(spark, many)).collect()
    assert {(r.doc_id, r.license, r.unit, r.n_units) for r in wide} == {g for g in got if g[1] == "ISC"}
    assert licenses.scan(empty).collect() == []


def base_metrics(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows, hit = {}, set()
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            for i in places:
                hit.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, fixture_texts):
    extra = ["The the " * 40, "a b c d e f g h " * 2 + "x", "same line here\n" * 4, " ".join(f"word{i}###" for i in range(40)), " ".join(f"WORD{i}!!" for i in range(40)), "|" * 50]
    more = spark.createDataFrame([(1000 + i, t, 7, "d", "r", "m", 1, 2, "u", "s") for i, t in enumerate(extra)], SCHEMA)
    texts = dict(enumerate(fixture_texts)) | {1000 + i: t for i, t in enumerate(extra)}
    got = quality.quality(docs.union(more)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = base_metrics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and (not failed or not r.kept)
        text = texts[r.doc_id] or ""
        bad = want[2] * 10 > want[0] or want[3] * 10 > (text.count("\n") + 1) * 3 or want[1] > want[0] * 20 or want[1] < want[0] * 2
        bad = bad or len(regex.findall(r"\p{Lu}{2,}", text)) * 10 > want[0] * 3
        assert r.kept == (not failed and not bad), r
    assert {r.doc_id: r.kept for r in got}[1003] is False and {r.doc_id: r.kept for r in got}[1004] is False
    good = quality.keep_good(docs.union(more))
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_quality_order_never_changes_verdicts(docs, empty):
    rules = quality.default_rules()
    a = {(r.doc_id, r.kept) for r in quality.quality(docs, rules=rules).collect()}
    b = {(r.doc_id, r.kept) for r in quality.quality(docs, rules=rules[::-1], sample_rows=1).collect()}
    assert a == b
    assert quality.quality(empty).collect() == [] and quality.keep_good(empty).collect() == []


def test_quality_order():
    """Rejection per cost, and what an earlier rule takes no longer counts."""
    a, b, c = (quality.Rule(n, None) for n in "abc")
    verdicts = {(True, True, False): 60, (False, True, True): 5, (False, False, True): 20, (False, False, False): 100}
    assert [r.name for r in quality.by_gain([a, b, c], [1.0, 1.0, 1.0], verdicts)] == ["b", "c", "a"]
    assert [r.name for r in quality.by_gain([a, b, c], [1.0, 9.0, 0.1], verdicts)] == ["c", "a", "b"]


WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_library(fixture_texts):
    rng = random.Random(2)
    texts = [t for t in fixture_texts if t] + ODD + ["<|startoftext|>Ab <|endoftext|>İ'S", "ΑΣ ΣΑΣ ẞ ŉ ª ²³¼ \x7f"]
    texts += ["".join(rng.choice("aab") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts += ["".join(rng.choice("abcdeinstr'0 .-ée") for _ in range(300)) for _ in range(100)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(32, 0x3000)))) for _ in range(60)) for _ in range(100)]
    tok = bpe.Tokenizer(WORDS, cache_bytes=(20_000, 20_000))
    lib = tok._library
    got = [x for i in range(0, len(texts), 40) for x in tok.encode(texts[i : i + 40])]
    for t, (ids, decoded) in zip(texts, got):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == lib.decode(want, skip_special_tokens=False)
        assert bpe.decode(want, WORDS) == decoded


@pytest.mark.parametrize("word", ["r", "a", "ab", "the"])
def test_bpe_long_words(word):
    """Words of very many letters, merged in n log n steps."""
    rng = random.Random(7)
    for n in (98, 101, 5000, 200_000):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) if word == "r" else word * (n // len(word))
        tok = bpe._tokenizer(WORDS)
        ids, decoded = next(tok.encode([text]))
        want = tok._library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == tok._library.decode(want, skip_special_tokens=False)


def test_compatible_is_pairwise_truth():
    import json

    m = bpe.Merger(json.load(open(WORDS, encoding="utf-8")))
    rng = np.random.default_rng(3)
    inner, final = list(m._inner.values()), list(m._final.values())
    a, b = rng.choice(inner, 3000), rng.choice(final, 3000)
    want = [m._merge(m.tokens[x] + m.tokens[y].removesuffix(m.suffix)) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert m.compatible(a.astype(np.int64), b.astype(np.int64)).tolist() == want


def test_bpe_query_form(docs, fixture_texts, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    for r in bpe.encode(docs, tokenizer=WORDS).collect():
        ids = lib.encode(fixture_texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode(empty, tokenizer=WORDS).collect() == []


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def unigram_library(score=None):
    """The library over the same vocabulary, its model type switched to unigram;
    ``score`` gives pieces other scores."""
    import sentencepiece

    data = open(PIECES, "rb").read()
    out = bytearray()
    for number, kind, value in token_counts.fields(data):
        if number == 2:
            value = b"".join(_field(n, k, 1 if n == 3 else v) for n, k, v in token_counts.fields(value))
        elif number == 1 and score:
            held = {n: v for n, _, v in token_counts.fields(value)}
            value = b"".join(_field(n, k, v) for n, k, v in token_counts.fields(value) if n != 2)
            value += bytes([2 << 3 | 5]) + struct.pack("<f", score(held[1].decode(), struct.unpack("<f", held[2])[0]))
        out += _field(number, kind, value)
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(out))


def _varint(x):
    out = bytearray()
    x &= (1 << 64) - 1
    while True:
        out.append(x & 127 | (128 if x > 127 else 0))
        x >>= 7
        if not x:
            return bytes(out)


def _field(n, kind, value):
    head = _varint(n << 3 | kind)
    return head + (_varint(value) if kind == 0 else _varint(len(value)) + value if kind == 2 else value)


def test_token_counts_equal_library(spark, sf_dir, fixture_texts):
    """Whole texts, real ones and odd ones, with a cache that overflows."""
    lib = unigram_library()
    counter = token_counts.Counter(PIECES, cache_words=300)
    rng = random.Random(4)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + fixture_texts
    texts += ["Übergrößenträger", "日本語", "don't", "e=mc²", "🙂🙂", "▁x", "two words", "  lead and  double ", "a", " ", "   ", "\n\n a\n", "être 15 the 日 the", "x" * 5000 + " the the", "the" * 3000]
    texts += ["".join(rng.choice("abthe  日ñ.x") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    for t in texts:
        assert counter.count(t) == (len(lib.encode(t)) if t else 0), repr(t)[:200]


@pytest.mark.parametrize("draw", [lambda r: -r.random() * 20, lambda r: -r.choice([1, 2, 3, 0.1, 0.3, 7.7]), lambda r: -r.random() * 3e7, lambda r: -r.choice([1e4, 3e4, 1e9])])
def test_token_counts_other_scores(draw, tmp_path, fixture_texts):
    """Ties and sums of fractions come out as in the library's 32 bits."""
    rng = random.Random(6)
    lib = unigram_library(lambda piece, score: draw(rng))
    (tmp_path / "m.model").write_bytes(lib.serialized_model_proto())
    counter = token_counts.Counter(str(tmp_path / "m.model"))
    for t in [t for t in fixture_texts if t][:60]:
        assert counter.count(t) == len(lib.encode(t))


@pytest.mark.parametrize(("score", "n"), [(50000, 4), (50001, 5)])
def test_token_counts_reset(tmp_path, score, n):
    scores = {"z": -50000.0, "x": -float(score), "zx": -1e8, "xz": -1e8, "▁q": -5.0, "▁qz": -1e8, "▁the": -40.0}
    lib = unigram_library(lambda piece, old: scores.get(piece, old))
    (tmp_path / "m.model").write_bytes(lib.serialized_model_proto())
    assert token_counts.Counter(str(tmp_path / "m.model")).count("qzx the") == len(lib.encode("qzx the")) == n


def test_token_counts_null_and_empty(spark, empty):
    got = token_counts.token_counts(spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string"), vocabulary=PIECES).collect()
    assert [(r.doc_id, r.n_chars, r.n_tokens) for r in got] == [(1, 0, 0), (2, 0, 0), (None, 3, 2)]
    assert token_counts.token_counts(empty, vocabulary=PIECES).collect() == []


def test_token_counts_rows(spark, docs, fixture_texts):
    """Repeated rows and clashing columns: a row for each, with its own count."""
    lib = unigram_library()
    got = sorted((r.doc_id, r.n_chars, r.n_tokens) for r in token_counts.token_counts(docs, vocabulary=PIECES).collect())
    want = [(i, len(t or ""), len(lib.encode(t)) if t else 0) for i, t in enumerate(fixture_texts)]
    assert got == sorted([*want, want[5]])


def test_secrets_base_spans_and_heldout():
    net = secrets.trained()
    cases = secrets.findings(1500, 77)
    codes, labels = secrets._codes([c[:3] for c in cases]), np.array([c[3] for c in cases])
    found = net.probability(codes) >= net.threshold
    assert found[labels == 1].mean() > 0.93 and found[labels == 0].mean() < 0.02
    assert abs(net.probability(codes).mean() - labels.mean()) < 0.05  # calibrated
    key = "AKIA" + "Q2" * 8
    texts = [None, "", "password = short1", 'API_KEY: "abcdefgh12"', f"x {key} y", "h " + "0a" * 16, "h " + "0a" * 15, f"tokén secret={'f' * 40}", "Token=abcdefgh token=12345678"]
    got = [[(secrets.KINDS[s.kind], s.start, s.end) for s in spans if s.kind < 3] for spans in secrets.scan(texts, net)]
    assert got == [
        [], [], [], [("assign", 0, 20)], [("access", 2, 22)], [("hex", 2, 34)], [],
        [("assign", 6, 53), ("hex", 13, 53)], [("assign", 0, 14), ("assign", 15, 29)],
    ]


def test_secrets_behind_long_paths():
    net = secrets.trained()
    cases = secrets.buried(1500, 78)
    found, labels = net.sure([c[:3] for c in cases]), np.array([c[3] for c in cases])
    assert found[labels == 1].mean() > 0.93 and found[labels == 0].mean() < 0.03
    hook = "//hooks.slack.com/services/T00000000/B00000000/"
    for key in ("uXk29dLqPz7RmVb4TnYw8sHc", "Zp3kQ9vT1xWm7LrB5nYc8JdF", "a8F3kLm2Qx9ZrT7vBn4Wc6Ys"):
        text = f"see https:{hook}{key} now"
        assert [(s.kind, s.start, s.end) for s in secrets.scan([text], net)[0]] == [(3, 10, 10 + len(hook) + 24)]
        beside = f"x AKIA{'Q2' * 8}/{key} y {'0a' * 16}.{key} z"
        assert [s.kind for s in secrets.scan([beside], net)[0]] == [1, 3, 2, 3]
    plain = "see https://docs.example.com/guides/getting-started/installation/2021/03/14/release-notes-for-version-12.html now"
    assert secrets.scan([plain], net) == [[]]


def test_find_secrets(spark, docs, fixture_texts, empty):
    """The base part of the query's own form, against the patterns as they stand."""
    key = "AKIA" + "Q2" * 8
    more = ["password = short1", f"x {key}{key} y", 'api-key: "abcdefgh12" API_KEY=abcdefgh token=ABCDEFGHIJ', "h " + "0a" * 16 + "g" + "0a" * 40, f"é日 tokén secret={'f' * 40}\nPasswd : {key}", "token=a token=abcdefgh", "AKIA" * 4 + " " + "aKIA" * 9, ("word " * 5000) + "secret=" + "x1" * 3000]
    texts = fixture_texts + more
    rows = spark.createDataFrame([(1000 + i, t, 7, "d", "r", "m", 1, 2, "u", "s") for i, t in enumerate(more)], SCHEMA)
    patterns = [r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "(AKIA[A-Z0-9]+)", "([0-9a-f]+)"]
    want = {}
    for i, t in [*enumerate(fixture_texts), *((1000 + i, t) for i, t in enumerate(more))]:
        spans = sorted((m.start(), k, m.end()) for k, (p, least) in enumerate(zip(patterns, (8, 16, 32))) for m in re.finditer(p, t or "") if len(m[1]) >= least)
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want[i] = (*(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(said.encode()).hexdigest())
    got = secrets.find_secrets(docs.union(rows)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want[r.doc_id], r.doc_id
        base = ",".join(s for s in r.spans.split(",") if s and not s.startswith("cnn"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
    assert sum(map(sum, (v[:3] for v in want.values()))) > 8
    assert secrets.find_secrets(empty).collect() == [] and secrets.redact(empty).collect() == []
    assert secrets.redact(docs).columns == docs.columns


def test_secrets_redaction(spark):
    rows = [(1, f"a token={'f' * 40} b", "z"), (2, None, None), (3, "clean text", "z")]
    got = [tuple(r) for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()]
    assert got == [(1, "a [SECRET] b", "z"), (2, None, None), (3, "clean text", "z")]


def test_pii_round_trip(spark):
    text = "a.b@x.com 4111 1111 1111 1111, 4845168114407329 +1 (555) 555-5657 132.201.103.247. 2024-02-29 1999-02-31 123-45-6789 v1.2.3"
    rows = [(1, text), (2, text.replace("a.b", "c.d")), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.pseudonymise(df, key="k").orderBy("doc_id").collect()
    assert out[0].n_found == 8 and out[2].text is None and out[3].text == ""
    for value in ("4111 1111", "555-5657", "132.201", "2024-02-29", "123-45-6789", "a.b@x.com"):
        assert value not in out[0].text
    assert "1999-02-31" in out[0].text and "v1.2.3" in out[0].text and len(out[0].text.split()) == len(text.split())
    assert out[0].text.split()[1:] == out[1].text.split()[1:]  # equal values stay linked
    assert pii.pseudonymise(df, key="other").orderBy("doc_id").first().text != out[0].text
    kinds = tuple(k for k in pii.KINDS if k != "email")
    there = pii.pseudonymise(df, key="k", kinds=kinds)
    back = pii.pseudonymise(there.select("doc_id", "text"), key="k", kinds=kinds[::-1], undo=True).orderBy("doc_id").collect()
    assert back[0].text == text


def test_pii_shapes(spark):
    shapes = {
        "card": "3782 822463 10005|378282246310005|3782-822463-10005|30569309025904|4222222222222|6304000000000000000|4111-1111-1111-1111",
        "phone": "(555) 123-4567|555-123-4567|555.123.4567|555 123 4567|+44 20 7946 0958|+44 7700 900123|+33 1 23 45 67 89|+34 612 345 678|+49 30 12345678|+4915112345678|020 7946 0958|01 23 45 67 89|+1 (555) 555-5657",
        "date": "03/14/2021|14/03/2021|3/4/2021|03/04/2021|14.03.2021|4.3.2021|14-03-2021|2021/03/14|2021-03-14|March 14, 2021|Mar 3, 2021|14 March 2021|14th March 2021|MAY 1st, 2020|14. März 2021|14 mars 2021|14 de marzo de 2021|Sep. 9, 1999",
    }
    rows = [(k, v) for k, vs in shapes.items() for v in vs.split("|")]
    df = spark.createDataFrame([(i, f"a {v}, or ({v}) 7 b.") for i, (_, v) in enumerate(rows)], "doc_id long, text string")
    out = pii.pseudonymise(df, key="k").orderBy("doc_id").collect()
    for (kind, v), r in zip(rows, out):
        assert r.n_found == r[f"n_{kind}"] == 2 and v not in r.text, (v, r)
    kinds = pii.KINDS
    there = spark.createDataFrame([(r.doc_id, r.text) for r in out], "doc_id long, text string")
    back = pii.pseudonymise(there, key="k", kinds=kinds[::-1], undo=True).orderBy("doc_id").collect()
    assert [r.text for r in back] == [f"a {v}, or ({v}) 7 b." for _, v in rows]
    left = "378282246310006 1234567890123 31/31/2021 02/30/2021 May 32, 2021 1.2.3 12/34 ISBN 978-3-16-148410-0"
    r = pii.pseudonymise(spark.createDataFrame([(1, left)], "doc_id long, text string"), key="k").first()
    assert r.n_found == 0 and r.text == left
    days = spark.range(0, 800).select(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for form in ("dd/MM/yyyy", "M/d/yyyy", "d.M.yyyy", "MMM d, yyyy"):
        said = days.select(F.date_format("d", form).alias("d"))
        assert said.select(pii._date(F.col("d"), F.lit("k"), False).alias("x")).distinct().count() == 800


def test_pii_key_and_edges(spark, docs, fixture_texts, empty):
    """No plan shows the key; texts without values stay, whatever the rows are."""
    out = pii.pseudonymise(docs, key="zebra-key")
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "extended")
    assert "text" in plan and "zebra" not in plan
    got = out.collect()
    assert len(got) == len(fixture_texts) + 1
    assert all(r.text == fixture_texts[r.doc_id] for r in got if r.n_found == 0) and sum(r.n_found == 0 for r in got) > 50
    assert pii.pseudonymise(empty, key="k").collect() == []


def test_pii_permutes(spark):
    n = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    got = [r[0] for r in n.select(pii.permute_digits(F.col("d"), F.lit("k"), "t")).collect()]
    assert len(set(got)) == 10_000 and all(len(g) == 4 for g in got)
    days = spark.range(0, 2000).select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pii._date(F.col("d"), F.lit("k"), False).alias("x")).distinct().count() == 2000


DWORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows_of(items):
    out = {}
    for i, t in items:
        w = DWORD.findall(low(t))
        for k in range(len(w) - 12) if len(w) >= 13 else ([0] if w else []):
            out.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    return out


@pytest.mark.parametrize("block_words", [10**6, 40, 14])
def test_decontamination(spark, block_words):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(30)]
    sent = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, sent(40)), (2, sent(20)), (3, "short item"), (10, "v1"), (4, None), (5, ""), (6, "..."), (7, sent(13))]
    items += [(8, items[0][1]), (9, "v2 v3"), (11, sent(500)), (None, sent(30)), (2, sent(15))]
    docs = [(0, None), (1, ""), (2, sent(300)), (3, items[0][1].upper()), (4, sent(100) + " " + items[1][1] + ", " + sent(50)), (5, "a Short-Item b"), (6, "é" + items[7][1]), (7, items[7][1].replace(" ", " -- ")), (8, "xyz " * 50), (8, "xyz " * 50)]
    docs += [(9, " ".join(["zz"] * 400 + items[1][1].split() + ["zz"] * 400)), (10, items[10][1]), (11, "v1 " * 30000)]
    # rows of one id, and without one, with as many words but not the same ones
    docs += [(5, items[7][1]), (5, "xyz " * 13), (None, items[7][1]), (None, "xyz " * 13), (None, items[11][1])]
    wins = windows_of([x for x in items if x[0] is not None])
    got = decontaminate.contamination(
        spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words
    ).collect()
    truth = []
    for i, t in docs:
        w = DWORD.findall(low(t))
        hit, found = set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= ids
        truth.append((i if i is not None else -1, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(truth)


def test_decontamination_cuts_and_keeps(spark, empty):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(1, f"Before. {item}! After."), (2, "clean"), (3, None), (4, ("zz " * 900) + item)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.text for r in decontaminate.remove_spans(docs, items).orderBy("doc_id").collect()] == ["Before. ! After.", "clean", None, rows[3][1]]
    assert [r.text for r in decontaminate.remove_spans(docs, items, max_words=15).orderBy("doc_id").collect()][3] == "zz " * 900
    assert [r.doc_id for r in decontaminate.keep_clean(docs, items).orderBy("doc_id").collect()] == [2, 3, 4]
    assert decontaminate.contamination(docs, items.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0


def test_sharding(docs, fixture_texts, empty, spark):
    got = sharding.assign(docs, shards=5).collect()
    assert len(got) == len(fixture_texts) + 1
    for r in got:
        raw = (fixture_texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign(empty, shards=5).count() == 0
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 7 + 1)) for i in range(6000)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    sizes = [r.b for r in out]
    assert len(out) == 8 and max(sizes) <= 1.02 * min(sizes)


def test_sharding_query_and_null_ids(spark, tmp_path):
    """Rows without an id, in one hot group and out of it, spread like others;
    groups of middle size stay whole; the query's columns are as told."""
    rows = [(None, "hot")] * 3000 + [(None, None)] * 1000 + [(5, f"group {i % 40} " * 5) for i in range(800)] + [(10 + i, f"row {i}") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    sizes, groups = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        if r.doc_id == 5:
            groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert sorted(sizes) == list(range(40)) and max(sizes.values()) <= 1.1 * min(sizes.values())
    assert len(groups) == 40 and all(len(s) == 1 for s in groups.values())
    for shard in range(40):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_automaton_takes_a_constant_time_for_a_word():
    """Equal words on both sides: a walk of 50,000 in well under a second or two."""
    import time

    words = np.full(50_000, 7, np.uint64)
    for size in (50_000, 5):
        matcher = decontaminate.Matcher(["a", "b"], [words[:size], words[:3]], 13)
        began = time.perf_counter()
        spans, items = matcher.walk(words)
        assert time.perf_counter() - began < 2 and spans == [(0, 50_000)] and items == {"a", "b"}


def test_automaton_equals_plain_windows():
    rng = random.Random(12)
    for _ in range(300):
        seqs = [(str(k), [rng.randrange(3) for _ in range(rng.randrange(1, 12))]) for k in range(rng.randrange(1, 7))]
        window = rng.randrange(2, 6)
        text = [rng.randrange(3) for _ in range(40)]
        spans, items = decontaminate.Automaton(seqs, window).walk(text)
        hit, found = set(), set()
        for k, v in seqs:
            size = min(window, len(v))
            wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
            at = {j for i in range(len(text) - size + 1) if tuple(text[i : i + size]) in wins for j in range(i, i + size)}
            hit |= at
            found |= {k} if at else set()
        assert {j for s, e in spans for j in range(s, e)} == hit and items == found


def test_bpe_caches_are_bounded_by_bytes():
    tok = bpe.Tokenizer(WORDS, cache_bytes=(1 << 20, 1 << 20))
    for k in range(30):
        list(tok.encode([" ".join(f"{k}x{i}" + "y" * 2000 for i in range(40)), "the and of"]))
        list(tok.encode(["the"]))
        assert max(tok._held.values()) <= 1 << 20
        assert sum(map(len, tok._ids)) + sum(map(len, tok._ids.values())) <= 1 << 20
    assert "the" in tok._ids
