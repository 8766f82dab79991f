"""The pipeline's stages one after the other, against what each must do."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import public_tokenizers
import pytest
import regex
import tokenizers
from docweave.llm import queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, last = docs.columns, corpus_pipeline.STAGES[-1][0]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != last:
            assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert counts[1] < counts[0] and counts[-1] == counts[-2] == counts[-3]
    assert {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, v long, rep long, comp string, row string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls, repeated ids and rows, copies, an empty and a very
    long text, and columns whose names the operators use themselves."""
    rng = random.Random(3)
    item, base = prose(rng, 40), prose(rng, 200)
    texts = [(1, base), (2, base + " end"), (3, item + " " + prose(rng, 10)), (4, prose(rng, 900) + " " + item), (5, prose(rng, 60) + " token=Zp3kQ9vT1xWm7LrB"), (None, None), (6, None), (7, ""), (None, prose(rng, 50)), (8, prose(rng, 30000)), (9, prose(rng, 70)), (9, prose(rng, 70)), (10, "short")]
    rows = [(i, t, "en", "s", len(t) if t else None, 1, 2, "c", "r") for i, t in [*texts, texts[4], texts[0]]]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, item), (None, base), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet"), {"item": item, "base": base}


def test_stages_on_odd_rows(spark, odd):
    """Each stage on the same odd rows, with its own columns and rows kept."""
    folder, docs, _ = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        kept = [r.doc_id for r in got.collect()]
        if name == "quality rules":  # too short, empty or null ones go
            assert sorted(i for i in kept if i) == [1, 1, 2, 3, 4, 5, 5, 8, 9, 9] and kept.count(None) == 1
        elif name == "near-duplicates":  # copies and near copies; different texts of one id stay
            assert sorted(i for i in kept if i) == [1, 3, 4, 5, 6, 7, 8, 9, 9, 10] and kept.count(None) == 2
        elif name == "decontamination":
            assert 3 not in kept and len(kept) == docs.count() - 1
        else:
            texts = {r.doc_id: r for r in got.collect()}
            assert len(kept) == docs.count() and texts[5].text.endswith("[SECRET]") and texts[5].n_chars == len(texts[5].text) and texts[6].n_chars is None
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count()


def test_cut_spans(spark, odd):
    folder, docs, held = odd
    got = corpus_pipeline.decontamination(spark, docs, folder, cut_spans=True)
    texts = {r.doc_id: r for r in got.collect()}
    assert got.columns == docs.columns and got.count() == docs.count()
    assert held["item"] not in texts[3].text and texts[3].n_chars == len(texts[3].text) and held["item"] in texts[4].text


def test_stages_on_no_rows(spark, odd):
    folder, docs, _ = odd
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).collect() == []


def test_run_on_odd_rows(spark, odd):
    folder, docs, _ = odd
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 4, 5, 8, 9, 9]


def test_equal_rows_without_ids_are_one(spark):
    rng = random.Random(8)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(None, a), (None, a), (7, b), (None, b), (3, b + " more"), (3, a), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(3, b + " more"), (3, a), (None, None), (None, None)], key=repr)


WORD = re.compile("[^\x20\x09-\x0d]+")


def good(text):
    """The quality rules, plainly."""
    text = text or ""
    w = WORD.findall(text)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, w))
    shouted = len(regex.findall(r"\p{Lu}{2,}", text))
    bad = [len(w) < 20, 100 * len(again) > 30 * len(w), len(re.findall("[#*$%&|<>]", text)) * 10 > len(w), (len(lines) - len(set(lines))) * 10 > (text.count("\n") + 1) * 3]
    return not any([*bad, chars > 20 * len(w), chars < 2 * len(w), shouted * 10 > 3 * len(w)])


def deduplicated(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
    by = defaultdict(list)
    for k, g in enumerate(group):
        by[g].append(k)
    return [rows[min(ks, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))] for ks in by.values()]


def clean(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit = words(text), set()
    for item in items:
        v = words(item)
        size = min(13, len(v))
        wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        hit |= {j for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in wins for j in range(i, i + size)}
    return not hit or 20 * len(hit) < len(w)


def test_run_equals_the_plain_program(spark, tmp_path):
    rng = random.Random(21)
    items = [prose(rng, 40), prose(rng, 9), None, ""]
    texts = [prose(rng, rng.choice((5, 30, 120, 700))) for _ in range(40)]
    texts += [texts[k] for k in range(5, 15)] + [f"{texts[k]} {prose(rng, 2)}" for k in range(10, 25)]
    texts += [f"{items[0]} {prose(rng, n)}" for n in (20, 60, 2000)] + [prose(rng, 30) + " " + items[1], None, "", "AA " * 30, "# " * 40 + prose(rng, 30), "line one two\n" * 20]
    texts += [f'{prose(rng, 40)} password = "{"q7" * 8}" {prose(rng, 5)} {"0123456789abcdef" * 3}', prose(rng, 30) + " AKIA" + "Z9" * 9]
    rows = [(rng.choice([k, k, k, 3, None]), t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in deduplicated([(i, t) for i, t in rows if good(t)]) if clean(t, items)]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t in left:
        t = re.sub("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}|password = \"q7q7q7q7q7q7q7q7", "[SECRET]", t)
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
