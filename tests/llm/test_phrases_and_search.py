"""Collocations and exact search against brute force on small fixtures."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docweave.llm import collocations, inner_products

SCHEMA = "doc_id long, text string, lang string, f long, k int, phrase string, chunk string, n long"


def brute_phrases(docs, least, share, top):
    counts, total = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in f.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        rows.sort()
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(rows[:top], 1)]
    return sorted(out)


def phrase_docs():
    rng = random.Random(3)
    words = ["The", "the", "cat", "Été", "x", "日本", "a-b", "\x85", "ran", "far"]
    made = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]) for _ in range(rng.choice((0, 1, 2, 9, 150)))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(300))
    docs = [(t, rng.choice(["en", "de", None, "und", ""])) for t in made]
    docs += [(passage + " end" * i, "en") for i in range(8)] + [("same words here", "en")] * 30 + [(None, "en"), ("", None), (" .,; ", "de")]
    return docs + [("spam " * 40_000, "xx"), ("one", "yy")]


@pytest.mark.parametrize("spacing", [2, 48])
def test_collocations_equal_brute_force(spark, monkeypatch, spacing):
    monkeypatch.setattr(collocations, "SPACING", spacing)
    docs = phrase_docs()
    df = spark.createDataFrame([(i, t, lang, 1, 2, "p", "c", 3) for i, (t, lang) in enumerate(docs)], SCHEMA).repartition(4)
    for least, share, top in ((10, 50, 2000), (2, 70, 5)):
        got = sorted(map(tuple, collocations.collocations(df, least=least, share=share, top=top).collect()))
        assert got == brute_phrases(docs, least, share, top)


def test_full_bits_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    docs = phrase_docs()
    df = spark.createDataFrame([(i, t, lang, 1, 2, "p", "c", 3) for i, (t, lang) in enumerate(docs)], SCHEMA)
    assert sorted(map(tuple, collocations.collocations(df).collect())) == brute_phrases(docs, 10, 50, 2000)


def test_shared_passages_are_one_chunk(spark):
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randrange(5000)}" for _ in range(2000))
    df = spark.createDataFrame([(f"{i} begins {passage} ends {i}", "en") for i in range(50)], "text string, lang string")
    f = [r["f"] for r in collocations.dictionary(df).collect()]
    assert max(f) == 50 and len(f) < 50 * 3 + 100


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000, 5_000_000_000_000, 7_000_000_000_000)], "a long, l long, r long")
    got = df.select(collocations._score("a", "l", "r")).first()[0]
    assert got == 1000000 * 3_000_000_000_000**2 // (5_000_000_000_000 * 7_000_000_000_000)


def test_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


VECTORS = "vec_id long, embedding array<double>, place string, norm long, v int, rank int"


def brute_top(rows, k, every):
    whole = []
    for i, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [max(min(math.floor(64 * x), 2**63 - 1), -(2**63)) for x in v]))
    out = []
    for at, (i, q) in enumerate(whole):
        if i is None or i % every:
            continue
        scored = [(-max(min(sum(a * b for a, b in zip(q, c)), 2**63 - 1), -(2**63)), j is None, j or 0, j) for n, (j, c) in enumerate(whole) if n != at]
        out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def vector_rows():
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.1, 1, 3])).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 520)]  # many equal vectors: ties by id
    rows += [(40, rows[3][1]), (40, rows[3][1]), (None, rows[3][1]), (None, None), (60, None), (80, [1.0, None]), (100, [float("nan")] * 12), (120, [float("inf")]), (140, []), (160, [0.5]), (180, [0.0] * 12), (-20, [-1.0] * 12)]
    return rows


@pytest.mark.parametrize("k", [1, 20, 1000])
def test_top_k_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(inner_products, "QUERIES", 7)
    monkeypatch.setattr(inner_products, "VECTORS", 100)
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "p", 1, 2, 3) for i, v in rows], VECTORS).repartition(5)
    got = sorted((tuple(r) for r in inner_products.top_k(df, k=k).collect()), key=repr)
    assert got == brute_top(rows, k, 20)


def test_top_k_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 18)).tolist()) for i in range(60)]
    rows += [(60, [1e300, -1e300, 1.0, 0.0]), (80, [1e17, 3.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "p", 1, 2, 3) for i, v in rows], VECTORS)
    got = sorted((tuple(r) for r in inner_products.top_k(df, k=5).collect()), key=repr)
    assert got == brute_top(rows, 5, 20)


def test_no_vectors(spark):
    assert inner_products.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert inner_products.top_k(spark.createDataFrame([(20, [1.0], "p", 1, 2, 3)], VECTORS)).count() == 0


def test_bounds_leave_few_pairs_to_score(spark, monkeypatch):
    """Where few coordinates carry most of the length, hardly a pair is scored."""
    rng = np.random.default_rng(6)
    turn = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    x = (rng.normal(size=(4000, 32)) * (0.6 ** np.arange(32))) @ turn
    places = np.arange(4000)
    q = np.floor(64 * x[:40]).astype(np.int64)
    plan = inner_products._Plan.__new__(inner_products._Plan)
    plan.k, plan.d = 20, 32
    values, vectors = np.linalg.eigh(x.T @ x)
    plan.turn, plan.stages = vectors[:, ::-1].copy(), [4, 8, 32]
    c = np.floor(64 * x).astype(np.int64)
    exact = q @ c.T
    least = np.sort(exact, axis=1)[:, -20].astype(float)
    t = q @ plan.turn
    i, j = inner_products._survivors(plan, t, inner_products._rest(t, plan.stages), np.linalg.norm(q, axis=1), least, c @ plan.turn, np.linalg.norm(c, axis=1))
    assert {(a, b) for a in range(40) for b in places if exact[a, b] >= least[a]} <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < 0.05 * exact.size
