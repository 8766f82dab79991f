"""Folds, nested values, model calls and search: edges and brute force."""

import math
import random
from collections import Counter

import pytest
from docweave.functions import nested
from docweave.operators import aggregates, folds, retrieval
from docweave.plans import models
from pyspark.sql import functions as F


def test_fold_streams_keys_in_order(spark, monkeypatch):
    monkeypatch.setattr(folds, "ROWS", 7)
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 3, None]), k, rng.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "key long, at long, n long").repartition(5)

    def step(state, row):
        state.append(row[1])
        return [(row[0], sum(state))] if row[0] % 2 else []

    got = folds.fold(df, ["key"], ["at"], ["at", "n"], list, step, "at long, total long", lambda s: [(-1, sum(s))]).collect()
    want = []
    for key in {r[0] for r in rows}:
        total = 0
        for _, at, n in sorted(r for r in rows if r[0] == key):
            total += n
            if at % 2:
                want.append((key, at, total))
        want.append((key, -1, total))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert folds.fold(df.where("false"), ["key"], ["at"], ["at", "n"], list, step, "at long, total long").count() == 0


def test_canonical_at_any_depth(spark):
    deep = '{"z":' * 30 + '{"b":1,"a":2}' + "}" * 30
    rows = [(1, '{"b": 1, "a": {"d": [ {"y":1,"x":2} ], "c": null}}'), (2, "nope"), (3, None), (4, deep), (5, "[ ]"), (6, '"é"')]
    got = {r.id: r.c for r in spark.createDataFrame(rows, "id long, j string").select("id", nested.canonical(F.col("j")).alias("c")).collect()}
    assert got == {1: '{"a":{"c":null,"d":[{"x":2,"y":1}]},"b":1}', 2: None, 3: None, 4: deep.replace('"b":1,"a":2', '"a":2,"b":1'), 5: "[]", 6: '"é"'}


def test_approval_ignores_the_order_of_keys(spark):
    calls = spark.createDataFrame([(1, "f", '{"a":1,"b":2}'), (2, "f", '{"b":2, "a":1}'), (3, "g", '{"a":1,"b":2}'), (4, "f", None), (5, "f", "broken"), (6, None, "{}")], "id long, name string, args string")
    allowed = spark.createDataFrame([("f", '{"b":2,"a":1}'), ("f", None), ("f", "broken")], "name string, args string")
    assert {r.id: r.approved for r in nested.approved(calls, allowed, "name", "args").collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_settings_by_path(spark):
    rows = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":2}],"e":{}},"d":"x"}'), (2, "[[],0]"), (3, "no")], "id long, j string")
    flat = nested.flat_settings(rows, "id", "j")
    assert sorted(map(tuple, flat.collect())) == [(1, "a.b[0]", "1"), (1, "a.b[1].c", "2"), (1, "a.e", "{}"), (1, "d", '"x"'), (2, "[0]", "[]"), (2, "[1]", "0")]
    shallow = nested.flat_settings(rows.where("id = 1"), "id", "j", depth=1)
    assert sorted(map(tuple, shallow.collect())) == [(1, "a", '{"b":[1,{"c":2}],"e":{}}'), (1, "d", '"x"')] or sorted(r.path for r in shallow.collect()) == ["a.b", "a.e", "d"]
    changes = spark.createDataFrame([(1, "d", '"y"'), (1, "new", "1"), (1, "odd", "2"), (9, "d", "0")], "id long, path string, value string")
    got = {(r.id, r.path): r.value for r in nested.apply_settings(flat, changes, ("new",)).collect()}
    assert got[1, "d"] == '"y"' and got[1, "new"] == "1" and (1, "odd") not in got and (9, "d") not in got and got[2, "[1]"] == "0"


def stub():
    class Stub:  # made here, so that it goes to the workers by value
        def __init__(self, name, bad=(), busy=0):
            self.name, self.bad, self.busy, self.seen = name, bad, busy, []

        def __call__(self, texts):
            self.seen.append(list(texts))
            if self.busy:
                self.busy -= 1
                raise models.Retry("busy")
            if any(t in self.bad for t in texts):
                raise models.Refused("no")
            return [f"{self.name}:{t}" for t in texts]

    return Stub


def test_providers_in_order():
    waits, Stub = [], stub()
    one, two = Stub("one", bad={"b", "z"}, busy=2), Stub("two", bad={"z"})
    client = models.Client([one, two], retries=2, backoff=1, sleep=waits.append)
    got = client.ask(["a", "b", "c", "z"])
    assert [(v, p, e) for v, p, _, e in got] == [("one:a", "one", None), ("two:b", "two", None), ("one:c", "one", None), (None, None, "two: no")]
    assert waits[:2] == [1, 2] and one.seen[:3] == [["a", "b", "c", "z"]] * 3 and two.seen == [["b"], ["z"]]
    busy = Stub("busy", busy=99)
    assert [x[0] for x in models.Client([busy, Stub("two")], retries=1, sleep=waits.append).ask(["q"])] == ["two:q"] and len(busy.seen) == 2
    short = type("Short", (), {"name": "short", "__call__": lambda self, texts: []})()
    assert models.Client([short], sleep=waits.append).ask(["q"])[0][3].startswith("short: 0 answers")


def test_pace_keeps_its_distance():
    now = [0.0]
    waited = []

    def sleep(s):
        waited.append(s)
        now[0] += s

    pace = models.Pace(2.0, clock=lambda: now[0], sleep=sleep)
    pace.wait("a")
    pace.wait("b")  # keys don't wait for each other
    now[0] = 0.5
    pace.wait("a")
    now[0] = 10.0
    pace.wait("a")
    assert waited == [1.5]


def test_each_row_once(spark):
    Stub = stub()
    df = spark.createDataFrame([(i, f"t{i}" if i % 9 else None) for i in range(300)] + [(7, "t7")], "k long, t string").repartition(6)
    got = models.call_models(df, "k", "t", lambda: [Stub("one", bad={"t5", ""}, busy=1), Stub("two", bad={""})], batch=8, partitions=3, rate=1e6, backoff=0).collect()
    assert Counter(r.id for r in got) == Counter(r[0] for r in df.select("k").collect())
    assert {r.provider for r in got if r.id == 5} == {"two"} and all((r.value is None) == (r.id % 9 == 0) for r in got)
    with pytest.raises(ValueError):
        models.call_models(df, "k", "t", list, rate=1)


def test_search_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(rng.choices(words, k=rng.choice((0, 1, 20, 90))))) for k in range(150)] + [(200, None), (201, "--")]
    asked = [(q, rng.choice(words)) for q in range(12) for _ in range(6)] + [(99, "absent"), (3, None)]
    monkeypatch.setattr(retrieval, "QUERY_TERMS", 15)
    got = {(r.query_id, r.id): (r.score, r["rank"]) for r in retrieval.search(spark.createDataFrame(asked, "query_id long, term string"), spark.createDataFrame(texts, "id long, text string"), "id", "text", 7).collect()}
    docs = {k: Counter(t.split()) for k, t in texts if t and t != "--" and t.split()}
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    want = {}
    for q in {q for q, _ in asked}:
        scores = []
        for k, c in docs.items():
            s, hit = 0.0, False
            for term in {t for p, t in asked if p == q and t}:
                if c[term]:
                    df = sum(1 for d in docs.values() if d[term])
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                    hit = True
            if hit:
                scores.append((-round(s, 6), k))
        want |= {(q, k): (-s, i) for i, (s, k) in enumerate(sorted(scores)[:7], 1)}
    assert got == want
    assert retrieval.search(spark.createDataFrame([], "query_id long, term string"), spark.createDataFrame(texts, "id long, text string"), "id", "text", 7).count() == 0


def test_keyword_frequency_on_odd_rows(spark):
    rows = [(1, "the cats the Cats dogs that dogs cats"), (2, None), (3, ""), (4, "a b c"), (1, "birds"), (5, "word " * 50_000)]
    got = sorted(map(tuple, aggregates.keyword_frequency(spark.createDataFrame(rows, "id long, text string"), "id", "text", ("that",), top=2).collect()))
    assert got == [(1, "birds", 1, 0, 1), (1, "cats", 3, 0, 1), (1, "dogs", 2, 2, 2), (5, "word", 50_000, 0, 1)]
