"""Reuse, progress, intervals, topic shifts, page-wise steps: edges and brute force."""

import random
import time

import pytest
from docweave.operators import intervals, procedures, semantic
from docweave.plans import reuse
from docweave.streaming.progress import Progress, StreamProgress
from pyspark.sql import functions as F


def test_reuse_reads_no_content_again(spark, tmp_path):
    store = reuse.Store(spark, str(tmp_path))
    rows = [(i, f"d{i % 7}", f"text {i % 7}") for i in range(20)] + [(20, None, "no digest"), (21, "bad", "boom")]
    docs = spark.createDataFrame(rows, "doc_id long, digest string, text string")
    calls = spark.sparkContext.accumulator(0)

    def upper(text):
        calls.add(1)
        if text == "boom":
            raise ValueError("broken")
        return text.upper()

    step = reuse.python_step(upper)
    first = store.run("up", "1", docs, step, digest="digest", content="text", label="a").collect()
    assert {r.value for r in first} == {f"TEXT {k}" for k in range(7)} | {"NO DIGEST", None}
    assert [r.error for r in first if r.doc_id == 21] == ["ValueError: broken"]
    assert calls.value == 9  # each content once
    # content that can't be read: all sound keys are there already
    unread = docs.where("doc_id <> 21").withColumn("text", F.raise_error(F.lit("content was read")).cast("string"))
    again = store.run("up", "1", unread, step, digest="digest", content="text", label="b").select("doc_id", "value", "run").collect()
    assert len(again) == 21 and {r.run for r in again} == {"a"} and calls.value == 9
    mended = store.run("up", "1", docs, reuse.python_step(str.upper), digest="digest", content="text", label="c")
    assert [(r.value, r.error, r.run) for r in mended.where("doc_id = 21").collect()] == [("BOOM", None, "c")]
    store.run("up", "2", docs, step, digest="digest", content="text", label="d")
    got = [(m["inputs"], m["reused"], m["computed"], m["failed"]) for m in store.metrics.rows]
    assert got == [(9, 0, 9, 1), (8, 8, 0, 0), (9, 8, 1, 0), (9, 0, 9, 1)]


def test_progress_takes_one_scan(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/n")
    progress = Progress()
    df = progress.step(spark.read.parquet(f"{tmp_path}/n"), "all", total=F.sum("id"))
    df = progress.step(df.where("id % 3 = 0"), "thirds")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    df.write.format("noop").mode("overwrite").save()
    assert [tuple(r) for r in progress.report(spark).orderBy("place", "metric").collect()] == [("all", 0, "rows", 100), ("all", 0, "total", 4950), ("thirds", 1, "rows", 34)]


def test_progress_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = StreamProgress()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        seen = stream.observe("read", F.count(F.lit(1)).alias("rows"), F.sum("id").alias("total"))
        q = seen.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if str(q.runId) in listener.ended:
                break
            time.sleep(0.1)
        assert listener.totals() == {("read", "rows"): 30, ("read", "total"): 435}
    finally:
        spark.streams.removeListener(listener)


def test_intervals_equal_brute_force(spark):
    rng = random.Random(1)
    points = [(rng.choice("ab"), rng.randrange(-5, 400), k) for k in range(300)] + [("a", 7, 0), ("c", 3, 1)]
    spans = [(g, lo, lo + rng.choice((-1, 0, 0, 3, 40, 300)), k) for k, (g, lo) in enumerate((rng.choice("abd"), rng.randrange(0, 380)) for _ in range(60))]
    spans += [spans[0][:3] + (60,), spans[1]]
    p = spark.createDataFrame(points, "g string, x long, k long")
    s = spark.createDataFrame(spans, "g string, lo long, hi long, v long")
    for levels in (3, 20):
        got = sorted(map(tuple, intervals.holding(p, s, "g", "x", "lo", "hi", F.col("v"), levels=levels).collect()))
        want = sorted({(g, x, k, min(hit)) for g, x, k in points if (hit := [v for h, lo, hi, v in spans if h == g and lo <= x <= hi])})
        assert got == want
    counted = sorted(map(tuple, intervals.counts_within(p, s, "g", "x", "lo", "hi").collect()))
    assert counted == sorted((g, lo, hi, v, sum(h == g and lo <= x <= hi for h, x, _ in points) if hi >= lo else 0) for g, lo, hi, v in spans)


def test_a_long_document_has_no_product(spark):
    """100,000 blocks and 10,000 sections of one document."""
    blocks = spark.range(100_000).select(F.lit(1).alias("g"), F.col("id").alias("x"))
    sections = spark.range(10_000).select(F.lit(1).alias("g"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 9).alias("hi"), F.col("id").alias("v"))
    began = time.monotonic()
    assert intervals.holding(blocks, sections, "g", "x", "lo", "hi", F.col("v")).where("first <> floor(x / 10)").count() == 0
    assert intervals.counts_within(blocks, sections, "g", "x", "lo", "hi").where("n <> 10").count() == 0
    assert time.monotonic() - began < 60


def test_semantic_chunks_break_where_words_change(spark):
    cats = " ".join(f"The cat sat on mat {k % 3}." for k in range(12))
    ships = " ".join(f"Ships sail over water {k % 3}!" for k in range(12))
    rows = [(1, f"{cats} {ships}"), (2, None), (3, ""), (4, " .. !"), (5, "One. Two."), (6, "word " * 1000)]
    got = {}
    for r in semantic.semantic_chunks(spark.createDataFrame(rows, "doc_id long, text string"), percent=3, window=2).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.chunk, r.n_words, r.text))
    assert [t.split()[0] for _, _, t in got[1]] == ["The", "Ships"] and got[5] == [(0, 2, "One. Two.")]
    assert set(got) == {1, 5, 6} and len(got[6]) == 1  # a sentence is never cut


def test_reading_stops_after_two_empty_pages(spark):
    long = "x" * 30
    pages = [(1, p, p * 10, long) for p in range(1, 12)] + [(2, 1, 1, "short"), (2, 2, 2, long)]
    found = [(1, 3, 30, "(2) b"), (1, 3, 31, "note"), (1, 5, 50, "1. a"), (1, 5, 51, "[2] again"), (1, 6, 60, "Step 3: c"), (1, 9, 90, "4. never read"), (2, 1, 1, "(1) on a page passed over")]
    blocks = spark.createDataFrame(pages, "document_id long, page long, block_order long, text string")
    steps = spark.createDataFrame(found, "document_id long, page long, block_order long, instruction string")
    got = [tuple(r)[1:] for r in procedures.steps_by_page(blocks, steps).orderBy("place").collect()]
    assert got == [(1, 5, 1, "1. a"), (2, 3, 2, "(2) b"), (3, 6, 3, "Step 3: c"), (4, 3, None, "note")]
    late = procedures.steps_by_page(blocks.withColumn("from", F.lit(4)), steps, start="from").orderBy("place").collect()
    assert [r.instruction for r in late] == ["1. a", "[2] again", "Step 3: c"]
