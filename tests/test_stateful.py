"""Stateful streams: restarts, rows out of order, late rows, the watched folder."""

import datetime as dt
import hashlib

import pytest
from docweave.sources.watch import FolderReader, watch_folder
from docweave.streaming import stateful
from pyspark.sql import functions as F

SCHEMA = "user long, ts timestamp, id long, n long"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def play(spark, tmp_path, waves, make):
    """Each wave lands and the stream is started again; rows by wave."""
    stream = make(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"))
    for k, rows in enumerate(waves):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stateful.run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    return {r.item: (r.total, r.verdict) for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_risk_across_restarts(spark, tmp_path):
    waves = [[(1, at(0), 1, 60), (1, at(10), 2, 60), (2, at(5), 3, 10), (None, at(1), 4, 999)], [(1, at(20), 5, 60), (1, at(35), 6, 5)], [(1, at(200), 7, 1)]]
    got = play(spark, tmp_path, waves, lambda s: stateful.session_risk(s, key="user", ts="ts", item="id", score="n", minutes=30, limit=150))
    assert got == {1: (60, False), 2: (120, False), 3: (10, False), 5: (180, True), 6: (125, False), 7: (1, False)}


def test_a_refused_request_uses_nothing(spark, tmp_path):
    waves = [[(1, at(0), 1, 80), (1, at(1), 2, 30)], [(1, at(2), 3, 20), (1, at(61), 4, 90)]]
    got = play(spark, tmp_path, waves, lambda s: stateful.token_quota(s, key="user", ts="ts", item="id", tokens="n", limit=100, minutes=60))
    assert got == {1: (80, True), 2: (80, False), 3: (100, True), 4: (20, False)}


def test_out_of_order_and_late_rows(spark, tmp_path):
    # 50 is within the hour: judged at the youngest time seen; 7 lies behind the watermark and goes
    waves = [[(1, at(100), 1, 10)], [(1, at(90), 50, 10), (2, at(110), 2, 1)], [(1, at(7), 7, 10)], [(1, at(129), 8, 10)]]
    got = play(spark, tmp_path, waves, lambda s: stateful.session_risk(s, key="user", ts="ts", item="id", score="n", minutes=30, limit=150, late="1 hour"))
    assert got == {1: (10, False), 50: (20, False), 2: (1, False), 8: (30, False)}


@pytest.mark.parametrize("lanes", [1, 3])
def test_log_batches_by_size_and_time(spark, tmp_path, lanes):
    rows = [(0, at(0) + dt.timedelta(seconds=k / 100), k, 0) for k in range(120)]
    waves = [rows[:70], [*rows[70:], (0, at(10), 120, 0)], [(9, at(60), 999, 0)]]
    stream = stateful.log_batches(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*").withColumn("kind", F.when(F.col("user") == 9, "end").otherwise("log")), kind="kind", ts="ts", item="id", lanes=lanes, size=50, wait=5)
    for k, wave in enumerate(waves):
        spark.createDataFrame(wave, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stateful.run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out").where("kind = 'log'").orderBy("lane", "batch", "place").collect()
    assert sorted(r["item"] for r in got) == list(range(121))  # each row once
    sizes = {}
    for r in got:
        sizes.setdefault((r.lane, r.batch), []).append(r["item"])
    assert all(len(v) <= 50 for v in sizes.values()) and [120] in sizes.values()
    if lanes == 1:
        assert [len(sizes[0, k]) for k in range(4)] == [50, 50, 20, 1]


def test_watched_folder_takes_each_file_once(spark, tmp_path):
    inbox, done = tmp_path / "inbox", tmp_path / "done"
    inbox.mkdir()

    def run():
        told = watch_folder(spark, str(inbox), str(done), stable_seconds=0.1).select("name", "size", F.sha2("content", 256).alias("digest"))
        stateful.run_to_files(told, f"{tmp_path}/out", f"{tmp_path}/cp")

    landed = []
    for wave in (["a", "b"], [], ["c"], ["a"]):  # the last is another file of the same name
        for n in wave:
            content = f"{n}{len(landed)}".encode()
            (inbox / n).write_bytes(content)
            landed.append((n, len(content), hashlib.sha256(content).hexdigest()))
        (inbox / ".hidden").write_bytes(b"x")
        run()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(landed)


def test_growing_files_wait(tmp_path, monkeypatch):
    reader = FolderReader({"path": str(tmp_path), "stableseconds": "0"})
    (tmp_path / "whole").write_bytes(b"1")
    (tmp_path / "growing").write_bytes(b"1")
    monkeypatch.setattr("time.sleep", lambda s: (tmp_path / "growing").write_bytes(b"12"))
    end = reader.latestOffset()
    assert [k.split("\x1f")[0] for k in end["files"]] == ["whole"]
    assert [next(reader.read(p)) for p in reader.partitions(reader.initialOffset(), end)] == [("whole", 1, b"1")]
    assert reader.partitions(end, end) == []
