"""Streams give what the same rows give in a batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from contestlab.streaming import ledger as L

SCHEMA = "game string, ord long, won int, at timestamp, value double"


@pytest.fixture()
def folder(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [
        [("g1", 1, 1, t(0), 1.0), ("g2", 2, 0, t(1), 2.0), ("g1", 3, 1, t(2), 3.0)],
        [("g1", 4, 0, t(5), 4.0), ("g2", 5, 0, t(6), 5.0)],
        [("g3", 6, 1, t(30), 6.0), ("g1", 7, 1, t(31), 7.0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path


def collect(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_windowed_counts_equal_the_batch(spark, folder):
    rows = collect(spark, L.windowed_counts(L.plays_stream(spark, str(folder / "in"), SCHEMA, 10), "at", ["game"], "6 hours"), "windows")
    batch = spark.read.parquet(str(folder / "in")).groupBy(F.window("at", "6 hours").alias("w"), "game").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    want = {(r["w"]["start"], r["game"], r["n"], r["total"]) for r in batch.collect()}
    got = {(r["opened"], r["game"], r["n"], r["total"]) for r in rows}
    assert got and got <= want


def test_append_once(spark, folder):
    rows = collect(spark, L.append_once(L.plays_stream(spark, str(folder / "in"), SCHEMA, 10), ["game"]), "once")
    assert sorted(r["game"] for r in rows) == ["g1", "g2", "g3"]


def test_upsert_keeps_the_latest_version(spark, folder):
    stream = L.plays_stream(spark, str(folder / "in"), SCHEMA)
    L.upsert(stream, ["game"], "ord", str(folder / "out"), str(folder / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r["game"]: r["ord"] for r in L.latest(spark, str(folder / "out"), ["game"], "ord").collect()}
    assert got == {"g1": 7, "g2": 5, "g3": 6}


def test_corrections_emit_changes_only(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = collect(spark, L.corrections(L.plays_stream(spark, str(folder / "in"), SCHEMA, 10).select("game", "ord", "won")), "corrected")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r["ord"], r["game"], r["corrected"]) for r in rows)
    assert got == [(1, "g1", False), (2, "g2", False), (4, "g1", True), (6, "g3", False), (7, "g1", True)]
