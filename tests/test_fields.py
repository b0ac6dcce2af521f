"""Payload fields, clocks, ledger rules and sinks on hand-made rows."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from contestlab.catalog import QUERIES
from contestlab.functions import fields as P
from contestlab.operators import audits, linear, sealing
from contestlab.sources import payloads, readers, sinks

SF = "/root/testdata/sf0.001"


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_fields(spark):
    assert values(
        spark, a=P.clock_seconds(F.lit("11:07")), b=P.clock_seconds(F.lit("34.5")), c=P.clock_seconds(F.lit("x")), d=P.made_attempted(F.lit("7-5")), e=P.round_of(F.lit("West Conference Finals - Game 1")), f=P.conference_of(F.lit("Northeast")),
        g=P.percent_text(F.lit(0.004)), h=P.percent_text(F.lit(1.0)), i=P.signed(F.lit(-0.04)), j=P.signed(F.lit(12.34)), k=P.ordinal(F.lit(112)), l=P.position_number(F.lit("SG/SF")), m=P.fnv1a(F.lit("foobar")), n=P.combinations(F.lit(10), 5),
        o=P.sentence(F.lit("torn  ACL;left")), p=P.absence_class(F.lit("G League - Two-Way")), q=P.season_label(F.lit(2000)), r=P.is_instant(F.lit("2023-02-29T00:00:00Z")), s=P.seconds_left(F.lit(2), F.lit(30)),
    ) == {
        "a": 667, "b": 34, "c": None, "d": None, "e": 3, "f": None, "g": "<1%", "h": "100%", "i": "even", "j": "+12.3", "k": "112th", "l": 2.5, "m": 0xBF9CF968, "n": 252, "o": "Torn ACL left", "p": "league", "q": "1999-00", "r": False, "s": 1470,
    }


def test_the_hour_that_comes_twice_is_the_later_one(spark):
    wall = lambda text: F.lit(text).cast("timestamp_ntz")
    got = values(spark, a=P.utc_instant(wall("2024-11-03 01:30:00")), b=P.utc_instant(wall("2024-11-03 00:30:00")), c=P.utc_instant(wall("2024-07-01 12:00:00")), d=P.local_time(wall("2024-03-10 07:00:00")))
    assert got == {"a": dt.datetime(2024, 11, 3, 6, 30), "b": dt.datetime(2024, 11, 3, 4, 30), "c": dt.datetime(2024, 7, 1, 16), "d": dt.datetime(2024, 3, 10, 3)}


def test_payloads_tell_why_they_cannot_be_used(spark):
    good = {"id": "1", "date": "2024-01-01T00:00:00Z", "competitions": [{"status": {"type": {"name": "STATUS_FINAL"}}, "competitors": [{"homeAway": "home", "score": "x"}, {"homeAway": "away", "score": "2"}]}]}
    rows = [None, "{", "{}", json.dumps({"id": "1"}), json.dumps({**good, "competitions": [{}]}), json.dumps(good)]
    got = payloads.events(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, payload string")).orderBy("i").collect()
    assert [r["reason"] for r in got] == ["unreadable", "unreadable", "unreadable", "no competition", "sides", "score"]
    box = json.dumps({"labels": ["PTS", "FG"], "athletes": [{"id": 1, "stats": ["7", "3-4"]}, {"id": 2, "stats": ["--"]}]})
    got = payloads.box_scores(spark.createDataFrame([(box,)], "payload string")).orderBy("athlete_id").collect()
    assert [(r["points"], r["made"], r["attempted"], r["seconds"]) for r in got] == [(7, 3, 4, None), (None, None, None, None)]


def test_decisions(spark):
    cases = [(-5, True, False, 0, "missed"), (-5, True, True, 0, None), (-5, False, False, 0, None), (0, True, False, 0, "missed"), (60, True, False, 3, "final"), (60, True, True, 3, None), (61, False, False, 0, "morning"), (300, False, False, 2, "incomplete"), (361, False, False, 2, "wait"), (500, True, False, 0, None)]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, m int, first boolean, final boolean, b int")
    got = rows.select("i", sealing.decision(F.col("m"), F.col("first"), F.col("final"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == [c[4] for c in cases]


def test_ledger_rules_and_alerts(spark):
    rows = spark.createDataFrame([("g", 1, "result", 0.5), ("g", 2, "morning", 0.5), ("g", 3, "morning", 1.5), ("g", 4, "final", 0.5), ("g", 5, "missed", None), ("h", 6, "reissued", 0.1)], "game string, ord long, entry string, p double")
    assert {(r["ord"], r["rule"]) for r in sealing.order_rules(rows).collect()} == {(1, "result without seal"), (3, "repeated"), (3, "chance out of bounds"), (4, "sealed after result"), (5, "missed after final"), (6, "reissued without morning")}
    days = spark.createDataFrame([(1, 10, 4, 0, 0, 0), (2, 9, 4, 3, 3, 4)], "d int, rows int, matched int, rejected int, stale_hours int, report_hours int")
    assert [r["alerts"] for r in sealing.alerts(days).orderBy("d").collect()] == ["match share", "rejections, no report, stale"]


def test_pooled_rates_are_those_of_pooling_violators(spark):
    cells = [(0, 3, 10), (1, 1, 10), (2, 5, 10), (3, 4, 20), (4, 9, 10)]
    got = [r["rate"] for r in audits.pooled_rates(spark.createDataFrame(cells, "o int, h long, n long"), "o", "h", "n").orderBy("o").collect()]
    assert got == pytest.approx([4 / 20, 4 / 20, 9 / 30, 9 / 30, 0.9])


def test_sketch_is_within_its_error(spark):
    exact = {r["kind"]: r["n"] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy(F.col("event_type").alias("kind")).agg(F.count_distinct("user_id").alias("n")).collect()}
    assert all(abs(r["users"] - exact[r["kind"]]) <= max(1, 0.1 * exact[r["kind"]]) for r in QUERIES["approx_distinct_users"](spark, SF).collect())
    many = spark.range(200_000).select(F.approx_count_distinct("id", 0.02)).first()[0]
    assert abs(many - 200_000) <= 200_000 * 0.08


def test_two_pass_match_and_limits(spark):
    known = spark.createDataFrame([("ann lee", "lee", 1), ("bo lee", "lee", 2), ("cy orr", "orr", 3), ("di orr", "orr", 4)], "full string, last string, id int")
    rows = spark.createDataFrame([("ann lee", "lee", 1), ("b. lee", "lee", 2), ("x orr", "orr", 3)], "full string, last string, row int")
    assert {r["row"]: r["id"] for r in sealing.two_pass_match(rows, known, "full", "last", "id").collect()} == {1: 1, 2: 2, 3: None}


def test_days_and_gzip_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, n int")
    readers.write_days(rows, "day", str(tmp_path / "days"))
    readers.write_days(spark.createDataFrame([("2024-01-02", 7)], "day string, n int"), "day", str(tmp_path / "days"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [1, 7]
    with gzip.open(tmp_path / "l.json.gz", "wt") as f:
        f.write('{"k": 1}\n{"k": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "l.json.gz"), "k int").count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 10), (2, None, 11)], "id int, text string, at int")
    path = str(tmp_path / "versions")
    assert sinks.write_if_changed(rows, path, ("at",)) and not sinks.write_if_changed(rows.withColumn("at", F.col("at") + 1).orderBy(F.desc("id")), path, ("at",))
    assert sinks.write_if_changed(rows, path, ("at",), age_hours=3) and sinks.write_if_changed(rows.limit(1), path, ("at",))
    sinks.archive(rows, str(tmp_path / "archive"))
    with pytest.raises(Exception):
        sinks.archive(rows, str(tmp_path / "archive"))
    packed = rows.select(sinks.encoded(rows.columns).alias("p"))
    assert sorted(map(tuple, sinks.decoded(packed, "p", {"id": "int", "text": "string", "at": "int"}).collect())) == [(1, "a", 10), (2, None, 11)]
    series = spark.createDataFrame([("s", 3, 1, dt.date(2024, 5, 1))], "k string, a_wins int, b_wins int, as_of date")
    results = spark.createDataFrame([("s", True, dt.date(2024, 5, 1)), ("s", True, dt.date(2024, 5, 2)), ("s", True, dt.date(2024, 5, 3))], "k string, won_a boolean, day date")
    assert tuple(sinks.updated_scores(series, results, ["k"]).first()) == ("s", 4, 1, dt.date(2024, 5, 3))


def test_monotone_on_the_driver_agrees(spark):
    assert linear.monotone([0.3, 0.1, 0.5, 0.2, 0.9], [10, 10, 10, 20, 10]) == pytest.approx([0.2, 0.2, 0.3, 0.3, 0.9])
