"""Tasks hold about as many rows whatever the table's size."""

import pytest
from pyspark.sql import functions as F

from contestlab.catalog import QUERIES
from contestlab.operators import relations as R

SF = "/root/testdata/sf0.001"


def test_partitions_follow_the_rows(spark):
    few, many = (spark.range(n).select((F.col("id") % 997).alias("k"), "id") for n in (300, 9_000))
    assert R.dealt(few, ["k"], 100).rdd.getNumPartitions() == few.rdd.getNumPartitions()  # three tasks, the session has four
    got = R.dealt(many, ["k"], 100)
    assert got.rdd.getNumPartitions() == 90 and got.count() == got.distinct().count() == 9_000
    assert got.groupBy(F.spark_partition_id(), "k").count().count() == 997


@pytest.mark.parametrize("name", ["playing_time_shares", "season_snapshots", "snapshot_anomaly_list"])
def test_lines_are_dealt_by_their_number(spark, monkeypatch, name):
    plain = QUERIES[name](spark, SF)
    monkeypatch.setattr(R.dealt, "__defaults__", (500,))
    dealt = QUERIES[name](spark, SF)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString() and "REPARTITION_BY_NUM" not in plain._jdf.queryExecution().toString()
    assert sorted(map(tuple, dealt.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
