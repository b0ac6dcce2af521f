"""Versions read whole or not at all, and tables with spans by hand."""

import pytest

from contestlab.sources import html_tables as H
from contestlab.sources import published as B


def test_only_whole_versions_are_read(spark, tmp_path):
    root = f"file://{tmp_path}"
    one, two = (spark.range(n).toDF("x") for n in (5, 9))
    with pytest.raises(Exception):
        B.Snapshot(spark, root)
    B.publish({"a": one, "b": two}, root, "01")
    B.publish({"a": two, "b": one}, root, "02")
    now = B.Snapshot(spark, root)
    assert (now.version, now.delivery, now.table("a").count(), now.table("b").count()) == ("02", "current", 9, 5)
    with pytest.raises(Exception):
        B.publish({"a": one}, root, "02")
    one.write.mode("append").parquet(f"{root}/data/02/a")  # a stray file is not read
    assert B.Snapshot(spark, root).table("a").count() == 9
    one.write.mode("overwrite").parquet(f"{root}/data/02/b")
    old = B.Snapshot(spark, root)
    assert (old.version, old.delivery, old.table("a").count()) == ("01", "older", 5)
    with pytest.raises(ValueError):
        old.table("c")


def test_spans_push_cells_aside():
    table = "<table><tr><th rowspan=2 colspan=2>a<b>b</b></th><td>c &lt; d</td></tr><tr><td>e<td rowspan='9'>f</tr><tr><td colspan=2> g\n h </td></tr></table>"
    got = H.grid(table)
    assert sorted(got) == [(0, 0, "ab", True), (0, 1, "ab", True), (0, 2, "c < d", False), (1, 0, "ab", True), (1, 1, "ab", True), (1, 2, "e", False), (1, 3, "f", False), (2, 0, "g h", False), (2, 1, "g h", False), (2, 3, "f", False)]
    assert H.grid("") == H.grid("<td>x</td>") == []


def test_comments_come_first_and_missing_tables_give_nothing(spark):
    rows = [(1, "<table id='t'><tr><td>seen</td></tr></table><!-- <table id=\"t\"><tr><td>hid</td></tr></table> -->"), (2, "<table id='t'><tr><td>seen</td></tr></table>"), (3, "<!-- id='t' no table -->"), (4, ""), (5, None)]
    got = H.table_cells(spark.createDataFrame(rows, "k int, h string"), "k", "h", "t").collect()
    assert sorted((r.k, r.text) for r in got) == [(1, "hid"), (2, "seen")]
