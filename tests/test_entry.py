"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_has_rows_and_a_schema(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and "team" in got.columns


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_adaptive_plans_prune_columns(spark):
    plan = entry.queries()["games_per_date"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "lineitem" in line and "ReadSchema" in line)
    assert "l_extendedprice" not in scan and "l_linestatus" not in scan
