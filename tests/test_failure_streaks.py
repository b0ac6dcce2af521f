"""A source's age is elapsed time, in the query and in its SQL."""

import datetime as dt

import duckdb

from contestlab.catalog import ORACLES, QUERIES


def test_age_is_elapsed_and_not_seconds_begun(spark, tmp_path):
    """3,599.2 s lie between 10:00:00.9 and 11:00:00.1, no whole hour, though the clock's seconds differ by 3,600."""
    t = lambda h, us: dt.datetime(2024, 1, 1, h, 0, 0, us)
    rows = [(1, t(10, 900_000), 7, "view", 1.0, '{"k": 1}'), (2, t(11, 100_000), 8, "error", 1.0, '{"k": 1}'), (3, t(10, 100_000), 9, "view", 1.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: r.age_hours for r in QUERIES["failure_streaks"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = {r[0]: r[3] for r in con.execute(ORACLES["failure_streaks"]).fetchall()}
    assert got == want == {7: 0, 8: 0, 9: 1}
