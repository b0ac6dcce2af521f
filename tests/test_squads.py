"""Snapshots, reports of a slate and absent players, by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from contestlab.operators import squads as Q

DAY = dt.date(2024, 5, 1)


def test_snapshots_hold_the_ten_of_most_minutes(spark):
    players = [(2024, 1, i, 10, 36.0 - i) for i in range(12)] + [(2024, 1, 99, 9, 48.0)]
    players += [(2024, 2, i, 10, 30.0) for i in range(5)] + [(2024, 3, 0, 9, 30.0)] + [(2024, 5, 0, 50, 45.0)] + [(2024, 6, i, 10, 45.0) for i in range(6)]
    ratings = spark.createDataFrame([(2024, 1, 2.0), (2024, 2, 21.0), (2024, 3, -15.0), (2024, 4, None), (2024, 6, 0.0)], "season int, team_id int, net double")
    got = Q.team_snapshots(spark.createDataFrame(players, "season int, team_id int, athlete_id int, games int, mpg double"), ratings)
    by = {r.team_id: r for r in got.collect()}
    assert sorted(by) == [1, 2, 3, 4, 6] and by[1].rating == 1570.0 and by[3].players == by[4].players == []
    one = by[1].players
    assert [p.athlete_id for p in one] == list(range(10)) and [p.place for p in one] == list(range(1, 11))
    assert sum(p.minutes for p in one) == pytest.approx(240) and one[0].minutes == pytest.approx(240 * 36 / sum(36.0 - i for i in range(10)))
    assert [p.minutes for p in by[2].players] == [40.0] * 5
    wanted = spark.createDataFrame([(2024, t) for t in (1, 2, 3, 4, 5, 6, 5)], "season int, team_id int")
    rules = sorted((r.team_id, r.rule) for r in Q.snapshot_anomalies(got, wanted).collect())
    off, none = "rotation doesn't add up", "no qualifying players"
    assert rules == [(2, "net rating not plausible"), (2, off), (3, none), (3, off), (4, "net rating not plausible"), (4, none), (4, off), (5, "no snapshot"), (6, "minutes a game not plausible")]


def test_a_slate_and_its_report(spark):
    d = lambda n: DAY + dt.timedelta(n)
    games = spark.createDataFrame([(d(0), 1, 2), (d(0), 3, 4), (d(1), 1, 2), (d(1), 3, 4), (d(1), 5, 6), (d(2), 1, 2)], "day date, home_id int, away_id int")
    rows = [(d(0), 2, "a", "out"), (d(0), 2, "b", "out"), (d(0), 2, None, None), (d(0), 9, "c", "out"), (d(1), 3, "d", None), (d(1), 4, "e", "out"), (d(5), 1, "f", "out")]
    got = {r.day: tuple(r)[1:] for r in Q.slate_reports(games, spark.createDataFrame(rows, "day date, team_id int, player string, status string")).collect()}
    assert got == {d(0): (2, 1, True, 2, [2], [1, 3, 4]), d(1): (3, 1, False, 1, [3], [1, 2, 5, 6]), d(2): (1, 0, False, 0, [], [1, 2])}


def test_absent_players_of_a_side(spark):
    sides = [(1, 1, 5.0, True, True, False), (1, 2, 5.0, False, False, True), (1, 3, 3.0, False, False, False), (1, 4, 3.04, False, False, False), (1, 5, 0.0, True, False, False)]
    drivers = [(1, t, "a", "out", 2.0) for t in (1, 2, 3, 4)] + [(1, t, "b", None, 1.0) for t in (1, 2, 3, 4)]
    report = [(1, t, x, s) for t in (1, 2, 9) for x, s in (("a", "out"), ("c", "out"), ("c", "out"), ("d", "doubtful"))]
    got = Q.absence_sides(
        spark.createDataFrame(sides, "game_id int, team_id int, points double, complete boolean, unfiled boolean, not_submitted boolean"),
        spark.createDataFrame(drivers, "game_id int, team_id int, athlete_id string, status string, points double"), spark.createDataFrame(report, "game_id int, team_id int, athlete_id string, status string"),
    )
    rows = sorted((tuple(r)[1:] for r in got.collect()), key=str)
    stored = [("out", 1, 2.0), (None, 1, 1.0)]
    want = [(1, 5.0, "unfiled, counted", *g, 0, None) for g in stored]
    want += [(2, 5.0, "unfiled, nobody counted", *g, 2, 2.0) for g in (("out", 2, 2.0), (None, 1, 1.0), ("doubtful", 1, 0.0))]
    want += [(3, 3.0, "filed", *g, 0, None) for g in stored] + [(4, 3.04, "filed", *g, 0, None) for g in stored] + [(5, 0.0, "filed", None, None, None, 0, None)]
    assert rows == sorted(want, key=str)
    assert got.where(F.col("team_id") == 9).count() == 0


SIDE = "game_id int, team_id int, points double, complete boolean, unfiled boolean, not_submitted boolean"
LISTED = "game_id int, team_id int, athlete_id string, status string, points double, stored boolean"


def test_listed_rows_of_a_side_are_shuffled_once(spark):
    sides = spark.createDataFrame([(1, 1, 5.0, True, True, False), (1, 2, 5.0, False, False, False)], SIDE)
    listed = [(1, t, "a", "out", 2.0, True) for t in (1, 2, 9)] + [(1, t, "a", None, 1.0, True) for t in (1, 2)]
    listed += [(1, t, "b", s, None, False) for t in (1, 2) for s in (None, "out", "day")] + [(1, t, "a", "day", None, False) for t in (1, 2)]
    listed += [(1, 2, None, "out", 0.5, True), (1, 2, None, "ill", None, False), (1, 2, "c", None, None, False)]
    got = Q.absence_sides_of(sides, spark.createDataFrame(listed, LISTED))
    stored = [(1, 1, 5.0, "unfiled, counted", "out", 1, 2.0, 0, None), (1, 1, 5.0, "unfiled, counted", None, 1, 1.0, 0, None)]
    want = [(1, 2, 5.0, "filed", *g, 3, 1.5) for g in (("out", 2, 2.5), (None, 2, 1.0), ("day", 1, 0.0), ("ill", 1, 0.0))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(stored + want, key=str)
    shuffles = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")
    assert shuffles <= 2  # one of the sides, one of what is listed


def test_a_complete_side_that_only_a_report_names_has_one_row(spark):
    sides = spark.createDataFrame([(1, 1, 5.0, True, False, False), (1, 2, 0.0, False, False, False)], SIDE)
    listed = spark.createDataFrame([(1, 1, "a", "out", None, False), (1, 1, "b", "day", None, False)], LISTED)
    got = sorted(map(tuple, Q.absence_sides_of(sides, listed).collect()))
    assert got == [(1, 1, 5.0, "filed", None, None, None, 0, None), (1, 2, 0.0, "filed", None, None, None, 0, None)]
