"""Spells, how they go on, and what they take, by hand."""

import pytest

from contestlab.operators import absences as A


def test_spells_and_their_length(spark):
    games = spark.createDataFrame([(1, n) for n in range(1, 11)], "team_id int, n int")
    played = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "a", 4), (1, "a", 10), (1, "b", 3), (1, "b", 7)], "team_id int, athlete_id string, n int")
    done, now = A.spells(played, games)
    assert sorted((r.athlete_id, r.length) for r in done.collect()) == [("a", 2), ("a", 5), ("b", 3)]
    assert [(r.athlete_id, r.missed) for r in now.collect()] == [("b", 3)]
    got = {r.missed: r.expected for r in A.further(done, 4).collect()}
    assert got == {1: pytest.approx(7 / 3), 2: pytest.approx(4 / 3), 3: 1.0, 4: 1.0}


def test_points_are_spread_and_the_rest_comes_later(spark):
    absences = spark.createDataFrame([(1, 2.0, 1.5), (1, 1.0, 9.0), (1, 5.0, 0.0), (2, 3.0, 0.25), (3, 4.0, 0.5)], "team_id int, points double, expected double")
    pending = spark.createDataFrame([(1, 3), (2, 1), (3, 0), (4, 1)], "team_id int, games int")
    got = {(r.team_id, r.place): (r.points, r.absent) for r in A.spread(absences, pending).collect()}
    assert got == {(1, 0): (3.0, 2), (1, 1): (2.0, 2), (1, 2): (1.0, 1), (1, -1): (1.0, 1), (2, 0): (0.75, 1), (2, -1): (0.0, 0), (3, -1): (2.0, 1), (4, 0): (0.0, 0), (4, -1): (0.0, 0)}


def test_long_absences_are_not_laid_out_contest_by_contest(spark):
    """40,000 absences over 60,000 contests: laid out one by one they would be 1,200 million rows."""
    absences = spark.range(40_000).selectExpr("1 AS team_id", "CAST(id % 3 AS DOUBLE) AS points", "30000.0 + id % 4 * 0.25 AS expected")
    pending = spark.createDataFrame([(1, 60_000)], "team_id int, games int")
    got = A.spread(absences, pending)
    assert got.count() == 60_001
    rows = {r.place: (r.points, r.absent) for r in got.where("place IN (-1, 0, 29999, 30000, 30001, 59999)").collect()}
    n = [[sum(1 for i in range(40_000) if i % 3 == p and i % 4 == q) for q in range(4)] for p in range(3)]
    points, absent = sum(p * sum(n[p]) for p in range(3)), sum(n[1]) + sum(n[2])
    part = sum(p * n[p][q] * q * 0.25 for p in range(3) for q in range(4))
    assert rows[0] == rows[29_999] == (pytest.approx(points), absent)
    assert rows[30_000] == (pytest.approx(part), sum(n[p][q] for p in (1, 2) for q in (1, 2, 3)))
    assert rows[30_001] == rows[59_999] == rows[-1] == (0.0, 0)
