"""Refits of many dates and seasons against one fit at a time."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlab.operators import refits as R

GAMES = "season int, game_date date, game_id long, home_id long, away_id long, home_score long, away_score long, neutral boolean"


def league(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        season = rng.choice([2001, 2002])
        home, away = rng.sample(range(9), 2)
        rows.append((season, dt.date(season, 1, 1) + dt.timedelta(days=rng.randrange(120)), i, home, away, rng.randrange(120), rng.randrange(120), rng.random() < 0.2))
    return rows


def one_date(rows, ridge, home, sweeps):
    """Ratings from a list of games, team by team."""
    r = {}
    for _ in range(sweeps):
        sums, counts = {}, {}
        for _, _, _, h, a, hs, as_, neutral in rows:
            m = hs - as_ - (0 if neutral else home)
            for x, y, v in ((h, a, m), (a, h, -m)):
                sums[x] = sums.get(x, 0.0) + v + r.get(y, 0.0)
                counts[x] = counts.get(x, 0) + 1
        r = {t: sums[t] / (counts[t] + ridge) for t in sums}
    return r


@pytest.mark.parametrize("block_days", [1, 28, 1000])
def test_ratings_equal_one_solve_for_each_date(spark, block_days):
    rows = league(2)
    got = R.ratings_to_date(spark.createDataFrame(rows, GAMES), 2.0, 3.0, 12, block_days).collect()
    assert len(got) == len(rows)
    for g in got:
        mine = rows[g.game_id]
        r = one_date([x for x in rows if x[0] == mine[0] and x[1] < mine[1]], 2.0, 3.0, 12)
        assert g.home_rating == pytest.approx(r.get(mine[3], 0.0), abs=1e-9) and g.away_rating == pytest.approx(r.get(mine[4], 0.0), abs=1e-9)


def test_fits_by_season_equal_one_fit_at_a_time(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [1, 20] + [0, 5]
    season = rng.integers(0, 6, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.05 * x[:, 1])))).astype(int)
    rows = spark.createDataFrame([(int(s), float(a), float(b), int(v)) for s, (a, b), v in zip(season, x, y)], "season int, a double, b double, y int")
    fits = {r.season: r for r in R.logistic_by_season(rows, "season", ["a", "b"], "y", penalty=1.0).collect()}
    for s in range(6):
        train = season < s
        if train.sum() < 30:
            assert s not in fits
            continue
        z = (x[train] - x[train].mean(0)) / x[train].std(0)
        d, b = np.c_[np.ones(len(z)), z], np.zeros(3)
        for _ in range(50):
            q = 1 / (1 + np.exp(-d @ b))
            b += np.linalg.solve((d * (q * (1 - q))[:, None]).T @ d + np.diag([0, 1, 1]), d.T @ (y[train] - q) - np.array([0, *b[1:]]))
        assert [fits[s].intercept, *fits[s].slopes] == pytest.approx(b.tolist(), abs=1e-7) and fits[s].n == train.sum()
    held = R.held_out(rows, R.logistic_by_season(rows, "season", ["a", "b"], "y"), "season", ["a", "b"])
    assert {r.season for r in held.select("season").distinct().collect()} == set(fits)


def test_no_rows(spark):
    none = spark.createDataFrame([], "season int, x double, y int")
    assert R.logistic_by_season(none, "season", ["x"], "y").count() == 0
    assert R.ratings_to_date(spark.createDataFrame([], GAMES), 2.0, 3.0).count() == 0
