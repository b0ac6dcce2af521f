"""Ordered folds: ratings that depend on every contest before.

A rating of one pool of teams is a chain: its state passes from contest to contest. The chain runs over dates, not over
rows, and pools (leagues, regions) are independent, so groups are dealt over tasks and each task streams its group's
contests in order and keeps only the state, whose size is the number of teams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _streamed(games: DataFrame, pool: str, step, schema: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Feed each pool's contests in order to step(state, row) -> (state, output row), batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.pool != held:
                    held, state = row.pool, None
                state, made = step(state, row)
                out.append(made)
            names = [c.split()[0] for c in schema.split(", ")]
            yield pd.DataFrame(out, columns=names)

    # A date as days keeps the state numeric; sorting is by Spark, which spills.
    rows = games.withColumn("day", F.unix_date("game_date")).withColumn("pool", F.col(pool))
    ordered = rows.repartition("pool").sortWithinPartitions("pool", "season", "day", "game_id")
    return ordered.select("pool", "season", "day", "game_id", "home_id", "away_id", "home_score", "away_score", "neutral", *also).mapInPandas(run, schema)


def elo(games: DataFrame, pool: str, start: float = 1505.0, k: float = 20.0, home: float = 100.0, carry: float = 0.75) -> DataFrame:
    """Margin-of-victory Elo: the chance of the home side before each contest, and both ratings after it."""

    def step(state, g):
        season, ratings = state or (g.season, {})
        if g.season != season:
            ratings = {t: carry * r + (1 - carry) * start for t, r in ratings.items()}
        h, a = ratings.get(g.home_id, start), ratings.get(g.away_id, start)
        d = h - a + (0 if g.neutral else home)
        p = 1 / (1 + 10 ** (-d / 400))
        m = g.home_score - g.away_score
        lead = d if m > 0 else -d
        move = k * (abs(m) + 3) ** 0.8 / (7.5 + 0.006 * lead) * ((m > 0) - p)
        ratings[g.home_id], ratings[g.away_id] = h + move, a - move
        return (g.season, ratings), (g.game_id, p, h + move, a - move)

    return _streamed(games, pool, step, "game_id long, p_home double, home_rating double, away_rating double")


# The rating model's parameters.
KALMAN = {"sigma": 10.5, "q": 0.05, "q_home": 0.0002, "rho": 0.85, "tau": 4.5, "home": 1.0, "home_var": 1.0, "cap": 30.0}


def kalman(games: DataFrame, pool: str, adjust: str | None = None, by_day: bool = False, **parameters: float) -> DataFrame:
    """Kalman ratings with a shared home advantage: predicted margin, its variance and the home side's chance, each from
    contests before only. Teams regress between seasons and drift with the days between contests.

    adjust names a column of points expected for the home side for reasons outside the ratings (absences, rest); it
    enters the prediction and what is learned. by_day prices all contests of a day from the state before that day and
    learns from them afterwards."""
    c = KALMAN | parameters

    noise = c["sigma"] ** 2

    def spread(p, h, a, on):
        ph = p[:, h] - p[:, a]
        return ph + p[:, 0] if on else ph

    def learn(state, h, a, on, margin, ph=None):
        """In place: a contest costs a handful of array operations, and all contests of a pool pass here one by one."""
        x, p = state["x"], state["p"]
        ph = spread(p, h, a, on) if ph is None else ph
        gain = ph / (noise + ph[h] - ph[a] + on * ph[0])
        x += gain * (margin - (x[h] - x[a] + on * x[0]))
        p -= gain[:, None] * ph

    def step(state, g):
        if state is None:
            state = {"at": {}, "x": np.array([c["home"]]), "p": np.array([[c["home_var"]]]), "season": g.season, "day": None, "wait": []}
        if g.season != state["season"] or g.day != state["day"]:
            for seen in state["wait"]:
                learn(state, *seen)
            state["wait"] = []
        at = state["at"]
        for team in (g.home_id, g.away_id):
            if team not in at:
                at[team] = len(state["x"])
                state["x"] = np.append(state["x"], 0.0)
                state["p"] = np.pad(state["p"], ((0, 1), (0, 1)))
                state["p"][-1, -1] = c["tau"] ** 2
        if g.season != state["season"]:
            teams = np.arange(1, len(state["x"]))
            scale = np.r_[1.0, np.full(len(teams), c["rho"])]
            state["x"], state["p"] = state["x"] * scale, state["p"] * scale[:, None] * scale[None, :]
            state["p"][teams, teams] += (1 - c["rho"] ** 2) * c["tau"] ** 2
            state["day"] = None
        if state["day"] is not None and g.day > state["day"]:
            teams = np.arange(1, len(state["x"]))
            state["p"][teams, teams] += c["q"] * (g.day - state["day"])
            state["p"][0, 0] += c["q_home"] * (g.day - state["day"])
        state["season"], state["day"] = g.season, g.day
        x, p = state["x"], state["p"]
        h, a, on = at[g.home_id], at[g.away_id], 0.0 if g.neutral else 1.0
        ph = spread(p, h, a, on)
        mean, var = x[h] - x[a] + on * x[0] + g.adjust, ph[h] - ph[a] + on * ph[0]
        z = mean / math.sqrt(2 * (noise + var))
        chance = min(1 - 1e-6, max(1e-6, 0.5 * (1 + math.erf(z))))
        margin = max(-c["cap"], min(c["cap"], float(g.home_score - g.away_score))) - g.adjust
        if by_day:
            state["wait"].append((h, a, on, margin))
        else:
            learn(state, h, a, on, margin, ph)
        return state, (g.game_id, float(mean), float(var), chance)

    rows = games.withColumn("adjust", F.coalesce(F.col(adjust).cast("double"), F.lit(0.0)) if adjust else F.lit(0.0))
    return _streamed(rows, pool, step, "game_id long, expected_margin double, variance double, p_home double", ("adjust",))
