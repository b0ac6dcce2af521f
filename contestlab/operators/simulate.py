"""Exact series, and seasons by Monte Carlo over partitioned iterations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series_win(p: Column, need: int = 4) -> Column:
    """The chance to win `need` contests first at a constant chance p: a finite sum, inside the row."""
    from math import comb

    return sum((F.lit(float(comb(need - 1 + lost, lost))) * F.pow(p, F.lit(need)) * F.pow(1.0 - p, F.lit(lost)) for lost in range(need)), F.lit(0.0))


def expected_games(p: Column, need: int = 4) -> Column:
    """The expected number of contests of the same series."""
    from math import comb

    terms = (F.lit(float((need + lost) * comb(need - 1 + lost, lost))) * (F.pow(p, F.lit(need)) * F.pow(1.0 - p, F.lit(lost)) + F.pow(1.0 - p, F.lit(need)) * F.pow(p, F.lit(lost))) for lost in range(need))
    return sum(terms, F.lit(0.0))


def series_uncertainty(key: Column, margin: Column, sd: Column, scale: float = 6.5, need: int = 4, draws: int = 800, seed: int = 5) -> Column:
    """The 10, 50 and 90 % points of the series chance when the margin is only known to within sd: normal draws by Box
    and Muller from hashes of the key, made, turned into chances and sorted inside the row."""

    def uniform(i: Column, k: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(key, i, F.lit(seed + k)), 11).cast("double") + 0.5) * F.lit(2.0**-53)

    def chance(i: Column) -> Column:
        z = F.sqrt(-2.0 * F.ln(uniform(i, 0))) * F.cos(F.lit(6.283185307179586) * uniform(i, 1))
        p = 1.0 / (1.0 + F.exp(-(margin + sd * z) / F.lit(scale)))
        return series_win(p, need)

    drawn = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(draws)), chance))
    at = lambda q: F.element_at(drawn, F.lit(1 + int(q * (draws - 1) + 0.5)))
    return F.struct(at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


def season(strength: DataFrame, fixtures: DataFrame, iterations: int = 2000, sigma: float = 10.5, seed: int = 29, parts: int = 16) -> DataFrame:
    """strength(team_id, conference, wins, mean, sd) and fixtures(home_id, away_id, n) -> per team: mean wins, their
    10 and 90 % points, and the chances to lead the conference and to be among its best two.

    Both inputs are counts by team and by pair of teams, whose number doesn't grow with the contests; iterations are
    dealt over tasks, each vectorised, and only counters by team come back. Every iteration has its own random stream,
    so results don't depend on how they are dealt."""
    teams = strength.orderBy("team_id").toPandas()
    pairs = fixtures.orderBy("home_id", "away_id").toPandas()
    index = {t: i for i, t in enumerate(teams["team_id"])}
    home, away = pairs["home_id"].map(index).to_numpy(int), pairs["away_id"].map(index).to_numpy(int)
    n, now = pairs["n"].to_numpy(int), teams["wins"].to_numpy(float)
    mean, sd = teams["mean"].to_numpy(float), teams["sd"].to_numpy(float)
    groups = [np.flatnonzero(teams["conference"] == c) for c in sorted(teams["conference"].unique())]
    erf = np.vectorize(__import__("math").erf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[int, int, int, int], int] = {}
        for pdf in batches:
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                x = mean + sd * rng.standard_normal(len(mean))
                p = 0.5 * (1 + erf((x[home] - x[away]) / (sigma * np.sqrt(2))))
                won = rng.binomial(n, p)
                total = now + np.bincount(home, won, len(now)) + np.bincount(away, n - won, len(now))
                order = total + rng.random(len(now)) * 0.5
                lead, two = np.zeros(len(now), int), np.zeros(len(now), int)
                for g in groups:
                    best = g[np.argsort(-order[g])]
                    lead[best[0]] = 1
                    two[best[:2]] = 1
                for t in range(len(now)):
                    key = (t, int(total[t]), int(lead[t]), int(two[t]))
                    counts[key] = counts.get(key, 0) + 1
        yield pd.DataFrame([(*k, v) for k, v in counts.items()], columns=["t", "wins", "lead", "two", "n"])

    spark = strength.sparkSession
    cells = spark.range(0, iterations, 1, parts).mapInPandas(run, "t int, wins int, lead int, two int, n long").groupBy("t", "wins").agg(
        F.sum("n").alias("n"), F.sum(F.col("lead") * F.col("n")).alias("lead"), F.sum(F.col("two") * F.col("n")).alias("two")
    )
    from pyspark.sql import Window

    cum = F.sum("n").over(Window.partitionBy("t").orderBy("wins"))
    q = lambda share: F.min(F.when(F.col("_c") >= iterations * share, F.col("wins")))
    out = cells.withColumn("_c", cum).groupBy("t").agg(
        (F.sum(F.col("wins") * F.col("n")) / iterations).alias("mean_wins"), q(0.1).alias("p10"), q(0.9).alias("p90"), (F.sum("lead") / iterations).alias("leads"), (F.sum("two") / iterations).alias("top_two")
    )
    names = spark.createDataFrame([(i, int(t)) for t, i in index.items()], "t int, team_id long")
    return out.join(F.broadcast(names), "t").drop("t")  # one row per team
