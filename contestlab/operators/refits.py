"""Models refitted for each date or each season, all of them at once.

A season's ratings on a date rest on the contests before it. Blocks of days are rated side by side: what came before a
block is a prefix sum of pair counts and margins, and only the block's own days are walked. Fits for many held-out
seasons are one aggregate a Newton step, keyed by season.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestlab.session import cut_lineage

MOST_FITS = 1024  # held-out seasons fitted at once; their coefficients are broadcast


def _sweeps(margins: np.ndarray, meetings: np.ndarray, ridge: float, sweeps: int) -> np.ndarray:
    """Jacobi sweeps from zero: a rating is the mean of margins and opponents' ratings, shrunk by `ridge` contests."""
    counts, r = meetings.sum(axis=1) + ridge, np.zeros(len(margins))
    for _ in range(sweeps):
        r = np.divide(margins + meetings @ r, counts, out=np.zeros_like(r), where=counts > 0)
    return r


def ratings_to_date(games: DataFrame, ridge: float, home: float, sweeps: int = 12, block_days: int = 28) -> DataFrame:
    """games(season, game_date, game_id, home_id, away_id, home_score, away_score, neutral) -> (season, game_date, game_id,
    home_rating, away_rating), as refitted on each date from the season's contests before it, `home` points taken off at
    a home court.

    A task holds one block of days of a season and the sums of its pairs before it, whose number is that of pairs of
    teams. A first day's ratings are zero; a season may have any teams; games without a score must be left out before."""
    adjusted = F.col("home_score") - F.col("away_score") - F.when(F.col("neutral"), 0.0).otherwise(home)
    first = F.min("game_date").over(Window.partitionBy("season"))
    rows = cut_lineage(games.select("season", "game_date", "game_id", "home_id", "away_id", adjusted.cast("double").alias("margin"), F.floor(F.datediff("game_date", first) / block_days).cast("int").alias("block")))
    either = F.array(
        F.struct(F.col("home_id").alias("a"), F.col("away_id").alias("b"), F.col("margin").alias("m")),
        F.struct(F.col("away_id").alias("a"), F.col("home_id").alias("b"), (-F.col("margin")).alias("m")),
    )
    pairs = rows.select("season", "block", F.explode(either).alias("p")).groupBy("season", "block", "p.a", "p.b").agg(F.sum("p.m").alias("m"), F.count("*").alias("n"))
    blocks = rows.select("season", "block").distinct()
    before = pairs.join(blocks.withColumnRenamed("block", "later"), "season").where("block < later")
    before = before.groupBy(F.col("season").alias("_season"), F.col("later").alias("_block"), "a", "b").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))

    def rate(_key, known: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        teams = sorted({*known["a"], *own["home_id"], *own["away_id"]})
        at = {t: i for i, t in enumerate(teams)}
        margins, meetings = np.zeros(len(teams)), np.zeros((len(teams), len(teams)))
        for a, b, m, n in zip(known["a"].map(at), known["b"].map(at), known["m"], known["n"]):
            margins[a] += m
            meetings[a, b] += n
        out = []
        for _, day in own.sort_values(["game_date", "game_id"]).groupby("game_date"):
            r = _sweeps(margins, meetings, ridge, sweeps)
            h, a = day["home_id"].map(at).to_numpy(), day["away_id"].map(at).to_numpy()
            out.append(day[["season", "game_date", "game_id"]].assign(home_rating=r[h], away_rating=r[a]))
            for x, y, sign in ((h, a, 1.0), (a, h, -1.0)):
                np.add.at(margins, x, sign * day["margin"].to_numpy())
                np.add.at(meetings, (x, y), 1.0)
        return pd.concat(out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("season", "game_date", "game_id")) + ", home_rating double, away_rating double"
    # A season's first block has no prefix, so its side of the cogroup is empty.
    return before.groupBy("_season", "_block").cogroup(rows.groupBy("season", "block")).applyInPandas(rate, schema)


def logistic_by_season(rows: DataFrame, season: str, features: list[str], target: str, penalty: float = 1.0, least: int = 30, steps: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """rows -> (season, intercept, slopes array, means array, deviations array, n): for each season with `least` rows in
    earlier ones the logistic model fitted on those, features standardised by population deviation (1 if it is zero),
    slopes penalised, Newton steps until they add up to less than `tolerance`.

    Every step is one aggregate for all seasons not yet settled; only sums reach the driver, one row for each season."""
    spark, p = rows.sparkSession, len(features)
    x = F.array(*[F.col(f).cast("double") for f in features])
    data = cut_lineage(rows.select(F.col(season).alias("_s"), x.alias("_x"), F.col(target).cast("double").alias("_y")))  # read once a step
    kind = data.schema["_s"].dataType.simpleString()
    folds = [r[0] for r in data.select("_s").where("_s is not null").distinct().orderBy("_s").limit(MOST_FITS + 1).collect()]
    if len(folds) > MOST_FITS:
        raise ValueError(f"more than {MOST_FITS} seasons")
    later = F.broadcast(spark.createDataFrame([(f,) for f in folds], f"fold {kind}"))
    each = F.col("_x").getItem
    moments = [F.avg(each(i)).alias(f"m{i}") for i in range(p)] + [F.stddev_pop(each(i)).alias(f"d{i}") for i in range(p)]
    shape = {r["fold"]: ([r[f"m{i}"] for i in range(p)], [r[f"d{i}"] or 1.0 for i in range(p)], r["n"]) for r in data.join(later, F.col("_s") < F.col("fold")).groupBy("fold").agg(F.count("*").alias("n"), *moments).where(F.col("n") >= least).collect()}
    fits, open_ = {f: np.zeros(p + 1) for f in shape}, set(shape)
    cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    for _ in range(steps):
        if not open_:
            break
        now = spark.createDataFrame([(f, [float(b) for b in fits[f]], *map(list, shape[f][:2])) for f in sorted(open_)], f"fold {kind}, _b array<double>, _m array<double>, _d array<double>")
        z = [F.lit(1.0)] + [(each(i) - F.col("_m")[i]) / F.col("_d")[i] for i in range(p)]
        scored = data.join(F.broadcast(now), F.col("_s") < F.col("fold")).select("fold", "_y", F.array(*z).alias("_z"), F.col("_b"))
        linear = sum((F.col("_z")[i] * F.col("_b")[i] for i in range(1, p + 1)), F.col("_b")[0])
        scored = scored.select("fold", "_z", "_y", (1.0 / (1.0 + F.exp(-linear))).alias("_q"))
        w, zi = F.greatest(F.lit(1e-6), F.col("_q") * (1.0 - F.col("_q"))), F.col("_z").getItem
        sums = scored.groupBy("fold").agg(*[F.sum((F.col("_y") - F.col("_q")) * zi(i)).alias(f"g{i}") for i in range(p + 1)], *[F.sum(w * zi(i) * zi(j)).alias(f"h{i}_{j}") for i, j in cells]).collect()
        for r in sums:
            b, on = fits[r["fold"]], np.r_[0.0, np.full(p, penalty)]
            h = np.diag(on)
            for i, j in cells:
                h[i, j] = h[j, i] = h[i, j] + r[f"h{i}_{j}"]
            step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(p + 1)]) - on * b)
            fits[r["fold"]] = b + step
            if np.abs(step).sum() < tolerance:
                open_.discard(r["fold"])
    made = [(f, float(b[0]), [float(v) for v in b[1:]], *map(list, shape[f][:2]), shape[f][2]) for f, b in sorted(fits.items())]
    return spark.createDataFrame(made, f"season {kind}, intercept double, slopes array<double>, means array<double>, deviations array<double>, n long")


def held_out(rows: DataFrame, fits: DataFrame, season: str, features: list[str]) -> DataFrame:
    """rows of the seasons that have a fit, with `fitted`: the chance by the model of the seasons before."""
    x = sum(((F.col(f) - F.col("means")[i]) / F.col("deviations")[i] * F.col("slopes")[i] for i, f in enumerate(features)), F.col("intercept"))
    model = F.broadcast(fits.select(F.col("season").alias("_fold"), "intercept", "slopes", "means", "deviations"))
    return rows.join(model, F.col(season) == F.col("_fold")).withColumn("fitted", 1.0 / (1.0 + F.exp(-x))).drop("_fold", "intercept", "slopes", "means", "deviations")


def log_odds(p, floor: float = 1e-6):
    q = F.least(F.lit(1.0 - floor), F.greatest(F.lit(floor), p))
    return F.ln(q / (1.0 - q))
