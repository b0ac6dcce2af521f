"""Operators over box lines: totals, rotations, absences, shares and paired regression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mode_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the first in order."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"), F.col("n"))).alias("b")).select(key, F.col("b.v").alias("mode"), F.col("b.n").alias("votes"))


def last_rosters(rows: DataFrame, team: str, game: str, athlete: str, keep: int = 10) -> DataFrame:
    """Per team and game the athletes of its last `keep` games: rosters first collapse to one row per game."""
    rosters = rows.groupBy(team, game).agg(F.sort_array(F.collect_set(athlete)).alias("roster"))
    order = Window.partitionBy(team).orderBy(game).rowsBetween(-(keep - 1), Window.currentRow)
    return rosters.select(team, game, F.size(F.array_distinct(F.flatten(F.collect_list("roster").over(order)))).alias("rotation"), F.size("roster").alias("played"))


def absence_spells(rows: DataFrame, team: str, game: str, athlete: str) -> DataFrame:
    """Runs of a team's games that an athlete misses between two appearances for it: from the gaps in game ordinals."""
    games = rows.select(team, game).distinct()
    numbered = games.withColumn("_i", F.row_number().over(Window.partitionBy(team).orderBy(game)))
    seen = rows.select(team, game, athlete).distinct().join(numbered, [team, game])
    order = Window.partitionBy(team, athlete).orderBy("_i")
    gap = seen.withColumn("_next", F.lead("_i").over(order)).withColumn("missed", F.col("_next") - F.col("_i") - 1)
    return gap.where("missed > 0").select(team, athlete, F.col(game).alias("last_seen"), F.col("missed").cast("long").alias("missed"))


def survival(spells: DataFrame, length: str, edges: tuple[int, ...]) -> DataFrame:
    """Of spells that reached each edge, how many there were and how long they went on from there."""
    reached = reduce(DataFrame.unionByName, [spells.where(F.col(length) >= e).select(F.lit(e).alias("reached"), (F.col(length) - e).alias("_left")) for e in edges])
    return reached.groupBy("reached").agg(F.count("*").alias("n"), F.avg("_left").alias("mean_left"))


def gram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """X'X of numeric columns as (i, j, value), in one pass with a fixed number of sums."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = rows.agg(*[F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{a}*{b}") for a, b in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"`{a}*{b}`").alias("value")) for a, b in pairs])).alias("g")).select("g.*")


def unique_key_cascade(rows: DataFrame, narrow: DataFrame, wide: DataFrame, key: str, within: str, target: str) -> DataFrame:
    """Resolve names: by (within, key) if that is unambiguous; where (within, key) is unknown, by key alone if that is;
    otherwise null. An ambiguous narrow match never falls back."""
    n = narrow.groupBy(within, key).agg(F.min(target).alias("_n"), F.count_distinct(target).alias("_nc"))
    w = wide.groupBy(key).agg(F.min(target).alias("_w"), F.count_distinct(target).alias("_wc"))
    found = rows.join(n, [within, key], "left").join(w, key, "left")
    by = F.when(F.col("_nc") == 1, F.col("_n")).when(F.col("_nc").isNull() & (F.col("_wc") == 1), F.col("_w"))
    how = F.when(F.col("_nc") == 1, "narrow").when(F.col("_nc") > 1, "ambiguous").when(F.col("_wc") == 1, "wide").when(F.col("_wc") > 1, "ambiguous").otherwise("unknown")
    return found.withColumns({"resolved": by, "how": how}).drop("_n", "_nc", "_w", "_wc")
