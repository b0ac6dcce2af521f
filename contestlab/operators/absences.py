"""Absences: how long one that has lasted so far goes on, and what it takes from a team's coming contests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 20  # contests missed, from which absences are of one kind


def spells(played: DataFrame, team_games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """played(team_id, athlete_id, n) and team_games(team_id, n), n numbering a team's contests from 1 -> completed spells
    (team_id, athlete_id, length) and open ones (team_id, athlete_id, missed), those of no contest left out."""
    w = Window.partitionBy("team_id", "athlete_id").orderBy("n")
    rows = played.select("team_id", "athlete_id", "n").distinct()
    done = rows.withColumn("length", F.lead("n").over(w) - F.col("n") - 1).where("length > 0").select("team_id", "athlete_id", "length")
    last = team_games.groupBy("team_id").agg(F.max("n").alias("last"))
    now = rows.groupBy("team_id", "athlete_id").agg(F.max("n").alias("n")).join(last, "team_id")
    return done, now.select("team_id", "athlete_id", (F.col("last") - F.col("n")).alias("missed")).where("missed > 0")


def further(done: DataFrame, most: int = MOST) -> DataFrame:
    """(missed, expected): how many contests more a spell goes on that has lasted `missed` ones, `most` standing for more."""
    lasted = done.select("length", F.explode(F.sequence(F.lit(1), F.least(F.col("length"), F.lit(most)).cast("int"))).alias("missed"))
    return lasted.groupBy("missed").agg(F.avg(F.col("length") - F.col("missed")).alias("expected"))


def spread(absences: DataFrame, pending: DataFrame) -> DataFrame:
    """absences(team_id, points, expected) and pending(team_id, games) -> (team_id, place, points, absent): what each of
    a team's coming contests (from 0) lacks, and under place -1 what is left for those after them. An absence takes its
    points from as many contests as are expected, the last in part; every coming contest has a row.

    Absences are summed by the contest that they reach last. Between two such contests a team lacks the same, what reaches
    the later one, so each coming contest is written once, however many absences there are and however long they go on."""
    rows = absences.where("expected > 0").join(pending, "team_id")
    last = F.least(F.floor("expected"), F.col("games") + 1).cast("int")  # the contest taken in part; beyond all of them: none
    part = F.when(last <= F.col("games"), F.col("expected") - last).otherwise(F.lit(0.0))
    rows = rows.select("team_id", last.alias("last"), "points", part.alias("part"), (F.col("points") > 0).alias("counts"))
    reached = rows.groupBy("team_id", "last").agg(
        F.sum("points").alias("whole"), F.sum(F.col("points") * F.col("part")).alias("partly"),
        F.count(F.when(F.col("counts"), 1)).alias("all"), F.count(F.when(F.col("counts") & (F.col("part") > 0), 1)).alias("some"),
    )
    end = pending.select("team_id", (F.col("games") + 1).cast("int").alias("last"), *[F.lit(0.0).alias(c) for c in ("whole", "partly")], *[F.lit(0).alias(c) for c in ("all", "some")])
    steps = reached.unionByName(end).groupBy("team_id", "last").agg(*[F.sum(c).alias(c) for c in ("whole", "partly", "all", "some")])
    w = Window.partitionBy("team_id").orderBy("last")  # a row for each contest that some absence reaches last
    later = w.rowsBetween(1, Window.unboundedFollowing)
    beyond = lambda c: F.coalesce(F.sum(c).over(later), F.lit(0))
    steps = steps.select(
        "team_id", "last", "partly", "some", F.coalesce(F.lag("last").over(w) + 1, F.lit(0)).alias("first"),
        "whole", "all", beyond("whole").alias("whole_later"), beyond("all").alias("all_later"),
    ).join(pending, "team_id")
    upto = F.least(F.col("last"), F.col("games")).cast("int")
    each = steps.where(F.col("first") <= upto).withColumn("place", F.explode(F.sequence("first", upto)))
    at_last = F.col("place") == F.col("last")
    return each.select(
        "team_id", F.when(F.col("place") < F.col("games"), F.col("place")).otherwise(-1).alias("place"),
        (F.col("whole_later") + F.when(at_last, F.col("partly")).otherwise(F.col("whole"))).alias("points"),
        (F.col("all_later") + F.when(at_last, F.col("some")).otherwise(F.col("all"))).alias("absent"),
    )
