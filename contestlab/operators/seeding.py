"""Seeds by a recursive tie-break, for all leagues and seasons at once: ties are refined together until none is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.operators.standings import won
from contestlab.session import cut_lineage


def _share(wins: str, losses: str) -> Column:
    return F.coalesce(F.try_divide(F.col(wins).cast("double"), F.col(wins) + F.col(losses)), F.lit(0.0))


def season_table(side_rows: DataFrame, team_rows: DataFrame, by: str) -> DataFrame:
    """(by, team_id, conference, division, wins, losses, conf_*, div_*, diff) of every team with a contest."""
    other = team_rows.select(F.col("team_id").alias("opp_id"), F.col("conference").alias("_c"), F.col("division").alias("_d"))
    rows = side_rows.join(team_rows.select("team_id", "conference", "division"), "team_id").join(other, "opp_id")
    conf = F.col("conference") == F.col("_c")
    div = conf & (F.col("division") == F.col("_d"))
    both = [F.sum(F.when(w, v).otherwise(0)).alias(f"{n}{k}") for n, w in (("", F.lit(True)), ("conf_", conf), ("div_", div)) for k, v in (("wins", won()), ("losses", 1 - won()))]
    return rows.groupBy(by, "team_id", "conference", "division").agg(*both, F.sum(F.col("scored") - F.col("allowed")).alias("diff"))


def refined(table: DataFrame, meetings: DataFrame, part: list[str], by: str) -> DataFrame:
    """table with `place` within `part`, by share of wins; ties by the first of these that tells any of the tied apart,
    after which each group still tied starts again from the first with its own meetings only: head to head, then leader of
    a division (for three and more the leader first), share within the division if all are of one, within the conference,
    difference of points, the team's id. Each round looks at all tied groups of all parts and splits every one."""
    now = table.withColumn("_g", F.rank().over(Window.partitionBy(*part).orderBy(F.desc(_share("wins", "losses")))))
    while True:
        now = cut_lineage(now)
        if now.groupBy(*part, "_g").count().where("count > 1").isEmpty():
            return now.withColumnRenamed("_g", "place")
        mine = now.select(by, "team_id", *[F.col(c).alias(f"_a{i}") for i, c in enumerate([*part, "_g"])])
        theirs = now.select(by, F.col("team_id").alias("opp_id"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate([*part, "_g"])])
        alike = [F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(len(part) + 1)]
        met = meetings.join(mine, [by, "team_id"]).join(theirs, [by, "opp_id"]).where(F.greatest(*[(~a).cast("int") for a in alike]) == 0)
        met = met.groupBy(by, "team_id").agg(F.sum("w").alias("_w"), F.sum("l").alias("_l"))
        tied = Window.partitionBy(*part, "_g")
        rows = now.join(met, [by, "team_id"], "left").withColumns({"_h": _share("_w", "_l"), "_lead": F.col("leader").cast("double"), "_n": F.count("*").over(tied), "_one": F.min("division").over(tied) == F.max("division").over(tied)})
        two = F.col("_n") == 2
        steps = [F.when(two, F.col("_h")).otherwise(F.col("_lead")), F.when(two, F.col("_lead")).otherwise(F.col("_h")), F.when(F.col("_one"), _share("div_wins", "div_losses")).otherwise(0.0), _share("conf_wins", "conf_losses"), F.col("diff").cast("double")]
        rows = rows.withColumns({f"_m{i}": m for i, m in enumerate(steps)})
        value = -F.col("team_id").cast("double")
        for i in reversed(range(len(steps))):
            value = F.when(F.max(f"_m{i}").over(tied) - F.min(f"_m{i}").over(tied) >= 1e-9, F.col(f"_m{i}")).otherwise(value)
        rows = rows.withColumn("_v", value)
        now = rows.withColumn("_g", F.col("_g") + F.rank().over(tied.orderBy(F.desc("_v"))) - 1).select(*table.columns, "_g")


def seeds(side_rows: DataFrame, team_rows: DataFrame, by: str) -> DataFrame:
    """side_rows(by, team_id, opp_id, scored, allowed), no draws, and team_rows(team_id, conference, division) -> (by,
    conference, team_id, wins, losses, leader, place): divisions are ordered first, to know their leaders, then conferences."""
    table = cut_lineage(season_table(side_rows, team_rows, by))
    meetings = cut_lineage(side_rows.groupBy(by, "team_id", "opp_id").agg(F.sum(won()).alias("w"), F.sum(1 - won()).alias("l")))
    first = refined(table.withColumn("leader", F.lit(0)), meetings, [by, "conference", "division"], by)
    led = first.withColumn("leader", (F.col("place") == 1).cast("int")).drop("place")
    return refined(led, meetings, [by, "conference"], by).select(by, "conference", "team_id", "wins", "losses", "leader", "place")
