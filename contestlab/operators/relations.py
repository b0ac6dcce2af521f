"""Relational shapes that contests need: intervals, versions, fill-down, tie-breaks and bounded shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


ROWS_A_TASK = 500_000  # rows of one task where sorts and sums of all rows are held together


def dealt(rows: DataFrame, keys: list[str], rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """rows shuffled by keys into as many partitions as leave a task about rows_a_task rows, so that what a task holds does
    not grow with the table; unchanged where the session's number of partitions does that. Rows are counted, which for a
    table read as it is takes its files' footers."""
    n = -(-rows.count() // rows_a_task)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def within_interval(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points with the spans of their key that hold them, ends included: spans name their days, so it is an equality
    join on key and day, whatever the number of spans of a key."""
    days = spans.withColumn("_day", F.explode(F.sequence(F.col(start), F.col(end)))).where(F.col(start) <= F.col(end))
    return points.withColumn("_day", F.col(at)).join(days, [*by, "_day"]).drop("_day")


def newest(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left, and rows of right whose keys left lacks."""
    return left.unionByName(right.join(left.select(*keys).distinct(), keys, "left_anti"))


def fill_down(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Nulls take the last value before them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def break_ties(table: DataFrame, games: DataFrame, group: str, team: str) -> DataFrame:
    """table(group, team, wins, losses, diff) ranked by share of wins, then by the share of wins in games among the teams
    tied, then by differential, then by team. Head to head is one aggregate of games between teams of one tie."""
    share = F.floor(F.col("wins") / F.greatest(F.col("wins") + F.col("losses"), F.lit(1)) * 1e9)
    t = table.withColumn("_share", share)
    a = t.select(group, F.col(team).alias("team_id"), F.col("_share"))
    b = t.select(group, F.col(team).alias("opp_id"), F.col("_share").alias("_other"))
    met = games.join(a, [group, "team_id"]).join(b, [group, "opp_id"]).where("_share = _other")
    head = met.groupBy(group, F.col("team_id").alias(team)).agg(F.avg((F.col("scored") > F.col("allowed")).cast("double")).alias("head_to_head"))
    order = Window.partitionBy(group).orderBy(F.desc("_share"), F.desc(F.coalesce("head_to_head", F.lit(0.5))), F.desc("diff"), team)
    return t.join(head, [group, team], "left").withColumn("seed", F.row_number().over(order)).drop("_share")


def bounded_shares(rows: DataFrame, group: str, weight: str, tie: str, total: float, most: float) -> DataFrame:
    """`total` shared by weight with nobody above `most`, the excess reshared: in falling order of weight the first ones
    are full, and the first at which the level falls below the limit fixes it for all that follow."""
    down = Window.partitionBy(group).orderBy(F.desc(weight), tie)
    full = F.row_number().over(down) - 1
    left = F.sum(weight).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.try_divide(F.lit(total) - full * F.lit(most), left)
    r = rows.withColumn("_level", level).withColumn("_ok", F.col("_level") * F.col(weight) <= most)
    first = F.first(F.when(F.col("_ok"), F.col("_level")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return r.withColumn("_found", first).withColumn("share", F.least(F.lit(most), F.coalesce(F.col("_found") * F.col(weight), F.lit(most)))).drop("_level", "_ok", "_found")
