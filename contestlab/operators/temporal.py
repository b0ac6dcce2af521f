"""As-of joins, sessions, decayed sums and ledger folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], tie: str, max_age: Column | None = None) -> DataFrame:
    """Each left row with the latest right row at or before its instant (backward as-of join).

    Both sides are laid in one sequence per key and the last right row is carried forward: one shuffle on the key, no
    product of rows. `tie` orders right rows of one instant. Right rows older than max_age (an interval) don't count."""
    r = right.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(F.col(at).alias("at"), *values).alias("_r"))
    packed = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), packed.alias("_l"))  # noqa: E741
    both = r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)).unionByName(l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)))
    order = Window.partitionBy(*by).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_f", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    if max_age is not None:
        found = found.withColumn("_f", F.when(F.col("_f.at") >= F.col("_at") - max_age, F.col("_f")))
    return found.select("_l.*", F.col("_f.at").alias(f"{at}_found"), *[F.col(f"_f.{v}").alias(v) for v in values])


def in_force(rows: DataFrame, steps: list[tuple[str, int]], at: str) -> Column:
    """The step in force at an instant, from a short list of (since, number) in order; null before the first."""
    out = F.lit(None).cast("int")
    for since, number in steps:
        out = F.when(F.col(at) >= F.lit(since).cast("timestamp_ntz"), F.lit(number)).otherwise(out)
    return out


def sessions(rows: DataFrame, key: str, at: str, tie: str, gap_seconds: int) -> DataFrame:
    """rows with `session`: a new one after a pause of more than gap_seconds."""
    order = Window.partitionBy(key).orderBy(at, tie)
    pause = F.timestamp_diff("SECOND", F.lag(at).over(order), F.col(at))
    return rows.withColumn("session", F.sum(F.coalesce((pause > gap_seconds).cast("long"), F.lit(0))).over(order))


def decayed(rows: DataFrame, key: str, order: list[str], weight: str, value: str, half_life: float) -> DataFrame:
    """The sum of `value` with a half-life in units of `weight` passed since, after the last row of each key.

    In closed form: each row counts by two to the minus (all weight less its own cumulative weight) / half_life."""
    w = Window.partitionBy(key).orderBy(*order)
    passed = F.sum(weight).over(Window.partitionBy(key)) - F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_f", F.pow(F.lit(0.5), passed / F.lit(half_life))).groupBy(key).agg(F.sum(F.col(value) * F.col("_f")).alias("decayed_value"), F.sum(F.col(weight) * F.col("_f")).alias("decayed_weight"))


PRIORITY = {"final": 0, "reissued": 1, "morning": 2}


def ledger_scores(rows: DataFrame) -> DataFrame:
    """One forecast and one result for each game: the seal of the best kind, first appended; the result last appended.

    Games without a result are pending, those without a seal are missed if the ledger says so, else absent."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("entry")], F.lit(None))
    return rows.groupBy("game").agg(
        F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "ord", "p", "entry"))).alias("seal"),
        F.max(F.when(F.col("entry") == "result", F.struct("ord", "won"))).alias("result"),
        F.count(F.when(F.col("entry") == "result", 1)).alias("results"),
        F.max((F.col("entry") == "missed").cast("int")).alias("missed"),
    )
