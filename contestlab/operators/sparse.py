"""Sparse ridge regressions whose unknowns never leave Spark, and regressors that leave a row's own group out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.session import cut_lineage


def normal_equations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(terms array<struct<c, x>>, y, w) -> (i, j, v) of X'WX and (c, b) of X'Wy.

    Every row is expanded to pairs of its own few terms in its task; both are summed before they are shuffled."""
    one = rows.select(F.explode("terms").alias("a"), "terms", "y", "w")
    gram = one.select("a", F.explode("terms").alias("b"), "w").groupBy(F.col("a.c").alias("i"), F.col("b.c").alias("j")).agg(F.sum(F.col("w") * F.col("a.x") * F.col("b.x")).alias("v"))
    return gram, one.groupBy(F.col("a.c").alias("c")).agg(F.sum(F.col("w") * F.col("a.x") * F.col("y")).alias("b"))


def sparse_ridge(rows: DataFrame, penalties: DataFrame, steps: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """rows(terms array<struct<c string, x double>>, y, w) and penalties(c, penalty, prior) -> (c, prior, effect): what
    minimises the weighted squares of y less the terms' effects, plus penalty * (effect - prior)^2.

    Conjugate gradients with the diagonal as preconditioner: a step is one join of the summed pairs with the unknowns, both
    keyed by term, and two sums on the driver. Steps end when the residual is `tolerance` times the first one; a term
    without rows keeps its prior, and a term without a penalty row has none and prior 0."""
    gram, right = map(cut_lineage, normal_equations(rows))
    terms = right.join(penalties, "c", "full").select("c", F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("penalty", F.lit(0.0)).alias("l"), F.coalesce("prior", F.lit(0.0)).alias("prior"))
    terms = terms.join(gram.where("i = j").select(F.col("i").alias("c"), F.col("v").alias("d")), "c", "left").withColumn("d", F.coalesce("d", F.lit(0.0)) + F.col("l"))

    def times(now: DataFrame, vector: str) -> DataFrame:
        """now with `q`: the penalised normal matrix times the column."""
        product = gram.join(now.select(F.col("c").alias("j"), F.col(vector).alias("_p")), "j").groupBy(F.col("i").alias("c")).agg(F.sum(F.col("v") * F.col("_p")).alias("_q"))
        return now.join(product, "c", "left").withColumn("q", F.coalesce("_q", F.lit(0.0)) + F.col("l") * F.col(vector)).drop("_q")

    z = F.when(F.col("d") > 0, F.col("r") / F.col("d")).otherwise(0.0)
    # From the priors: r is what they leave of X'Wy + penalty * prior.
    now = times(terms.withColumn("x", F.col("prior")), "x").withColumn("r", F.col("b") + F.col("l") * F.col("prior") - F.col("q")).drop("q")
    now = cut_lineage(now.withColumn("p", z))
    left = now.agg(F.sum(F.col("r") * z)).first()[0] or 0.0
    first = left
    for _ in range(steps):
        if left <= tolerance**2 * first:
            break
        stepped = cut_lineage(times(now, "p"))
        along = stepped.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not along or along <= 0:
            break
        alpha = F.lit(left / along)
        stepped = stepped.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("q")})
        before, left = left, stepped.agg(F.sum(F.col("r") * z)).first()[0]
        now = stepped.withColumn("p", z + F.lit(left / before) * F.col("p")).drop("q")
    return now.select("c", "prior", F.col("x").alias("effect"))


def leave_one_out(rows: DataFrame, unit: list[str], group: str, value: Column, weight: Column) -> DataFrame:
    """rows' (unit, group) with `left_out`: the unit's weighted mean of `value` in all its other groups, null if it has
    none; totals less the group's own sums, so nothing is joined with itself."""
    own = rows.groupBy(*unit, group).agg(F.sum(value * weight).alias("_s"), F.sum(weight).alias("_w"))
    every = Window.partitionBy(*unit)
    rest = F.sum("_w").over(every) - F.col("_w")
    return own.select(*unit, group, F.when(rest > 0, (F.sum("_s").over(every) - F.col("_s")) / rest).alias("left_out"))
