"""Forecast evaluation: slices, calibration, decomposition, refitted calibration and bootstraps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.functions.scoring import accuracy, brier, clamp, log_loss
from contestlab.session import cut_lineage


def scores(p: str = "p", y: str = "y") -> list:
    return [F.count("*").alias("n"), brier(F.col(p), F.col(y)).alias("brier"), log_loss(F.col(p), F.col(y)).alias("log_loss"), accuracy(F.col(p), F.col(y)).alias("accuracy")]


def equal_width(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Calibration by bins of equal width; empty bins stay, the last one is closed."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    got = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(got), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # at most `bins` rows


def equal_count(rows: DataFrame, bins: int = 10, order: str = "p", tie: str = "id") -> DataFrame:
    """rows with `bin`: bin boundaries at floor(i * n / bins) in order of (order, tie).

    Global ranks without one task: rows are range-partitioned by the order and ranked inside ranges; the ranges' sizes
    (a row each) are summed before. Ranges are drawn by sampling, so they are written once and read twice."""
    rows = cut_lineage(rows.repartitionByRange(F.col(order), F.col(tie)).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(order, tie)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min(order).alias("_lo"))
    before = Window.orderBy("_lo", "_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_first") + F.row_number().over(inside)
    return rows.join(sizes, "_part").withColumn("bin", F.floor((rank * bins - 1) / F.col("_all")).cast("int")).drop("_part", "_first", "_all")


def murphy(binned: DataFrame) -> DataFrame:
    """Uncertainty, resolution, reliability and what they leave of the Brier score."""
    cells = binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("se"))
    every = Window.partitionBy()  # one row per bin
    total, base = F.sum("n").over(every), F.sum("sy").over(every) / F.sum("n").over(every)
    c = cells.withColumns({"_t": total, "_b": base})
    part = lambda x: F.sum(F.col("n") * x * x) / F.first("_t")
    out = c.agg(
        F.first("_t").alias("n"), (F.sum("se") / F.first("_t")).alias("brier"), (F.first("_b") * (1.0 - F.first("_b"))).alias("uncertainty"),
        part(F.col("sy") / F.col("n") - F.col("_b")).alias("resolution"), part(F.col("sp") / F.col("n") - F.col("sy") / F.col("n")).alias("reliability"),
    )
    return out.withColumn("residual", F.col("brier") - (F.col("uncertainty") - F.col("resolution") + F.col("reliability")))


def newton_calibration(rows: DataFrame, steps: int = 8, floor: float = 1e-6) -> tuple[float, float]:
    """Slope and intercept of the outcome's logit on the forecast's, each Newton step one aggregate of five sums."""
    x = F.ln(clamp(F.col("p"), floor) / (1.0 - clamp(F.col("p"), floor)))
    data = rows.select(x.alias("x"), F.col("y").cast("double").alias("y"))
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1.0 / (1.0 + F.exp(-(F.col("x") * a + b)))
        w = q * (1.0 - q)
        r = data.agg(F.sum((q - F.col("y")) * F.col("x")), F.sum(q - F.col("y")), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w)).first()
        if r[0] is None:
            break
        det = r[2] * r[4] - r[3] * r[3]
        if abs(det) < 1e-12:
            break
        step = (r[4] * r[0] - r[3] * r[1]) / det, (r[2] * r[1] - r[3] * r[0]) / det
        a, b = a - step[0], b - step[1]
        if max(map(abs, step)) < 1e-10:
            break
    return a, b


# From which uniform number on a Poisson draw of mean one is at least 1, 2, ...
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k)) for k in range(1, 11))
CUTS = tuple(f"{math.ceil(p * 2.0**32):08x}" for p in POISSON)  # the same as eight hexadecimal digits of u * 2^32
PIECES = 4  # draws that one digest serves


def poisson_times(digits: Column) -> Column:
    """How often a cluster stands in a draw, by eight hexadecimal digits: equal lengths compare as the numbers do."""
    times = F.when(digits < CUTS[0], 0)
    for k, cut in enumerate(CUTS[1:], 1):
        times = times.when(digits < cut, k)
    return times.otherwise(len(CUTS))


def bootstrap_sums(rows: DataFrame, cluster: str, sums: dict[str, Column], draws: int = 1000, seed: int = 17) -> DataFrame:
    """rows -> (draw, *sums): each draw's sums over clusters drawn with replacement.

    A cluster stands in a draw as often as a Poisson number of mean one says, taken from a digest of the seed, the cluster
    and the draw, so clusters are drawn independently, in any number and by any engine alike. They collapse to their sums
    first and are dealt over all tasks, since their draws are the work, however few bytes they are. A task keeps one row of
    sums for each digest's draws, and those are what is shuffled. A draw without clusters has no row."""
    each = rows.groupBy(cluster).agg(*[F.sum(v.cast("double")).alias(n) for n, v in sums.items()])
    context = rows.sparkSession.sparkContext
    each = each.repartition(max(4 * context.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), cluster)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(cluster).cast("string"), "part"))
    told = each.select("*", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // PIECES))).alias("part")).select(*sums, "part", digest.alias("digest"))
    pieces = [poisson_times(F.substring("digest", 8 * i + 1, 8)).alias(f"times{i}") for i in range(PIECES)]
    parts = told.select(*sums, "part", *pieces).groupBy("part").agg(
        *[F.sum(f"times{i}").alias(f"times{i}") for i in range(PIECES)],
        *[F.sum(F.when(F.col(f"times{i}") > 0, F.col(f"times{i}") * F.col(n))).alias(f"{n}{i}") for n in sums for i in range(PIECES)],
    )
    drawn = parts.select(F.explode(F.array(*[
        F.struct((F.col("part") * PIECES + i).alias("draw"), F.col(f"times{i}").alias("times"), *[F.col(f"{n}{i}").alias(n) for n in sums]) for i in range(PIECES)
    ])).alias("d"))
    return drawn.select("d.*").where(f"times > 0 AND draw < {draws}").drop("times")


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, draws: int = 1000, seed: int = 17) -> DataFrame:
    """Mean of `value` with the 2.5 and 97.5 % points of its bootstrap over clusters."""
    drawn = bootstrap_sums(rows, cluster, {"s": F.col(value), "n": F.lit(1)}, draws, seed).select((F.col("s") / F.col("n")).alias("m"))
    ranked = drawn.agg(F.sort_array(F.collect_list("m")).alias("all"))  # one number per draw
    point = rows.agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count_distinct(cluster).alias("clusters"))
    at = lambda k: F.try_element_at("all", k.cast("int"))
    low, high = F.floor(F.size("all") * 0.025) + 1, F.ceil(F.size("all") * 0.975)
    return point.join(F.broadcast(ranked)).select("clusters", "mean", at(low).alias("low"), at(high).alias("high"))  # one row each


def ratio_bootstrap(rows: DataFrame, cluster: str, error: str, other: str, bar: float = 1.0, draws: int = 1000, seed: int = 17) -> DataFrame:
    """(ratio, low, median, high, share_at_or_below): root mean squared `error` over that of `other`, its interpolated 2.5,
    50 and 97.5 % points over draws of clusters, and how many draws are no higher than `bar`."""
    squares = {"a": F.pow(F.col(error), F.lit(2)), "b": F.pow(F.col(other), F.lit(2))}
    drawn = bootstrap_sums(rows, cluster, squares, draws, seed).where("b > 0").select(F.sqrt(F.col("a") / F.col("b")).alias("r"))
    ranked = drawn.agg(*[F.percentile("r", p).alias(n) for n, p in (("low", 0.025), ("median", 0.5), ("high", 0.975))], F.avg((F.col("r") <= bar).cast("double")).alias("share_at_or_below"))
    point = rows.agg(F.sqrt(F.sum(squares["a"]) / F.sum(squares["b"])).alias("ratio"))
    return point.join(F.broadcast(ranked))  # one row each


def seeded_folds(rows: DataFrame, group: str, folds: int, seed: int = 17) -> DataFrame:
    """(group, fold): the distinct groups in the order of a seeded digest, dealt in turn, so folds differ by one group at
    most and depend on the set of groups alone. Places are counted by digest prefix: no task orders all groups."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))
    each = rows.select(group).distinct().select(group, digest.alias("_d")).withColumn("_p", F.substring("_d", 1, 3))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each of 4096 prefixes
    firsts = each.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_d", group)) - 1 + F.col("_first")
    return each.join(F.broadcast(firsts), "_p").select(group, (place % folds).cast("int").alias("fold"))
