"""Linear and logistic models from distributed sums.

Rows never leave Spark: what reaches the driver is a matrix of sums whose size is the number of features, so a fit costs
one aggregate (one per iteration for logistic models) and held-out fits are differences of sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ENTITIES = 6000  # of a paired design, whose normal equations are solved on the driver: 36 million doubles


def moment_sums(rows: DataFrame, group: str, features: list[str], target: str) -> dict[object, np.ndarray]:
    """Per group the symmetric matrix of sums of products of (1, features, target); groups are few (seasons, folds)."""
    names = ["_one", *features, target]
    data = rows.withColumn("_one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = data.groupBy(group).agg(*[F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in got:
        m = np.zeros((len(names), len(names)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        out[r[group]] = m
    return out


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and slopes on features standardised by population deviation; the intercept bears no penalty."""
    n, p = sums[0, 0], len(sums) - 2
    mean = sums[0, 1:-1] / n
    cov = sums[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-12] = 1.0
    xy = sums[1:-1, -1] / n - mean * sums[0, -1] / n
    beta = np.linalg.solve(cov / np.outer(sd, sd) * n + penalty * np.eye(p), xy / sd * n) / sd
    return np.r_[sums[0, -1] / n - mean @ beta, beta]


def squared_error(sums: np.ndarray, coefficients: np.ndarray) -> float:
    """Sum of squared residuals, from the sums alone."""
    v = np.r_[-coefficients, 1.0]
    return float(v @ sums @ v)


def penalty_left_out(sums: dict[object, np.ndarray], penalties: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)) -> tuple[float, dict[float, float]]:
    """The penalty of the least error when each group in turn is predicted from all others (of equal ones the first)."""
    total = sum(sums.values())
    n = total[0, 0]
    loss = {a: sum(squared_error(s, ridge(total - s, a)) for s in sums.values()) / n for a in penalties}
    return min(penalties, key=lambda a: loss[a]), loss


def logistic(rows: DataFrame, features: list[str], target: str, penalty: float = 1e-6, steps: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """Penalised logistic regression by Newton steps, each one aggregate over the rows."""
    names = ["_one", *features]
    data = rows.select(F.lit(1.0).alias("_one"), *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y"))
    b = np.zeros(len(names))
    for _ in range(steps):
        z = sum((F.col(n) * float(c) for n, c in zip(names, b)), F.lit(0.0))
        q = 1.0 / (1.0 + F.exp(-z))
        scored = data.withColumn("_q", q)
        w = F.col("_q") * (1.0 - F.col("_q"))
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        r = scored.agg(*[F.sum((F.col("_q") - F.col("_y")) * F.col(n)) for n in names], *[F.sum(w * F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
        if r[0] is None:
            break
        ridge_on = np.r_[0.0, np.full(len(features), penalty)]
        g = np.array(r[: len(names)]) + ridge_on * b
        h = np.diag(ridge_on + 1e-12)
        for (i, j), v in zip(pairs, r[len(names) :]):
            h[i, j] += v
            if i != j:
                h[j, i] += v
        step = np.linalg.solve(h, g)
        b = b - step
        if np.abs(step).max() < tolerance:
            break
    return b


def paired_effects(stints: DataFrame, plus: str, minus: str, y: str, weight: str, penalty: float) -> DataFrame:
    """Regularised effects of entities from rows with entities for and against: y = sum(for) - sum(against) + constant.

    Every row expands to its pairs of entities inside its task and the normal equations are summed by pair, with partial
    sums before the shuffle; the number of entities is checked before the equations are solved."""
    spark = stints.sparkSession
    signed = F.concat(F.transform(plus, lambda x: F.struct(x.alias("e"), F.lit(1.0).alias("s"))), F.transform(minus, lambda x: F.struct(x.alias("e"), F.lit(-1.0).alias("s"))))
    mean = stints.agg((F.sum(F.col(weight) * F.col(y)) / F.sum(weight)).alias("m")).first()["m"] or 0.0
    rows = stints.select(signed.alias("t"), (F.col(y) - F.lit(float(mean))).alias("y"), F.col(weight).cast("double").alias("w"))
    one = rows.select(F.explode("t").alias("a"), "t", "y", "w")
    right = one.groupBy(F.col("a.e").alias("e")).agg(F.sum(F.col("a.s") * F.col("w") * F.col("y")).alias("v"))
    entities = [r["e"] for r in right.select("e").orderBy("e").limit(MOST_ENTITIES + 1).collect()]
    if len(entities) > MOST_ENTITIES:
        raise ValueError(f"more than {MOST_ENTITIES} entities")
    at = {e: i for i, e in enumerate(entities)}
    both = one.select("a", F.explode("t").alias("b"), "w").groupBy(F.col("a.e").alias("i"), F.col("b.e").alias("j")).agg(F.sum(F.col("a.s") * F.col("b.s") * F.col("w")).alias("v"))
    m, r = np.eye(len(entities)) * penalty, np.zeros(len(entities))
    for x in both.toLocalIterator():
        m[at[x["i"]], at[x["j"]]] += x["v"]
    for x in right.toLocalIterator():
        r[at[x["e"]]] = x["v"]
    beta = np.linalg.solve(m, r) if len(entities) else r
    kind = stints.schema[plus].dataType.elementType.simpleString()
    return spark.createDataFrame([(e, float(b)) for e, b in zip(entities, beta)], f"entity {kind}, effect double")


def monotone(values: list[float], weights: list[float]) -> list[float]:
    """The nearest non-decreasing sequence in weighted squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total if total else a[0], total, a[2] + b[2]])
    return [v for v, _, n in blocks for _ in range(int(n))]
