"""Whitening of embeddings by an exact scatter matrix: modular products over several primes, joined by remainders.

Entries become integers, so the scatter about the mean is an integer matrix and needs no rounding at all: with n
distinct vectors x and their sums S, every y = n*x - S is whole, and the sum of y y' is n^2 times the scatter. Its
entries are too wide for doubles and 64-bit integers, so each partition takes y modulo a few primes below 2^21 and
multiplies blocks of residues in double precision, where a block's products and sums stay below 2^53 and are exact.
Residue matrices of all partitions are summed by Spark, one row for each prime and cell; the Chinese remainder theorem
makes whole numbers of them. How many primes that takes follows from the extremes of y, which are known beforehand, so
the result can't wrap. Only such d x d sums reach the driver, whose size depends on the dimension and never on the rows;
there the covariance's eigenvectors are found in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, table

SCALE, SHIFT = 64, 1_000_000
BLOCK = 2048  # vectors multiplied at once: BLOCK * (2^20)^2 < 2^53, residues being centred
PRIME_BITS = 21
MOST = 16
LONG = 2**63


def primes_below_2_21() -> Iterator[int]:
    """Odd primes below 2^PRIME_BITS, the largest first."""
    for p in range(2**PRIME_BITS - 1, 3, -2):
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            yield p


def enough_primes(bound: int) -> list[int]:
    """Primes whose product is over 2 * bound, so that any whole number within +-bound is told by its remainders."""
    found, product = [], 1
    for p in primes_below_2_21():
        found.append(p)
        product *= p
        if product > 2 * bound:
            return found
    raise ValueError(f"no set of primes spans {bound}")


def whole_numbers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): x little-endian longs floor(SCALE * entry) + SHIFT; without vectors that are null or empty, or hold null or
    non-finite entries or such that no long can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                entries = v.as_py() or ()
                a = np.array([np.nan if e is None else e for e in entries], np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    a = np.floor(a * SCALE)
                out.append((a.astype("<i8") + SHIFT).tobytes() if len(a) and (np.abs(a) < 2.0**62).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "x"])

    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("x", T.BinaryType())])).where("x is not null")


def _longs(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<i8").reshape(len(values), -1)


def sums_and_extremes(fit: DataFrame, dims: int) -> tuple[int, list[int], list[int], list[int]]:
    """fit(x) -> the number of vectors, and by dimension their sum, least and greatest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, least, most = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _longs(batch.column(0))
            n += len(x)
            low += (x & 0xFFFFFFFF).sum(axis=0)  # in two halves, as a sum of longs may be wider than one
            high += (x >> 32).sum(axis=0)
            least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
            most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array([n] * dims), *map(pa.array, (low, high, least, most))], names=["i", "n", "low", "high", "least", "most"])

    found = fit.select("x").mapInArrow(run, "i long, n long, low long, high long, least long, most long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = found.groupBy("i").agg(F.sum("n").alias("n"), wide("low"), wide("high"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("i").collect()
    return rows[0]["n"], [int(r["low"]) + (int(r["high"]) << 32) for r in rows], [r["least"] for r in rows], [r["most"] for r in rows]


def _residues(x: np.ndarray, n: int, total: np.ndarray, p: int) -> np.ndarray:
    """n*x - S modulo p, centred around zero, as doubles."""
    y = ((n % p) * (x % p) - total) % p
    return (y - p * (y > p // 2)).astype(np.float64)


def scatter(fit: DataFrame, n: int, sums: list[int], primes: list[int]) -> list[list[int]]:
    """fit(x) -> the sum of y y' over all of its vectors, y = n*x - S, in whole numbers."""
    dims = len(sums)
    totals = [np.array([s % p for s in sums], np.int64) for p in primes]
    cells = dims * dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [np.zeros((dims, dims), np.int64) for _ in primes]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _longs(batch.column(0).slice(at, BLOCK))
                for k, p in enumerate(primes):
                    y = _residues(x, n, totals[k], p)
                    made[k] = (made[k] + (y.T @ y).astype(np.int64)) % p
        for k in range(len(primes)):
            yield pa.RecordBatch.from_arrays([pa.array([k] * cells, pa.int32()), pa.array(np.arange(cells)), pa.array(made[k].reshape(-1))], names=["k", "cell", "residue"])

    parts = fit.select("x").mapInArrow(run, "k int, cell long, residue long")
    rows = parts.groupBy("k", "cell").agg(F.sum("residue").alias("residue")).collect()
    product = math.prod(primes)
    weights = [product // p * pow(product // p, -1, p) for p in primes]
    joined = [0] * cells
    for r in rows:
        joined[r["cell"]] += r["residue"] % primes[r["k"]] * weights[r["k"]]
    whole = [v % product for v in joined]
    whole = [v - product if 2 * v > product else v for v in whole]
    return [whole[i * dims : (i + 1) * dims] for i in range(dims)]


def projector(scattered: list[list[int]], n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """-> (d x k matrix that whitens, share of the variance of each of the k components). Eigenvalues that are zero to
    double precision have no component. A component's entry of largest size is positive."""
    v = np.array([[s / n**3 for s in row] for row in scattered])  # whole by whole: rounded once
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0.0) * len(v) * np.finfo(float).eps
    k = min(components, int(real.sum()))
    values, vectors = values[:k], vectors[:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    trace = sum(scattered[i][i] for i in range(len(v))) / n**3
    return vectors / np.sqrt(values), values / trace


def _centred(x: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S/n with S/n = base + rest / n, base whole: the difference is of whole numbers and loses nothing."""
    return (x - base).astype(np.float64) - rest / n


def identity_error(fit: DataFrame, n: int, sums: list[int], w: np.ndarray) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, measured on all of its vectors."""
    k = w.shape[1]
    base, rest = np.array([s // n for s in sums]), np.array([float(s % n) for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                z = _centred(_longs(batch.column(0)), n, base, rest) @ w
                made += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(made.reshape(-1))], names=["cell", "value"])

    rows = fit.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    found = np.zeros(k * k)
    for r in rows:
        found[r["cell"]] = r["value"] / n
    return float(np.abs(found.reshape(k, k) - np.eye(k)).max()) if k else 0.0


def whiten(df: DataFrame, components: int = MOST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """df -> (id, component, n, deviation, whitened, explained, identity_error), a row per vector and component.

    Vectors are dropped if they are null or empty, hold null or non-finite entries or such that a long can't hold, or
    are not of the commonest length (the longest of equally common ones). The fit list has equal integer vectors once.
    Components whose variance is zero to double precision have no rows, so a table of equal vectors has none, nor has
    an empty one. Null ids, repeated rows and ties stay rows; other columns are not read, whatever their names. A
    deviation that no long can hold is null. Rows come from the written integers; nothing grows on the driver but d x d.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(c, t) for c, t in zip(("component", "n", "deviation", "whitened", "explained", "identity_error"), (T.IntegerType(), T.LongType(), T.LongType(), *[T.DoubleType()] * 3))])
    rows = materialize(whole_numbers(df, id_col, vec_col), "white-rows")
    common = rows.groupBy(F.length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.length("x") == common["size"])
    dims = common["size"] // 8
    fit = materialize(rows.select("x").distinct(), "white-fit")
    n, sums, least, most = sums_and_extremes(fit, dims)
    widest = max(max(n * m - s, s - n * l) for s, l, m in zip(sums, least, most))
    scattered = scatter(fit, n, sums, enough_primes(max(1, n * widest**2)))
    if not any(scattered[i][i] for i in range(dims)):
        return df.sparkSession.createDataFrame([], schema)
    w, explained = projector(scattered, n, components)
    error = identity_error(fit, n, sums, w)
    forget(fit)
    base, rest = np.array([s // n for s in sums]), np.array([s % n for s in sums])
    narrow = dims * widest**2 < LONG and n * max(map(abs, least + most)) < LONG
    k = w.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, raw = batch.column(0).slice(at, BLOCK), batch.column(1).slice(at, BLOCK)
                x = _longs(raw)
                if narrow:
                    y = n * (x - base) - rest
                    deviation = (y * y).sum(axis=1).tolist()
                else:
                    exact = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x.tolist()]
                    deviation = [d if d < LONG else None for d in exact]
                z = _centred(x, n, base, rest) @ w
                who = pa.array(np.repeat(np.arange(len(x)), k))
                made = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), pa.array(deviation, pa.int64()).take(who)]
                made += [pa.array(z.reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))]
                yield pa.RecordBatch.from_arrays([ids.take(who), *made], names=schema.names)

    return rows.select("id", "x").mapInArrow(run, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """Every valid row of embeddings, whitened: its projections on the 16 components of most variance.

    Null vectors and such with null, non-finite or unholdable entries or of another length are dropped; null ids,
    repeated rows and ties stay; tables without two different vectors give no rows; other columns are not read.
    """
    return whiten(table(spark, sf_dir, "embeddings"))
