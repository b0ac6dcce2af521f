"""Nearest neighbours by multiprobe p-stable hashing.

A table hashes a unit vector with M functions floor((a.u + b) / WIDTH), a Gaussian; the functions of the tables that
share a basis are orthogonal. M grows by one as the vectors grow eightfold, so the share of all vectors that a query
visits falls while its buckets, whose number grows with M, stay few. A query visits the buckets around its own in falling order of their
estimated success, the chance that a neighbour at distance `reach` has moved there (a product of Gaussian intervals),
until the visited buckets hold the chance SUCCESS in each of TABLES tables. `reach` is measured: the mean distance of
the k-th neighbour of SAMPLE vectors. What the tables find is merged and ranked by exact cosine; queries that found
fewer than k are searched again in blocks against all vectors.

Buckets lie in parts, a crowded bucket in several; a query is sent once to each part that may hold one of its buckets,
and only the members of these are compared, a bucket with all its queries at once: in single precision, and what may be
among a query's nearest again in double precision. One table and QUERIES queries are searched at a time and leave only
these queries' nearest, so that the disk holds one copy of the vectors for one table, not for all. Equal vectors are
one, known by 128 bits of hashes, with their k + 1 smallest ids, which is all that a result of k can need.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, shuffles_deleted, table
from .vectors import as_rows, common_length, directions, matrix, norms, number_type

TABLES, WIDTH, SUCCESS = 8, 2.5, 0.26
MOST_FUNCTIONS = 20
SAMPLE = 64  # vectors whose neighbours' distance is measured, against all
PARTS, PART, CHUNK = 16, 1 << 17, 1 << 12  # parts at least, members of a part and of a bucket in one part at most
QUERIES = 1 << 17  # searched in one pass
PAIRS = 1 << 16  # compared at once in double precision
BLOCK = 1 << 21  # pairs compared at once in single precision
WAITING, LEAST_WAITING = 16, 1 << 16  # pairs that wait to be ranked: for each query, and in all at least
UNSURE = 1e-4  # more than single precision errs by


@cache
def moves(functions: int) -> np.ndarray:
    """All moves by -1, 0 or 1 in so many functions."""
    return np.array(list(itertools.product((0, 1, -1), repeat=functions)), np.int64).reshape(3**functions, functions)


class Tables:
    def __init__(self, dim: int, rows: int, reach: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.m = max(1, min(dim, MOST_FUNCTIONS, round(8 + math.log2(max(2, rows)) / 3)))
        bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T * math.sqrt(dim) for _ in range(-(-TABLES // (dim // self.m)))]
        rows_of = np.concatenate([b[: dim // self.m * self.m] for b in bases])
        self.a = rows_of[: TABLES * self.m].reshape(TABLES, self.m, dim)
        self.b = rng.uniform(0, WIDTH, (TABLES, self.m))
        self.reach = max(reach, 1e-3)

    def project(self, u: np.ndarray, t: int) -> np.ndarray:
        return (u @ self.a[t].T + self.b[t]) / WIDTH

    def number(self, floors: np.ndarray, t: int) -> np.ndarray:
        """One number for each bucket of a table (two that share one are visited together)."""
        out = np.full(floors.shape[:-1], t + 1, np.uint64)
        for i in range(self.m):
            out = (out ^ floors[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)

    def probes(self, x: np.ndarray, t: int) -> np.ndarray:
        """The buckets to visit for one projected query, the likeliest first."""
        home = np.floor(x)
        f = x - home
        tail = np.vectorize(lambda z: math.erf(z * WIDTH / self.reach / math.sqrt(2)) / 2, otypes=[float])
        stay, up, down = tail(1 - f) + tail(f), tail(2 - f) - tail(1 - f), tail(1 + f) - tail(f)
        logs = np.log(np.maximum(np.stack([stay, up, down]), 1e-300))
        halves = []
        for some in np.array_split(np.arange(self.m), 2):
            steps = moves(len(some))
            chance = logs[steps, some].sum(axis=1) if len(some) else np.zeros(1)
            order = np.argsort(-chance, kind="stable")
            order = order[chance[order] > chance[order[0]] - 12]
            halves.append((chance[order], steps[order]))
        (first, one), (second, two) = halves
        mass, rising, likely = np.r_[0, np.cumsum(np.exp(second))], -second, np.exp(first)
        reached = lambda least: np.searchsorted(rising, first - least, side="right")
        low, high = first[-1] + second[-1], first[0] + second[0]
        if (likely * mass[reached(low)]).sum() > SUCCESS:
            for _ in range(14):
                middle = (low + high) / 2
                low, high = (middle, high) if (likely * mass[reached(middle)]).sum() >= SUCCESS else (low, middle)
        counts = reached(low)
        i = np.repeat(np.arange(len(first)), counts)
        j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.argsort(-(first[i] + second[j]), kind="stable")
        return self.number(home + np.concatenate([one[i[order]], two[j[order]]], axis=1), t)


def _measured_reach(distinct: DataFrame, k: int, numbers: str) -> float:
    """The mean distance from SAMPLE vectors, chosen by a hash, to the k-th nearest of all distinct others."""
    picked = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()["v"]
    if len(picked) < 2:
        return 1.0
    sample = directions(np.frombuffer(b"".join(picked), numbers).reshape(len(picked), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.empty((len(sample), 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                s = sample @ directions(matrix(batch.column(0).slice(at, 4096), numbers)).T
                best = -np.sort(-np.concatenate([best, np.where(s > 1 - 1e-12, -2, s)], axis=1), axis=1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sample)), best.shape[1])), pa.array(best.ravel())], names=["i", "s"])

    found = distinct.select("v").mapInArrow(run, "i long, s double")
    order = Window.partitionBy("i").orderBy(F.desc("s"))
    mean = found.withColumn("n", F.row_number().over(order)).where((F.col("n") == k) & (F.col("s") > -2)).agg(F.avg(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))))).first()[0]
    return float(mean) if mean else 1.0


FOUND = "qnode long, node long, score double"


def _nearest_found(k: int, q: np.ndarray, m: np.ndarray, meetings: Iterator[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, cosine) of each query's k + 1 nearest members, ties included, of those it meets: in meetings,
    (queries, first, last), each of these queries meets the members from first to before last."""
    u, w = directions(q).astype(np.float32), directions(m).astype(np.float32)
    least = np.full(len(q), -2, np.float32)  # what a member must reach to be among a query's nearest
    held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
    waiting = 0

    def ranked(s: np.ndarray, who: np.ndarray, member: np.ndarray, within: float):
        order = np.argsort(4.0 * who - s) if s.dtype == np.float32 else np.lexsort((-s, who))
        s, who, member = s[order], who[order], member[order]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.empty(0, np.int64)
        ends = np.r_[starts[1:], len(who)]
        last = s[np.minimum(starts + k, ends - 1)]
        full = ends - starts > k
        least[who[starts[full]]] = last[full] - within
        kept = s >= np.repeat(np.where(full, last - within, -2), ends - starts)
        return who[kept], member[kept], s[kept]

    for some, first, last in meetings:
        step = max(1, BLOCK // max(1, last - first))
        for at in range(0, len(some), step):
            who = some[at : at + step]
            s = u[who] @ w[first:last].T
            i, j = np.nonzero(s >= least[who][:, None])
            held.append((who[i], first + j, s[i, j]))
            waiting += len(i)
            if waiting > max(LEAST_WAITING, WAITING * len(q)):
                who, member, s = (np.concatenate(x) for x in zip(*held))
                held, waiting = [ranked(s, who, member, UNSURE)], 0
    who, member, s = (np.concatenate(x) for x in zip(*held))
    who, member, s = ranked(s, who, member, UNSURE)
    qn, mn = norms(q), norms(m)
    exact = np.empty(len(who))
    for at in range(0, len(who), PAIRS):
        a, b = who[at : at + PAIRS], member[at : at + PAIRS]
        exact[at : at + PAIRS] = np.einsum("ij,ij->i", q[a].astype(np.float64), m[b].astype(np.float64)) / (qn[a] * mn[b])
    return ranked(exact, who, member, 1e-12)


def _meetings(bucket: np.ndarray, lists: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Of members sorted by bucket and of each query's list of buckets."""
    lists = lists.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    wanted, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    known, first = np.unique(bucket, return_index=True)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    there = known[at] == wanted
    at, owner = at[there], owner[there]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    ends, cuts = np.r_[first[1:], len(bucket)], np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
    for i, x in enumerate(cuts):
        yield owner[x : cuts[i + 1] if i + 1 < len(cuts) else len(owner)], int(first[at[x]]), int(ends[at[x]])


def _table(qnode, node, who: np.ndarray, member: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"qnode": pa.array(qnode[who]), "node": pa.array(node[member]), "score": pa.array(score)})


NONE = pa.table({"qnode": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def _mixed(x: np.ndarray, y) -> np.ndarray:
    x = (x.astype(np.int64).view(np.uint64) ^ (np.asarray(y).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def nearest(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query(id) holds, the k nearest others found, by cosine;
    all others, if there are no more than k.

    Ties go to the smaller id. Vectors that are null, zero or not finite, or of another length than most, take no
    part, nor do null ids as queries; a null id as a neighbour comes last among equals. Repeated rows are rows of
    their own: a query only leaves out its own row. Other columns are ignored. An empty input gives an empty result.
    """
    with shuffles_deleted(df.sparkSession):
        return _nearest(df, is_query, k, id_col, vec_col)


def _nearest(df: DataFrame, is_query, k: int, id_col: str, vec_col: str) -> DataFrame:
    base = materialize(as_rows(df, id_col, vec_col), "ann-vectors")
    numbers, length = number_type(df, vec_col), common_length(base)
    good = base.where((F.length("v") == length) & (F.length("v") > 0))
    keys = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v", F.lit(2)).alias("h2")]
    order = F.col("id").asc_nulls_last(), F.col("rid")
    salted = Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("rid"), F.lit(64))).orderBy(*order)
    equal = Window.partitionBy("h1", "h2").orderBy(*order)
    rows = good.select("id", "rid", *keys).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    rows = rows.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1).withColumn("node", F.first("rid").over(equal))
    rows = materialize(rows.select("node", "rid", "id", "h1", "h2"), "ann-rows")  # a node is the row that stands for its equals
    distinct = materialize(good.select(F.col("rid").alias("node"), "v").join(rows.where("rid = node").select("node"), "node"), "ann-distinct")
    asked = good.where(is_query(F.col("id"))).select("id", "rid", *keys).join(rows.where("rid = node").select("node", "h1", "h2"), ["h1", "h2"])
    asked = materialize(asked.select(F.col("node").alias("qnode"), F.col("rid").alias("qrid"), F.col("id").alias("query_id")), "ann-asked")
    queries = materialize(distinct.join(asked.select(F.col("qnode").alias("node")).distinct(), "node").select("node", "v"), "ann-queries")
    count, others, n_queries = distinct.count(), good.count() - 1, queries.count()
    forget(base)
    tables = Tables(max(1, length // np.dtype(numbers).itemsize), count, _measured_reach(distinct, k, numbers))
    parts, chunk = max(PARTS, -(-count // PART)), min(CHUNK, max(64, count // 64))
    slices = max(1, -(-n_queries // QUERIES))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = directions(matrix(batch.column(0), numbers))
            for t in range(TABLES) if len(u) else ():
                yield pa.RecordBatch.from_arrays([pa.array(tables.number(np.floor(tables.project(u, t)), t))], names=["bucket"])

    # Of TABLES * count rows, at most one in CHUNK is a crowded bucket's.
    sizes = distinct.select("v").mapInArrow(buckets, "bucket long").groupBy("bucket").count().where(F.col("count") > chunk).orderBy("bucket").toPandas()
    crowded, chunks = sizes["bucket"].to_numpy(np.int64), -(-sizes["count"].to_numpy(np.int64) // chunk)

    def chunks_of(bucket: np.ndarray) -> np.ndarray:
        if not len(crowded):
            return np.ones(len(bucket), np.int64)
        at = np.minimum(np.searchsorted(crowded, bucket), len(crowded) - 1)
        return np.where(crowded[at] == bucket, chunks[at], 1)

    def part_of(bucket: np.ndarray, which: np.ndarray) -> np.ndarray:
        return (_mixed(bucket, which) % np.uint64(parts)).astype(np.int64)

    def index(t: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bucket = tables.number(np.floor(tables.project(directions(matrix(batch.column(1), numbers)), t)), t)
                    which = _mixed(batch.column(0).to_numpy(), 1) % chunks_of(bucket).astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(part_of(bucket, which)), pa.array(bucket), *batch.columns], names=["part", "bucket", "node", "v"])

        return run

    def visit(t: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    some = batch.slice(at, 64)
                    found = [tables.probes(x, t) for x in tables.project(directions(matrix(some.column(1), numbers)), t)]
                    who, bucket = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
                    many = chunks_of(bucket)
                    who, bucket = np.repeat(who, many), np.repeat(bucket, many)
                    part = part_of(bucket, np.arange(len(bucket)) - np.repeat(np.cumsum(many) - many, many))
                    order = np.lexsort((bucket, part, who))
                    who, part, bucket = who[order], part[order], bucket[order]
                    starts = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (part[1:] != part[:-1])])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(who)], pa.int32()), pa.array(bucket))
                    sent = [c.take(pa.array(who[starts])) for c in some.columns]
                    yield pa.RecordBatch.from_arrays([pa.array(part[starts]), *sent, lists], names=["part", "qnode", "q", "buckets"])

        return run

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return NONE
        right = right.sort_by("bucket")
        bucket, q, m = right["bucket"].to_numpy(), matrix(left["q"], numbers), matrix(right["v"], numbers)
        return _table(left["qnode"].to_numpy(), right["node"].to_numpy(), *_nearest_found(k, q, m, _meetings(bucket, left["buckets"])))

    def best(found: DataFrame) -> DataFrame:
        """Each query's k + 1 nearest vectors, ties included."""
        found = found.groupBy("qnode", "node").agg(F.max("score").alias("score"))
        return found.withColumn("n", F.rank().over(Window.partitionBy("qnode").orderBy(F.desc("score")))).where(F.col("n") <= k + 1).drop("n")

    def ranked(found: DataFrame, who: DataFrame) -> DataFrame:
        """For the rows `who` (qnode, qrid, query_id), what is found for their vectors as rows."""
        pairs = who.join(found, "qnode").join(rows.select("node", "rid", F.col("id").alias("vec_id")), "node").where("rid <> qrid")
        order = Window.partitionBy("qrid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rid")
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qrid", "query_id", "rank", "vec_id", "score")

    found = []
    for now in range(slices):
        some = queries.where(F.pmod(F.xxhash64("node"), F.lit(slices)) == now)
        for t in range(TABLES):
            visits = some.mapInArrow(visit(t), "part long, qnode long, q binary, buckets array<long>")
            members = distinct.mapInArrow(index(t), "part long, bucket long, node long, v binary")
            found.append(materialize(best(visits.groupBy("part").cogroup(members.groupBy("part")).applyInArrow(compare, FOUND)), "ann-found"))
    found = reduce(DataFrame.union, found)
    result = materialize(ranked(best(found), asked), "ann-result", k * asked.count())

    # Queries with too few found meet all vectors, in blocks.
    held = result.groupBy("qrid").agg(F.count("*").alias("n"))
    short = materialize(asked.join(held, "qrid", "left").where(F.coalesce("n", F.lit(0)) < min(k, max(0, others))).drop("n"), "ann-short")
    few = short.count()
    if few:
        blocks, pieces = -(-few // QUERIES), -(-count // PART)
        left = queries.join(short.select(F.col("qnode").alias("node")).distinct(), "node")
        left = left.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        right = distinct.withColumn("piece", F.pmod(F.xxhash64("node"), F.lit(pieces)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

        def exact(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return NONE
            every = ((np.arange(left.num_rows), at, min(at + CHUNK, right.num_rows)) for at in range(0, right.num_rows, CHUNK))
            return _table(left["node"].to_numpy(), right["node"].to_numpy(), *_nearest_found(k, matrix(left["v"], numbers), matrix(right["v"], numbers), every))

        again = best(left.groupBy("block", "piece").cogroup(right.groupBy("block", "piece")).applyInArrow(exact, FOUND))
        result = result.join(short, "qrid", "left_anti").union(materialize(ranked(again, short), "ann-again", k * few))
    forget(distinct, queries)
    return result.select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, among all others.

    Null, zero and non-finite vectors and those of another length take no part, nor null ids as queries; ties go to the
    smaller id; repeated rows are rows of their own; an empty table gives an empty result; other columns are not read.
    """
    found = nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
    return found.select(F.col("query_id").cast("long").alias("query_id"), "rank", "vec_id", "score")
