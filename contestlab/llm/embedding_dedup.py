"""Embedding near-duplicates with an inverted multi-index.

Unit vectors are cut in halves and each half has its own codebook, so cells form a product grid of two small lists. A
vector belongs to the cell of its nearest codewords. Looking for its links it visits cells by the multi-sequence
order: the cost of a cell is the sum, over halves, of the squared distance to the codeword's own region (bounded from
below by the distance to the plane halfway to it), and cells are visited from the cheapest up. It stops at the cost by
which the target share of neighbours just inside the threshold has been met, measured on a sample moved in random
directions. What the visited cells hold is compared in blocks, in single precision where that decides and in double
precision near the threshold.

Of two cells one is ahead of the other, and a vector visits its own cell and those ahead, so a pair meets once and
counts for both. Nothing visited is written: the blocks, each of a cell's members with some of its visitors, are dealt
over passes, and a pass sends PASS_ROWS rows for each vector, whatever their number, and deletes them when it is over.
No pairs leave a task: only counts, and for each vector the least of those it is connected to inside the task. Equal
vectors are one vector with a multiplicity. A crowded cell is dealt over blocks of vectors and of visitors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, shuffles_deleted, table
from .graph import components
from .vectors import as_rows, directions, matrix, norms, number_type

TARGET = 0.999  # recall at the threshold itself
SAMPLE_PER_WORD, LEAST_SAMPLE = 64, 4096  # vectors that the codebooks are fitted on: 16,384 at most
MOVES = 16  # of each, to measure the cost that meets the target
PER_CELL = 2048  # distinct vectors, on average; so codebooks grow as the square root of the vectors
WORDS = 256  # at most, in a half: reached at PER_CELL * WORDS ** 2, 134 million vectors; then cells grow
MEMBERS, VISITORS = 4096, 16_384  # of a cell in one block
PASS_ROWS, LEAST_PASS = 2, 1 << 18  # rows of blocks sent in one pass: so many for each vector, or so many in all
ROWS = 1024  # of a sample or batch against all codewords at once
VISITORS_AT_ONCE = 256  # of a block against all its members
PAIRS = 1 << 16  # compared at once in double precision
FEW, SENT = 256, 8192  # rows whose visits are found at once, rows sent in one batch
HOME, OWN, AHEAD = 0, 1, 2  # a row of a block: a member of its cell, the same as a visitor, a visitor from elsewhere


def _near(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The nearest codeword of each row, a block of rows at a time."""
    square = (words**2).sum(1)
    return np.concatenate([np.empty(0, np.int64), *(np.argmin(square[None, :] - 2 * x[at : at + ROWS] @ words.T, axis=1) for at in range(0, len(x), ROWS))])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    words = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _near(x, words)
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        words[found] = np.add.reduceat(x[order], first) / np.diff(np.r_[first, len(x)])[:, None]
    return words


class Grid:
    """Two codebooks and the cost up to which cells are visited."""

    def __init__(self, sample: np.ndarray, threshold: float, target: float, words: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        u = directions(sample)
        self.cut = max(1, u.shape[1] // 2)
        self.k = int(min(WORDS, words, max(1, len(u) // 2)))
        self.words = [kmeans(x, self.k, rng) for x in self.halves(u)]
        met = [np.zeros(0)]
        for at in np.repeat(np.arange(0, len(u), ROWS), MOVES):
            part = u[at : at + ROWS]
            aside = rng.standard_normal(part.shape)
            aside -= (aside * part).sum(1)[:, None] * part
            aside /= np.maximum(np.sqrt((aside**2).sum(1)), 1e-12)[:, None]
            cell = self.cell(threshold * part + np.sqrt(1 - threshold**2) * aside)
            first, second = self.costs(part)
            row = np.arange(len(part))
            met.append(first[row, cell // self.k] + second[row, cell % self.k])
        met = np.concatenate(met)
        self.limit = float(np.quantile(met, target)) if len(met) else 0.0

    def halves(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return u[:, : self.cut], u[:, self.cut :] if u.shape[1] > 1 else u[:, :1]

    def cell(self, u: np.ndarray) -> np.ndarray:
        i, j = (_near(x, w) for x, w in zip(self.halves(u), self.words))
        return i * self.k + j

    def costs(self, u: np.ndarray) -> list[np.ndarray]:
        """For each half the squared distance from each row to each codeword's region, from below. Give few rows."""
        out = []
        for x, w in zip(self.halves(u), self.words):
            square = (w**2).sum(1)
            d = (x**2).sum(1)[:, None] + square[None, :] - 2 * x @ w.T
            own, row = np.argmin(d, axis=1), np.arange(len(x))
            gap = np.sqrt(np.maximum(square[own][:, None] + square[None, :] - 2 * w[own] @ w.T, 1e-300))
            plane = np.maximum(d - d[row, own][:, None], 0) / (2 * gap)
            plane[row, own] = 0
            out.append(plane**2)
        return out

    def visits(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits: with each codeword of the first half go as many of the second as the limit
        leaves, the frontier of the multi-sequence order. Give few rows."""
        first, second = self.costs(u)
        row, i = np.nonzero(first <= self.limit)
        at, j = np.nonzero(first[row, i][:, None] + second[row] <= self.limit)
        return row[at], i[at] * self.k + j

    def ahead(self, own: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether `cell` is ahead of `own`: of two different cells always one is."""
        n = self.k * self.k
        step = (cell - own) % n
        return (step > 0) & ((2 * step < n) | ((2 * step == n) & (own < cell)))


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Blocks:
    """Blocks numbered by cell, part of its members and lot of its visitors, and the pass that takes each."""

    def __init__(self, members: np.ndarray, visitors: np.ndarray, rows: int):
        self.parts, self.lots = -(-members // MEMBERS), np.maximum(1, -(-visitors // VISITORS))
        self.first = np.r_[0, np.cumsum(self.parts * self.lots)]
        sent = int((members * self.lots + visitors * self.parts).sum())
        self.passes = max(1, math.ceil(sent / max(LEAST_PASS, PASS_ROWS * rows)))

    def of(self, node: np.ndarray, cell: np.ndarray, visitor: bool, now: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) for each block of this pass that a row of `cell` is in, as a visitor or as a member."""
        mine, other = (self.lots[cell], self.parts[cell]) if visitor else (self.parts[cell], self.lots[cell])
        own = (_scrambled(node * 2 + visitor) % np.maximum(1, mine).astype(np.uint64)).astype(np.int64)
        row = np.repeat(np.arange(len(cell)), other)
        each = np.arange(len(row)) - np.repeat(np.cumsum(other) - other, other)
        part, lot = (each, own[row]) if visitor else (own[row], each)
        block = self.first[cell[row]] + part * self.lots[cell[row]] + lot
        taken = _scrambled(block) % np.uint64(self.passes) == now
        return row[taken], block[taken]


def _groups(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least number connected to each row and column of a matrix of links."""
    big = np.iinfo(np.int64).max
    while True:
        new_right = np.minimum(right, np.where(linked, left[:, None], big).min(axis=0, initial=big))
        new_left = np.minimum(left, np.where(linked, new_right[None, :], big).min(axis=1, initial=big))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _links(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, matrix of links between these): all links, those of few rows of a at a time.

    The product over the first half of the components and the norms of the rest is a bound from above; what it leaves
    is decided in double precision, or, if that is much, in single precision where that is far enough from the threshold."""
    u, w = directions(a).astype(np.float32), directions(b).astype(np.float32)
    half = (u.shape[1] + 1) // 2
    first, second = (np.c_[x[:, :half], np.sqrt(np.einsum("ij,ij->i", x[:, half:], x[:, half:]))] for x in (u, w))
    an, bn = norms(a), norms(b)
    unsure = 1e-6 + 2e-7 * a.shape[1]  # more than single precision errs by
    for at in range(0, len(a), VISITORS_AT_ONCE):
        some = slice(at, at + VISITORS_AT_ONCE)
        left = np.flatnonzero(first[some] @ second.T >= threshold - unsure)
        if not len(left):
            continue
        dense = 16 * len(left) > len(first[some]) * len(b)
        if dense:
            s = u[some] @ w.T
            linked = s >= threshold + unsure
            i, j = np.nonzero((s >= threshold - unsure) & ~linked)
        else:
            i, j = divmod(left, len(b))
        exact = np.zeros(len(i), bool)
        for p in range(0, len(i), PAIRS):
            x, y = at + i[p : p + PAIRS], j[p : p + PAIRS]
            exact[p : p + PAIRS] = np.einsum("ij,ij->i", a[x].astype(np.float64), b[y].astype(np.float64)) / (an[x] * bn[y]) >= threshold
        i, j = i[exact], j[exact]
        if dense:
            linked[i, j] = True
            rows, others = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            yield at + rows, others, linked[np.ix_(rows, others)]
        elif len(i):
            (rows, x), (others, y) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
            linked = np.zeros((len(rows), len(others)), bool)
            linked[x, y] = True
            yield at + rows, others, linked


def embedding_links(df: DataFrame, threshold: float = 0.95, target: float = TARGET, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors that are null, zero or not finite, or of another length than most, link with nothing and are components
    of their own, as is any row alone. Repeated rows are rows of their own and links of each other. A null id counts
    as the largest; an empty input gives an empty result. df is read twice and must be the same both times.
    """
    kind = number_type(df, vec_col)
    rows = as_rows(df, id_col, vec_col)
    # A row knows its vector by 128 bits of hashes, so that vectors are sent once, to find the equal ones.
    keys = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v", F.lit(2)).alias("h2")]
    base = materialize(rows.select("id", F.length("v").alias("n_bytes"), *keys), "dedup-rows")
    length = base.where("n_bytes is not null").groupBy("n_bytes").count().orderBy(F.desc("count"), F.desc("n_bytes")).first()
    length = length["n_bytes"] if length else 0
    usable = F.coalesce(F.col("n_bytes") == length, F.lit(False))
    with shuffles_deleted(df.sparkSession):
        equal = rows.where(F.length("v") == length).groupBy("v").agg(F.count("*").alias("n"))
        distinct = materialize(equal.select("v", "n", F.monotonically_increasing_id().alias("node")), "dedup-distinct")
        total = distinct.count()
        words = min(WORDS, max(1, math.isqrt(total // PER_CELL)))
        sample = max(LEAST_SAMPLE, SAMPLE_PER_WORD * words)
        order = F.xxhash64("v")
        few = order if 2 * sample >= total else F.when(order < int(-(2.0**63) + 2.0**64 * 2 * sample / total), order)
        picked = distinct.select("v", few.alias("order")).where("order is not null").orderBy("order", "v").limit(sample).toPandas()["v"]
        grid = Grid(np.frombuffer(b"".join(picked), kind).reshape(len(picked), -1) if len(picked) else np.ones((1, 1)), threshold, target, words)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    u = directions(matrix(some.column(0), kind))
                    own, ahead, ends = grid.cell(u), [], [0]
                    for few in range(0, len(u), FEW):
                        row, cell = grid.visits(u[few : few + FEW])
                        kept = grid.ahead(own[few + row], cell)
                        ahead.append(cell[kept])
                        ends += (ends[-1] + np.cumsum(np.bincount(row[kept], minlength=len(u[few : few + FEW])))).tolist()
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ahead).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(own.astype(np.int32)), lists], names=["v", "n", "node", "cell", "ahead"])

        placed = materialize(distinct.mapInArrow(place, "v binary, n long, node long, cell int, ahead array<int>"), "dedup-cells")
        forget(distinct)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            members, visitors = np.zeros((2, grid.k * grid.k), np.int64)
            for batch in batches:
                own, ahead = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
                members += np.bincount(own, minlength=len(members))
                visitors += np.bincount(np.r_[own, ahead], minlength=len(members))
            cell = np.flatnonzero(visitors)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(members[cell]), pa.array(visitors[cell])], names=["cell", "members", "visitors"])

        # At most WORDS ** 2 counts of cells, 65,536, reach the driver.
        sizes = placed.select("cell", "ahead").mapInArrow(count, "cell long, members long, visitors long").groupBy("cell").agg(F.sum("members"), F.sum("visitors")).toPandas().to_numpy()
        filled = np.zeros((2, grid.k * grid.k), np.int64)
        filled[:, sizes[:, 0].astype(np.int64)] = sizes[:, 1:].T
        blocks = Blocks(*filled, total)

        def send(now: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    node, own = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                    every, row = np.arange(len(own)), np.repeat(np.arange(len(own)), batch.column(4).value_lengths().to_numpy())
                    out = []
                    for role, who, where in ((HOME, every, own), (OWN, every, own), (AHEAD, row, batch.column(4).flatten().to_numpy())):
                        i, block = blocks.of(node[who], where, role != HOME, now)
                        out.append((who[i], block, np.full(len(i), role, np.int8)))
                    who, block, role = (np.concatenate(x) for x in zip(*out))
                    for at in range(0, len(who), SENT):
                        some = slice(at, at + SENT)
                        v, n, node = (batch.column(c).take(pa.array(who[some])) for c in range(3))
                        yield pa.RecordBatch.from_arrays([pa.array(block[some]), pa.array(role[some]), v, n, node], names=["block", "role", "v", "n", "node"])

            return run

        def verify(block: pa.Table) -> pa.Table:
            role = block["role"].to_numpy()
            left, right = block.filter(pa.array(role != HOME)), block.filter(pa.array(role == HOME))
            nodes, links, roots = [], [], []
            if left.num_rows and right.num_rows:
                an, bn = left["n"].to_numpy(), right["n"].to_numpy()
                who, whom = left["node"].to_numpy(), right["node"].to_numpy()
                away = left["role"].to_numpy() == AHEAD
                met = np.zeros(len(whom), np.int64)
                for i, j, linked in _links(matrix(left["v"], kind), matrix(right["v"], kind), threshold):
                    other = linked & (who[i][:, None] != whom[j][None, :])
                    met[j] += (an[i] * away[i]) @ other  # in its own cell a member counts as a visitor
                    l, r = _groups(linked, who[i].copy(), whom[j].copy())
                    nodes += [who[i], whom[j]]
                    links += [other @ bn[j], np.zeros(len(j), np.int64)]
                    roots += [l, r]
                nodes.append(whom[met > 0])
                links.append(met[met > 0])
                roots.append(whom[met > 0])
            node, link, root = (np.concatenate([np.empty(0, np.int64), *x]) for x in (nodes, links, roots))
            told = (link > 0) | (node != root)
            return pa.table({"node": node[told], "links": link[told].astype(np.int64), "root": root[told]})

        found = []
        for now in range(blocks.passes):
            sent = placed.mapInArrow(send(now), "block long, role byte, v binary, n long, node long")
            found.append(materialize(sent.groupBy("block").applyInArrow(verify, "node long, links long, root long"), "dedup-links"))
    found = reduce(DataFrame.union, found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "node")
    known = placed.select(*keys, "n", "node").join(links, "node", "left").join(roots, "node", "left")
    known = materialize(known.select("h1", "h2", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "dedup-known")
    forget(placed)
    linked = base.where(usable).join(known, ["h1", "h2"]).select("id", "root", "n_links")
    least = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = linked.join(least, "root").select("id", "n_links", "component_id")
    out = linked.union(base.where(~usable).select("id", F.lit(0).alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 and more among all vectors, as counts and components.

    Null, zero and non-finite vectors stay rows without links; repeated rows are linked with each other; null ids stay
    rows; an empty table gives an empty result; other columns are not read.
    """
    return embedding_links(table(spark, sf_dir, "embeddings")).withColumn("component_id", F.col("component_id").cast("long"))
