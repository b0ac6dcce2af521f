"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits if and only if some bit pattern lies within r bits of both, so every
distinct fingerprint emits all patterns within r = radius / 2 bits of itself and fingerprints that meet on a pattern
are linked. Patterns are shuffled by their leading bits: a fingerprint sends one message to each prefix that it can
reach with j <= r flips among the leading bits, and the receiving task makes the messages' patterns with the remaining
r - j flips among the trailing bits, so all patterns exist, each in one task, but only prefixes cross the network. The
number of leading bits grows with the input and keeps the patterns of a prefix within a task's memory; a crowded
prefix is split by further bits inside the task.

All who meet on a pattern are within the radius of each other, so a pattern's links are a star around its least
fingerprint: as many rows as members, never the pairs of a group. Documents first collapse into distinct
fingerprints and join again at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .graph import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
PATTERNS_PER_PREFIX = 1 << 20
PATTERNS_AT_ONCE = 1 << 19  # of which a pass sorts several copies
BLOCK = 1 << 16  # hashes turned into bits at once


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of `size` words (repeats included); of all the words if there are fewer; of nothing if none.

    Words are runs of anything but ASCII white space, A-Z lower-cased, joined by one space.
    """
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(found) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(rows: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp): fp the fingerprint as a signed long, zero for a null text or one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(shingle_hashes(x.as_py() or "", shingle)) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=[id_col, "fp"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def ball_size(bits: int, radius: int) -> int:
    return sum(math.comb(bits, j) for j in range(radius + 1))


@cache
def flips(first: int, after: int, most: int) -> np.ndarray:
    """All masks of at most `most` of the bits first..after-1."""
    return np.array([sum(1 << b for b in some) for j in range(most + 1) for some in combinations(range(first, after), j)], np.uint64)


def _groups(fps: np.ndarray, left: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The patterns within left[i] flips of the `low` trailing bits of fps[i] -> (i, pattern) wherever two meet."""
    pieces, owners = [], []
    for j in np.unique(left):
        at = np.flatnonzero(left == j)
        masks = flips(0, low, int(j))
        pieces.append((fps[at, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(at.astype(np.int32), len(masks)))
    patterns, owner = np.concatenate(pieces), np.concatenate(owners)
    ordered = np.sort(patterns)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    shared = np.isin(patterns, repeated) if len(repeated) else np.zeros(len(patterns), bool)
    return owner[shared], patterns[shared]


def meet(fps: np.ndarray, reached: np.ndarray, left: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least) among the fingerprints fps, whose patterns have leading bits `reached` and `left` flips
    yet to make among the `low` trailing bits. Sets too large for one pass are split by the next bit, each half with
    those that have the bit or flip it."""
    work, links = [(np.arange(len(fps)), reached, left, low)], []
    while work:
        who, now, rest, bits = work.pop()
        if len(who) < 2:
            continue
        load = sum(int((rest == j).sum()) * ball_size(bits, int(j)) for j in np.unique(rest))
        if load > PATTERNS_AT_ONCE and bits > 0:
            bit = np.uint64(1 << (bits - 1))
            has = (now & bit) != 0
            for side in (True, False):
                stay, come = np.flatnonzero(has == side), np.flatnonzero((has != side) & (rest > 0))
                both = np.r_[stay, come]
                moved = now[both].copy()
                moved[len(stay) :] ^= bit
                work.append((who[both], moved, np.r_[rest[stay], rest[come] - 1], bits - 1))
            continue
        owner, pattern = _groups(now, rest, bits)
        if not len(owner):
            continue
        member = fps[who[owner]]
        order = np.lexsort((member, pattern))
        member, pattern = member[order], pattern[order]
        starts = np.r_[True, pattern[1:] != pattern[:-1]]
        least = member[np.flatnonzero(starts)][np.cumsum(starts) - 1]
        apart = member != least
        links.append(np.unique(np.stack([member[apart], least[apart]], axis=1), axis=0))
        if len(links) > 64:
            links = [np.unique(np.concatenate(links), axis=0)]
    if not links:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    both = np.unique(np.concatenate(links), axis=0)
    return both[:, 0], both[:, 1]


def ball_links(distinct: DataFrame, radius: int, total: int, every: bool = False) -> DataFrame:
    """distinct(kind, fp), about `total` rows -> (kind, a, b): pairs of fingerprints of one kind (0 to 127) at `radius`
    or fewer differing bits whose graph has the same components as all such pairs.

    A link (a, least) is found under many prefixes but told under one: the least fingerprint's own prefix, or, where a
    differs from it in too many leading bits to reach that, any. What meets under the own prefix with a smaller least
    is linked to that one, so by induction on the smaller end nothing falls apart.

    That holds only if every link counts. A caller that rejects some wants every: links told under every prefix, so
    that a link also stands where the own prefix's patterns hold a third that is less."""
    half = (radius + 1) // 2
    lead = min(24, max(4, math.ceil(math.log2(max(1, total) * ball_size(64, half) / PATTERNS_PER_PREFIX))))
    low = 64 - lead
    masks = flips(low, 64, half)
    counts = np.array([int(m).bit_count() for m in masks], np.int8)
    parts = max(1, min(1 << lead, 8 * distinct.sparkSession.sparkContext.defaultParallelism))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).to_numpy().astype(np.int64)
            fps = batch.column(1).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                reached = part[:, None] ^ masks[None, :]
                prefix = ((reached >> np.uint64(low)).astype(np.int64) | (kinds[at : at + 4096, None] << lead)).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix), pa.array(np.repeat(part, len(masks)).view(np.int64)), pa.array(np.tile(half - counts, len(part)))], names=["prefix", "fp", "left"]
                )

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of a task's messages, sorted by prefix."""
        held = None
        mask = np.uint64((1 << low) - 1)

        def links(part: pa.Table) -> pa.RecordBatch:
            key = part.column(0).to_numpy()
            prefix = (key & ((1 << lead) - 1)).astype(np.uint64)
            fps = part.column(1).to_numpy().view(np.uint64)
            left = part.column(2).to_numpy()
            outs = [np.empty(0, np.int8)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for some in np.split(np.arange(len(fps)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                a, b = meet(fps[some], (prefix[some] << np.uint64(low)) | (fps[some] & mask), left[some], low)
                own = every | (b >> np.uint64(low) == prefix[some[0]]) | (np.bitwise_count((a ^ b) >> np.uint64(low)) > half)
                outs[0].append(np.full(int(own.sum()), key[some[0]] >> lead, np.int8))
                outs[1].append(a[own])
                outs[2].append(b[own])
            kind, a, b = (np.concatenate(x) for x in outs)
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            key = held.column(0).to_numpy()
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if whole:
                yield links(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield links(held)

    sent = distinct.select(F.col("kind").cast("byte").alias("kind"), "fp").mapInArrow(emit, "prefix long, fp long, left byte")
    met = sent.repartition(parts, "prefix").sortWithinPartitions("prefix").mapInArrow(receive, "kind byte, a long, b long")
    return met.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component_id): the least id reachable through fingerprints at most `radius` bits apart.

    Documents without words (null, empty or blank) have fingerprint zero and are linked like any other; equal
    fingerprints are linked; null ids stay rows and are never a component's id unless all its ids are null; repeated
    rows stay; an empty input gives an empty result.
    """
    base = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = materialize(base.groupBy("fp").agg(F.min(id_col).alias("_least")), "distinct-fingerprints", base.count())
    roots = components(ball_links(least.select(F.lit(0).alias("kind"), "fp"), radius, least.count()).select("a", "b")).withColumnRenamed("v", "fp")
    named = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    return base.join(named.join(ids, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document: four-word shingles, links at four or fewer differing bits.

    Null, empty and blank texts have fingerprint zero, linked like any other; texts of any length are read whole; repeated
    rows and ties share a component; null ids stay rows; an empty table gives an empty result; other columns are not read.
    """
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
