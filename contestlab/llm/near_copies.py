"""Documents grouped as near copies: ball hashing and bands of minima find candidates, exact similarity confirms them.

Two texts are near copies when the Jaccard similarity of their sets of word shingles reaches the threshold. A
fingerprint of five-word shingles moves by about ten bits at a similarity of 0.8, too far for any ball; one of the
text's distinct words moves by about four. So each text has KINDS independent fingerprints of its distinct words, and
ball hashing links each kind within `radius` bits. That finds texts that differ in single words. Where they differ by a
whole block the words differ as much as the shingles, so texts also meet in BANDS bands of ROWS shingle minima each: two
texts at similarity s share one with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9998 at 0.8.

The members of a band are linked as a star around the one that shares most bands with most texts, which in a family of
edited copies is the one the others were made from. Links are verified on the shingles in rounds: first one for each
text, then those between texts of different centres, then, as a link may be rejected, the rejected members of each band
around new centres, WAYS times as many each round, until no band has two of them left. Centres leave, so rounds end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import WORD, blank, forget, hot_keys, materialize, rows_a_batch, spread_join, unfold, whole_row
from .graph import components
from .simhash import LOWER, ball_links, fingerprint

KINDS = 2
BANDS, ROWS = 16, 4
WAYS = 8  # times as many centres in a band each round
BLOCK = 4096  # shingles minimised at once
TEXTS_AT_ONCE = 512  # that pass to Python in one batch
_rng = np.random.default_rng(17)
_XOR = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words in order (A-Z lower-cased)."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of runs of `size` words; of all of them if there are fewer; of nothing if there is none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        out = mix(out ^ words[j : len(words) - size + 1 + j], j + 1)
    return np.unique(out)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band: of its number and its minima."""
    if not len(found):
        return found
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[None, at : at + BLOCK] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key ^ least[j::ROWS], j + 1)
    return key


def _sketched(rows: DataFrame, kinds: int, size: int) -> DataFrame:
    """(key, id, text) -> (key, id, n, fps, bands): the number of shingles, the fingerprints and the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fps, keys = [], [], []
            for text in batch.column(2):
                words = word_hashes(text.as_py())
                found, distinct = shingles(words, size), np.unique(words)
                n.append(len(found))
                fps.append(np.array([fingerprint(mix(distinct, k)) for k in range(kinds)], np.uint64).view(np.int64))
                keys.append(bands(found).view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (fps, keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), *lists], names=["key", "id", "n", "fps", "bands"])

    made = [StructField("n", IntegerType()), StructField("fps", ArrayType(LongType())), StructField("bands", ArrayType(LongType()))]
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], *made]))


def _shingled(rows: DataFrame, size: int) -> DataFrame:
    """(node, text) -> (node, shingles): the distinct shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = shingles(word_hashes(batch.column(1)[i].as_py()), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([found], pa.list_(pa.int64()))], names=["node", "shingles"])

    return rows.mapInArrow(run, StructType([rows.schema.fields[0], StructField("shingles", ArrayType(LongType()))]))


def _known(id_col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.lit(""))


def _stars(held: DataFrame, rows: int, ways: int) -> DataFrame:
    """held(g, node, p) -> (g, x, y): each member x of a group g and its centres y, the members of most p in `ways`
    parts of the group."""
    part = F.pmod(F.xxhash64("node", F.lit(ways)), F.lit(ways))
    best = held.groupBy("g", part.alias("part")).agg(F.max(F.struct("p", (-F.col("node")).alias("m"))).alias("b"), F.count("*").alias("n"))
    best = materialize(best.select("g", "n", (-F.col("b.m")).alias("y")), "near-centres", rows)
    hot = hot_keys(best.groupBy("g").agg(F.sum("n").alias("n")), "g", rows)
    told = spread_join(held, best.select("g", "y"), "g", hot, F.xxhash64("node"))
    return told.where("node <> y").select("g", F.col("node").alias("x"), "y")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs(x, y) -> (x, y, alike); y may have very many partners."""
    rows = pairs.count()
    hot = hot_keys(pairs.groupBy("y").agg(F.count("*").alias("n")), "y", rows)
    left = pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("s")), "x")
    met = spread_join(left, sets.select(F.col("node").alias("y"), F.col("shingles").alias("t")), "y", hot, F.xxhash64("x"))
    shared = F.size(F.array_intersect("s", "t"))
    return met.select("x", "y", (shared >= F.lit(similarity) * (F.size("s") + F.size("t") - shared)).alias("alike"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 4, kinds: int = KINDS) -> DataFrame:
    """One document of each group of near copies: the one of the least id; all its columns, whatever their names.

    Equal texts are copies; a null text equals an empty one, and texts without words are copies of each other. Texts
    of fewer words than a shingle are compared whole. Null ids count as the largest. Of repeated rows one is kept. An
    empty input gives an empty result.
    """
    text = blank(F.col(text_col))
    worded = F.when(text.rlike(WORD), text).otherwise("")
    keyed = docs.select(whole_row(docs).alias("row"), F.md5(worded).alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    # One row stands for each text: that of its least id. Rows alike in both are one.
    base = keyed.select("key", "id", "text")
    with rows_a_batch(docs.sparkSession, TEXTS_AT_ONCE):
        marked = materialize(_sketched(base, kinds, shingle), "near-sketches")
    first = marked.groupBy("key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "fps", "bands")])
    nodes = materialize(first.withColumn("node", F.monotonically_increasing_id()), "near-texts")
    total = nodes.count()
    forget(marked)

    fps = nodes.select("node", F.posexplode("fps").alias("kind", "fp"))
    least = materialize(fps.groupBy("kind", "fp").agg(F.min("node").alias("least")), "near-kinds", kinds * total)
    alike = fps.join(least, ["kind", "fp"]).select(F.col("node").alias("x"), F.col("least").alias("y"))
    links = ball_links(least.select("kind", "fp"), radius, kinds * total, every=True)
    apart = links.join(least.withColumnsRenamed({"fp": "a", "least": "x"}), ["kind", "a"]).join(least.withColumnsRenamed({"fp": "b", "least": "y"}), ["kind", "b"])
    balls = alike.union(apart.select("x", "y")).where("x <> y")

    each = nodes.select("node", F.explode("bands").alias("g"))
    sizes = materialize(each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "near-bands", BANDS * total)
    shared = spread_join(each, sizes, "g", hot_keys(sizes, "g", BANDS * total), F.xxhash64("node"))
    popular = shared.groupBy("node").agg(F.sum("n").alias("p"), F.collect_set("g").alias("gs"))
    held = materialize(popular.select("node", "p", F.explode("gs").alias("g")), "near-held")
    stars = materialize(_stars(held, max(1, held.count()), 1), "near-stars")

    fit = nodes.select("node", "n")
    both = balls.union(stars.select("x", "y")).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))

    def candidates(pairs: DataFrame) -> DataFrame:
        """Those whose sizes allow the similarity."""
        sized = pairs.join(fit.withColumnsRenamed({"node": "x", "n": "nx"}), "x").join(fit.withColumnsRenamed({"node": "y", "n": "ny"}), "y")
        return sized.where(F.least("nx", "ny") >= F.lit(similarity) * F.greatest("nx", "ny"))

    pairs = materialize(candidates(both.groupBy("x", "y").agg(F.count("*").alias("votes"))).select("x", "y", "votes"), "near-pairs")
    wanted = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).union(stars.select(F.col("x").alias("node"))).distinct()
    wanted = wanted.join(nodes.select("key", "id", "node"), "node").select("node", "key", _known(F.col("id")).alias("_known"))
    texts = base.withColumn("_known", _known(F.col("id"))).join(wanted, ["key", "_known"]).select("node", "text").dropDuplicates(["node"])
    with rows_a_batch(docs.sparkSession, TEXTS_AT_ONCE):
        sets = materialize(_shingled(texts, shingle), "near-shingles")

    # First the link of most votes for each text, then the links between texts of different centres.
    best = pairs.groupBy("x").agg(F.max(F.struct("votes", (-F.col("y")).alias("m"))).alias("b")).select("x", (-F.col("b.m")).alias("y"))
    told = materialize(_verified(best, sets, similarity), "near-verified")
    centre = told.where("alike").select(F.col("x").alias("v"), F.col("y").alias("c"))

    def across(some: DataFrame) -> DataFrame:
        """Those that don't share a centre of the first round, nor are each other's."""
        named = some.join(centre.withColumnsRenamed({"v": "x", "c": "cx"}), "x", "left").join(centre.withColumnsRenamed({"v": "y", "c": "cy"}), "y", "left")
        return named.where(F.coalesce("cx", "x") != F.coalesce("cy", "y")).drop("cx", "cy")

    rest = materialize(across(pairs.join(best, ["x", "y"], "left_anti").select("x", "y")), "near-rest")
    edges = [told.where("alike"), materialize(_verified(rest, sets, similarity), "near-verified").where("alike")]
    ways, now = WAYS, stars
    while True:
        # Who is neither its centre's like nor of its family meets the others of its band that aren't; centres have met all.
        ended = edges[-1].select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        left = across(now.select("g", F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"), F.col("x").alias("node"))).join(ended, ["x", "y"], "left_anti")
        left = left.select("g", "node").distinct().join(now.select("g", F.col("y").alias("node")).distinct(), ["g", "node"], "left_anti").join(held, ["g", "node"])
        again = materialize(left.join(left.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "g", "left_semi"), "near-left")
        count = again.count()
        if not count:
            break
        now = materialize(_stars(again, count, ways), "near-stars")
        more = candidates(now.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()).select("x", "y")
        more = materialize(across(more.join(pairs.select("x", "y"), ["x", "y"], "left_anti")), "near-pairs")
        edges.append(materialize(_verified(more, sets, similarity), "near-verified").where("alike"))
        ways *= WAYS
    joined = edges[0]
    for some in edges[1:]:
        joined = joined.union(some)
    roots = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b")))

    grouped = nodes.select("key", "id", "node").join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))).alias("m"))
    winners = first.select(F.col("m.key").alias("key"), _known(F.col("m.id")).alias("_known"))
    kept = keyed.withColumn("_known", _known(F.col("id"))).join(winners, ["key", "_known"], "left_semi").dropDuplicates(["key", "_known"])
    return unfold(kept, "row", docs.schema, {})
