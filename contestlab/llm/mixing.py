"""Mixing sources to target weights by systematic sampling.

Inside its source every document has the same expected number of copies, r = target / size of the source, so the
prefix sum of expected copies before the document of rank k is k * r. One offset u in [0, 1) is drawn per source and a
document is taken once for each integer in (k * r + u, (k + 1) * r + u]. Documents are ranked by size class (half
an octave), then by size within salted groups, which keeps the taken words of a source close to its target: neighbours in the order are
of nearly equal size, and of any run of them the right share is taken.

Ranks are global per source but never computed in one task: rows are counted in groups (source, size class, salt),
whose first ranks are a prefix sum over that small table; both the groups and the rows of one grow as the square
root of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table, unfold, whole_row

CYCLE = (5, 2, 1)  # weights of the sources by code point, repeating
SHARE = 1.5  # of all words, what the mix holds
MOST = 2.0  # of a source's words, what the mix takes at most


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, source_size) -> with target: least(most * size, level * weight), summing to share of all.

    One row per source passes through one window here; sources are a registry, not data. Sources are taken in order
    of most * size / weight: the first ones are full, and what they leave is shared by weight among the others.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_n", F.row_number().over(by_code) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("_n") % len(cycle) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    full, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(full), F.lit(0.0))
    heavy = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(full), F.lit(0))
    ranked = ranked.withColumn("_level", left / heavy)
    # Full ones come first, so the least level at which a source is not full holds for all that follow it.
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_n"), F.col("_level").alias("level")))).over(every)["level"]
    return ranked.withColumn("_found", level).select(
        "source", "source_size", F.when(F.col("_found") * F.col("_w") <= F.col("_cap"), F.col("_found") * F.col("_w")).otherwise(F.col("_cap")).alias("target")
    )


def copies_to_target(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", seed: int = 11) -> DataFrame:
    """rows(id, source, size, ...) with source_size, target and copies (0, 1 or 2 with the default limits).

    The same rows with the same seed give the same copies. A null source is a source; null ids and repeated rows are
    rows of their own (rows alike in id and size are interchangeable); a size of zero takes no words however often it
    is copied; an empty input gives an empty result. Other columns are kept, whatever their names, but columns named
    source_size, target or copies are replaced.
    """
    packed = rows.select(whole_row(rows).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).alias("size"))
    taken = _taken(packed, seed)
    return unfold(taken, "row", rows.schema, {c: F.col(c) for c in ("source_size", "target", "copies")})


def _taken(packed: DataFrame, seed: int) -> DataFrame:
    """packed(row, id, source, size) -> row, source_size, target, copies."""
    made = {"key": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), "size": F.coalesce(F.col("size"), F.lit(0)).cast("long")}
    base = materialize(packed.select("row", "id", *[value.alias(name) for name, value in made.items()]), "mix-sizes")
    total = base.count()
    salts = math.ceil(total / max(1, math.ceil(2 * math.sqrt(total)))) or 1
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    bits = F.length(F.bin("size"))
    base = base.withColumns(
        {
            "class": (bits * 2 + F.when(F.col("size") * 4 >= F.pow(F.lit(2.0), bits) * 3, 1).otherwise(0)).cast("int"),
            "hash": hashed,
            "salt": F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"), F.lit(salts)),
        }
    )
    group = ["key", "class", "salt"]
    groups = base.groupBy(*group).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sizes = groups.groupBy("key").agg(F.sum("words").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("key") != "", F.substr("key", F.lit(2))))
    targets = source_targets(sizes).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    before = Window.partitionBy("key").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "words").join(targets, "key")
    inside = Window.partitionBy(*group).orderBy("size", "hash", "id")
    ranked = base.withColumn("nth", F.row_number().over(inside)).join(starts, group)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rank = F.col("first") + F.col("nth")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("key"))), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    copies = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return ranked.select("row", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the columns of docs, whatever their names and
    values. Null texts take no words; null sources are a source; an empty input gives an empty result."""
    packed = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("source"), words(F.col("text")).alias("size"))
    repeated = _taken(packed, seed).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unfold(repeated, "row", docs.schema, {})


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; documents need only their sizes here, never their texts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    return copies_to_target(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


ORACLE_OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k,
         coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size,
         md5('11:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
law AS (SELECT greatest(1, ceil(count(*) / greatest(1, ceil(2 * sqrt(count(*))))))::BIGINT AS salts FROM sized),
grouped AS (
  SELECT s.*, length(bin(size)) * 2 + CASE WHEN size * 4 >= power(2.0, length(bin(size))) * 3 THEN 1 ELSE 0 END AS cls,
         ('0x' || substr(h, 1, 8))::BIGINT % salts AS salt
  FROM sized s, law),
sources AS (SELECT k, max(source) AS source, sum(size)::BIGINT AS source_size FROM grouped GROUP BY k),
weighed AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n
  FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lev
  FROM weighed),
found AS (SELECT arg_min(lev, cap / w) AS level FROM levels WHERE lev * w <= cap),
targets AS (SELECT k, source_size, CASE WHEN level * w <= cap THEN level * w ELSE cap END AS target FROM levels, found),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cls, salt, size, h, doc_id) AS r FROM grouped)
SELECT doc_id, size, source_size, target,
       ((floor(r * rate + u) - floor((r - 1) * rate + u)) * size)::BIGINT AS taken
FROM (
  SELECT r.*, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
         ('0x' || substr(md5('11/' || r.k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM ranked r JOIN targets t USING (k))
"""
