"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every row first belongs to one of P logical partitions. How many rows each partition sends to each shard is drawn
from the exact law that a uniform permutation of all rows would induce: the matrix with these row sums (partition
sizes) and column sums (shard sizes) is split in halves of partitions again and again, and each half's vector is a
multivariate hypergeometric draw. Rows are then permuted inside their partition, cut at the drawn counts, exchanged,
and permuted again inside their shard. No task ever holds more than one partition or one block of a shard, and both
grow as the square root of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, group_bits, let, materialize, table, unfold, unit, whole_row


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked items among `drawn` out of `population`, by inversion of u.

    Weights are relative to the mode's and stop 12 standard deviations away, far below a double's resolution.
    """

    def ratio_up(k: Column, big_n: Column, big_k: Column, n: Column) -> Column:
        return (big_k - k) * (n - k) / ((k + 1.0) * (big_n - big_k - n + k + 1.0))

    def pick(s: Column) -> Column:
        big_n, big_k, n = s["pool"], s["K"], s["n"]
        lo, hi = F.greatest(F.lit(0.0), n + big_k - big_n), F.least(n, big_k)
        mode = F.least(hi, F.greatest(lo, F.floor((n + 1.0) * (big_k + 1.0) / (big_n + 2.0)).cast("double")))
        p = F.coalesce(F.try_divide(big_k, big_n), F.lit(0.0))
        sd = F.sqrt(n * p * (1.0 - p) * F.coalesce(F.try_divide(big_n - n, big_n - 1.0), F.lit(0.0)))
        reach = F.ceil(sd * 12.0).cast("double") + 12.0
        bounds = F.struct(mode.alias("m"), F.greatest(lo, mode - reach).alias("a"), F.least(hi, mode + reach).alias("b"))

        def invert(t: Column) -> Column:
            m, a, b = t["m"], t["a"], t["b"]
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

            def down(acc: Column, k: Column) -> Column:
                w = acc["w"] * k * (big_n - big_k - n + k) / ((big_k - k + 1.0) * (n - k + 1.0))
                return F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"))

            def up(acc: Column, k: Column) -> Column:
                w = acc["w"] * ratio_up(k, big_n, big_k, n)
                return F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"))

            def steps(first: Column, last: Column, step: int) -> Column:
                return F.transform(F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long")), lambda k: k.cast("double"))

            below = F.when(m > a, F.aggregate(steps(m, a + 1.0, -1), start, down)).otherwise(start)
            above = F.when(m < b, F.aggregate(steps(m, b - 1.0, 1), start, up)).otherwise(start)

            def scan(e: Column) -> Column:
                target = u * (e["below"]["sum"] + 1.0 + e["above"]["sum"])
                first = F.struct(e["below"]["w"].alias("w"), F.lit(0.0).alias("cum"), F.lit(-1.0).alias("k"))

                def step(acc: Column, k: Column) -> Column:
                    cum = acc["cum"] + acc["w"]
                    return F.struct(
                        (acc["w"] * ratio_up(k, big_n, big_k, n)).alias("w"),
                        cum.alias("cum"),
                        F.when((acc["k"] < 0) & (cum > target), k).otherwise(acc["k"]).alias("k"),
                    )

                found = F.aggregate(steps(a, b, 1), first, step, lambda acc: acc["k"])
                return F.when(found < 0, b).otherwise(found)

            return let(F.struct(below.alias("below"), above.alias("above")), scan)

        return let(bounds, invert)

    args = F.struct(population.cast("double").alias("pool"), marked.cast("double").alias("K"), drawn.cast("double").alias("n"))
    return let(args, lambda s: F.when((s["n"] <= 0) | (s["K"] <= 0), F.lit(0.0)).otherwise(pick(s))).cast("long")


def split_counts(caps: Column, drawn: Column, seed: Column) -> Column:
    """One multivariate hypergeometric draw of `drawn` items from categories of sizes `caps`."""
    total = F.aggregate(caps, F.lit(0).cast("long"), lambda acc, c: acc + c)
    start = F.struct(drawn.cast("long").alias("n"), total.alias("pool"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, cap: Column) -> Column:
        u = unit(F.xxhash64(seed, F.size(acc["out"])))
        x = hypergeometric(acc["pool"], cap, acc["n"], u)
        return let(x, lambda v: F.struct((acc["n"] - v).alias("n"), (acc["pool"] - cap).alias("pool"), F.concat(acc["out"], F.array(v)).alias("out")))

    return F.aggregate(caps, start, step, lambda acc: acc["out"])


def communication_matrix(counts: DataFrame, bits: int, shards: int, rows: int, seed: int) -> DataFrame:
    """counts(bucket, n) for some of the 2**bits buckets -> (bucket, upto): upto[i] rows go to shards 0..i."""
    spark = counts.sparkSession
    root = (
        spark.range(1 << bits)
        .withColumnRenamed("id", "bucket")
        .join(counts, "bucket", "left")
        .agg(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("n", F.lit(0)).alias("n")))).alias("ns"))
        .select(
            F.lit(0).cast("long").alias("node"),
            F.transform("ns", lambda x: x["n"].cast("long")).alias("ns"),
            F.array(*[F.lit(rows // shards + (i < rows % shards)).cast("long") for i in range(shards)]).alias("caps"),
        )
    )
    nodes = root
    for level in range(bits):
        half = 1 << (bits - level - 1)
        here = F.aggregate(F.slice("ns", 1, half), F.lit(0).cast("long"), lambda acc, n: acc + n)
        nodes = nodes.withColumn("left", split_counts(F.col("caps"), here, F.xxhash64(F.lit(seed), F.lit(level), F.col("node"))))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.slice("ns", 1, half).alias("ns"), F.col("left").alias("caps")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.slice("ns", half + 1, half).alias("ns"), F.zip_with("caps", "left", lambda c, x: c - x).alias("caps")),
        )
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.*")
        if level == bits // 2:
            nodes = nodes.repartition("node")
    def cumulate(acc: Column, c: Column) -> Column:
        return F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + c))

    return nodes.select(F.col("node").alias("bucket"), F.aggregate("caps", F.array().cast("array<bigint>"), cumulate).alias("upto"))


def shuffle_shards(rows: DataFrame, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """Every row with `shard` (0..shards-1, counts at most one apart) and `slot` (gapless from 0 in its shard).

    All columns are kept, whatever their names and values, but columns named shard or slot are replaced. An empty input
    gives an empty result; repeated rows are rows of their own. The rows are written once to the shared folder, so row
    ids stay the same if tasks run again.
    """
    base = materialize(rows.select(whole_row(rows).alias("row"), F.monotonically_increasing_id().alias("rid")), "shard-rows")
    total = base.count()
    bits = group_bits(total)
    base = base.withColumn("bucket", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(1 << bits)))
    matrix = communication_matrix(base.groupBy("bucket").agg(F.count("*").alias("n")), bits, shards, total, seed)
    local = Window.partitionBy("bucket").orderBy(F.xxhash64("rid", F.lit(seed + 1)), "rid")
    sent = (
        base.withColumn("at", F.row_number().over(local))
        .join(matrix, "bucket")
        .select("row", "rid", F.size(F.filter("upto", lambda c: c < F.col("at"))).alias("shard"), F.xxhash64("rid", F.lit(seed + 2)).alias("key"))
    )
    sent = sent.withColumn("block", F.shiftrightunsigned("key", 64 - max(4, bits - 2)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sent.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("key", "rid")
    placed = sent.withColumn("nth", F.row_number().over(inside)).join(blocks, ["shard", "block"])
    return unfold(placed, "row", rows.schema, {"shard": F.col("shard"), "slot": F.col("first") + F.col("nth") - 1})


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `rows`.

    A null text counts as an empty one, of size 1; texts of any length count whole; repeated rows and null ids are rows of
    their own; nothing is tied, as every row has a place; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    text = blank(F.col("text"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return shuffle_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
