"""Validation as data: rule tables, leakage, duplicates, references and state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broken_rules(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each broken rule of each row, in one pass: rules are conditions that must not hold."""
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(found).alias("rule"))


def clause_counts(rows: DataFrame, clauses: dict[str, Column]) -> DataFrame:
    """How many rows each clause rejects, how many it alone rejects, how many any does and how many there are; one row per
    clause, at its place."""
    # Each clause is computed once, then counted.
    judged = rows.select(*[F.coalesce(c, F.lit(False)).cast("int").alias(f"c{i}") for i, c in enumerate(clauses.values())])
    hits = [F.col(f"c{i}") for i in range(len(clauses))]
    judged = judged.select("*", sum(hits[1:], hits[0]).alias("hits"))
    count = lambda what: F.count(F.when(what, 1))
    sums = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("clause"), F.sum(h).alias("rejected"), count((h == 1) & (F.col("hits") == 1)).alias("alone")) for i, (n, h) in enumerate(zip(clauses, hits))]
    counted = judged.agg(F.array(*sums).alias("all"), count(F.col("hits") > 0).alias("any"), F.count("*").alias("candidates")).select(F.explode("all").alias("c"), "any", "candidates")
    return counted.select("c.place", "c.clause", F.coalesce("c.rejected", F.lit(0)).alias("rejected"), "c.alone", "any", "candidates")


def observation_issues(rows: DataFrame, known: DataFrame, unique: list[str], reference: str, at: str, until: str) -> DataFrame:
    """Duplicates by `unique`, references to nothing known, and instants that are not before `until`."""
    seen = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*unique).orderBy(at)))
    joined = seen.join(known.select(reference).distinct().withColumn("_known", F.lit(1)), reference, "left")
    return broken_rules(joined, unique, {"duplicate": F.col("_n") > 1, "unknown": F.col("_known").isNull(), "late": F.col(at) >= F.col(until)})


def phase_ends(rows: DataFrame, key: str, at: list[str], kind: str, closing: list[str], resets: list[str]) -> DataFrame:
    """Where phases end: a phase runs to the first closing kind after it opened, and resets cut it short. Each row gets
    its phase number, how it ended, and how many rows it has; every key is its own machine."""
    order = Window.partitionBy(key).orderBy(*at)
    ends = F.col(kind).isin(*closing, *resets)
    phase = F.coalesce(F.sum(ends.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.withColumn("phase", phase)
    return numbered.groupBy(key, "phase").agg(F.count("*").alias("steps"), F.max(F.when(F.col(kind).isin(*closing), "closed").when(F.col(kind).isin(*resets), "reset").otherwise(None)).alias("_e")).select(key, "phase", "steps", F.coalesce("_e", F.lit("open")).alias("ended"))


def leakage(rows: DataFrame, snapshots: DataFrame, keys: list[str], at: str, as_of: str) -> DataFrame:
    """rows with `rule`, of those whose snapshot is missing or not of a day strictly before theirs."""
    rule = F.when(F.col(as_of).isNull(), "missing").when(F.col(as_of) >= F.col(at), "not before")
    return rows.join(snapshots, keys, "left").withColumn("rule", rule).where("rule IS NOT NULL").select(*keys, at, "rule")


def pooled_rates(cells: DataFrame, order: str, hits: str, n: str) -> DataFrame:
    """cells (few: a registry's) with `rate`, hits / n pooled over neighbours so that it never falls along `order`: the
    greatest, over cells from which a block may start, of the least rate of a block that holds the cell."""
    all_cells = cells.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(hits).alias("h"), F.col(n).alias("n")))).alias("c"))
    part = lambda a, b, field: F.aggregate(F.transform(F.slice("c", a, b - a + 1), lambda x: x[field]), F.lit(0).cast("long"), lambda s, x: s + x)
    low = lambda i, a: F.array_min(F.transform(F.sequence(i, F.size("c")), lambda b: part(a, b, "h").cast("double") / part(a, b, "n")))
    rates = F.transform(F.sequence(F.lit(1), F.size("c")), lambda i: F.array_max(F.transform(F.sequence(F.lit(1), i), lambda a: low(i, a))))
    return all_cells.select(F.explode(F.arrays_zip("c", rates.alias("r"))).alias("z")).select(F.col("z.c.o").alias(order), F.col("z.c.h").alias(hits), F.col("z.c.n").alias(n), F.col("z.r").alias("rate"))
