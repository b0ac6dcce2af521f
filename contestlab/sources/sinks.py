"""Writes that refuse, skip or merge: immutable archives, writes only on change, compact rows, updated series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlab.sources.readers import manifest


def archive(rows: DataFrame, path: str) -> None:
    """Parquet that is never overwritten: an existing path raises."""
    rows.write.mode("errorifexists").parquet(path)


def changed(rows: DataFrame, published: DataFrame, ignore: tuple[str, ...] = ()) -> bool:
    """Whether rows differ from those published, order and the ignored columns (of times, say) aside."""
    keys = [c for c in rows.columns if c not in ignore]
    digest = lambda df: tuple(manifest(df.withColumn("_all", F.lit(1)), "_all", keys).select("n", "digest").collect())
    return digest(rows) != digest(published)


def write_if_changed(rows: DataFrame, path: str, ignore: tuple[str, ...] = (), age_hours: float = 0.0, most_hours: float = 2.0) -> bool:
    """Write rows as a new version under path unless they say what the last version says and that is younger than
    most_hours; tells whether it wrote. Versions are folders, so readers of the last one are not disturbed."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max((s.getPath().getName() for s in files.listStatus(folder)), default=None) if files.exists(folder) else None
    if last and age_hours < most_hours and not changed(rows, spark.read.parquet(f"{path}/{last}"), ignore):
        return False
    rows.write.mode("errorifexists").parquet(f"{path}/{int(last or 0) + 1:012d}")
    return True


def encoded(columns: list[str]) -> Column:
    """A row as an array of texts, by position; nulls stay nulls."""
    return F.array(*[F.col(c).cast("string") for c in columns])


def decoded(rows: DataFrame, packed: str, columns: dict[str, str]) -> DataFrame:
    """The columns of encoded rows by position, cast to their types; a value that doesn't fit raises."""
    return rows.select(*[F.element_at(packed, i + 1).cast(kind).alias(c) for i, (c, kind) in enumerate(columns.items())])


def updated_scores(series: DataFrame, results: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """series(keys, a_wins, b_wins, as_of) with the wins of results(keys, won_a, day) after as_of added, at most `most`."""
    new = results.join(series.select(*keys, "as_of"), keys).where(F.col("day") > F.col("as_of"))
    sums = new.groupBy(*keys).agg(F.sum(F.col("won_a").cast("int")).alias("_a"), F.sum((~F.col("won_a")).cast("int")).alias("_b"), F.max("day").alias("_d"))
    add = lambda c, n: F.least(F.lit(most), F.col(c) + F.coalesce(n, F.lit(0))).cast("int")
    return series.join(sums, keys, "left").select(*keys, add("a_wins", "_a").alias("a_wins"), add("b_wins", "_b").alias("b_wins"), F.coalesce("_d", "as_of").alias("as_of"))
