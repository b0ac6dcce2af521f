"""Strict readers: line JSON, CSV by header, and partitioned writes with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Line-delimited JSON, gzipped or not; a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv_by_header(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Columns by header name whatever their order, cast to the given types; an unknown header or a bad value raises."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    return raw.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def write_days(rows: DataFrame, day: str, path: str) -> None:
    """Parquet by day; a rerun replaces only the days that it holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def manifest(rows: DataFrame, day: str, keys: list[str]) -> DataFrame:
    """Rows and an order-free digest per day: the sum of the rows' hashes."""
    return rows.groupBy(day).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).alias("digest"))


def intact(now: DataFrame, published: DataFrame, day: str) -> DataFrame:
    """Days of a published manifest that the present one lacks or contradicts."""
    p = published.select(day, F.col("n").alias("_n"), F.col("digest").alias("_d"))
    return p.join(now, day, "left").where(F.col("n").isNull() | (F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("digest") != F.col("_d")))).select(day)
