"""Publishing tables as versions with a manifest, and reading one version whole: the newest that nothing has torn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version string, table string, file string, bytes long, sha256 string"


def publish(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Write tables under root/version and, last of all, the manifest of their files' sizes and SHA-256 digests."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{root}/data/{version}/{name}")
    listed = hashes(spark, f"{root}/data/{version}/*").select(F.lit(version).alias("version"), "table", "file", "bytes", "sha256")
    listed.write.mode("errorifexists").json(f"{root}/manifest/{version}")


def hashes(spark: SparkSession, folders: str) -> DataFrame:
    """(version, table, file, bytes, sha256) of the data files in folders root/data/version/table, hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders)
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return files.select(part(-3).alias("version"), part(-2).alias("table"), part(-1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, files, bad): the files that each version's manifest lists, and how many of them are missing or differ."""
    listed = spark.read.schema(MANIFEST).json(f"{root}/manifest/*")
    found = hashes(spark, f"{root}/data/*/*").withColumnsRenamed({"bytes": "_b", "sha256": "_s"})
    same = F.coalesce((F.col("bytes") == F.col("_b")) & (F.col("sha256") == F.col("_s")), F.lit(False))
    return listed.join(found, ["version", "table", "file"], "left").groupBy("version").agg(F.count("*").alias("files"), F.sum((~same).cast("long")).alias("bad"))


class Snapshot:
    """The newest whole version under root; every table is read from its files alone, never from two versions."""

    def __init__(self, spark: SparkSession, root: str):
        whole = versions(spark, root).where("bad = 0").agg(F.max("version").alias("v")).first()["v"]
        if whole is None:
            raise ValueError(f"no whole version under {root}")
        newest = spark.read.schema(MANIFEST).json(f"{root}/manifest/*").agg(F.max("version").alias("v")).first()["v"]
        self.spark, self.root, self.version, self.delivery = spark, root, whole, "current" if whole == newest else "older"

    def table(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        """A table's rows from exactly the files that the manifest lists."""
        listed = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/{self.version}").where(F.col("table") == name)
        files = [f"{self.root}/data/{self.version}/{name}/{r['file']}" for r in listed.select("file").collect()]  # names only
        if not files:
            raise ValueError(f"{name} is not in version {self.version}")
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*files)
