"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The law of a "word" in every contract of this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
HOT = 512  # a key is hot if more than one row in HOT has it, so at most HOT keys are
SALTS = 64  # over which a hot key's rows are dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master whose session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="contestlab-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


ROWS_PER_FILE = 1 << 18


def materialize(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, and a lost executor
    costs nothing already written. Rows carry whatever non-deterministic ids they had when written.

    most_rows, where the caller knows a bound of narrow rows, keeps a small table from becoming many tiny files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if most_rows is not None:
        df = df.coalesce(max(1, math.ceil(most_rows / ROWS_PER_FILE)))
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


@contextmanager
def rows_a_batch(spark: SparkSession, most: int) -> Iterator[None]:
    """What is written meanwhile passes to Python in batches of at most `most` rows, so that neither side holds as many
    whole texts at once as the session's setting allows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files once it is written; otherwise they stay until the driver happens
    to collect its garbage, so steps that follow each other would hold the disk together."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(*tables: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def group_bits(rows: int, least: int = 4, most: int = 16) -> int:
    """log2 of a number of groups such that both the groups and the rows of one grow as the square root of rows."""
    return min(most, max(least, math.ceil(math.log2(max(1.0, math.sqrt(rows) / 2)))))


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """counts(key, n) of `total` rows -> (key) of the hot ones, fewer than HOT."""
    return counts.where(F.col("n") * HOT > total).select(key)


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """left joined with right on key, where `hot` (fewer than HOT keys, so it may be broadcast) names keys with very
    many rows on the left: those rows are dealt over SALTS tasks by `spread`, and right's rows are sent to each."""
    few = F.broadcast(hot.select(F.col(key).alias("_hot")))
    many = F.col("_hot").isNotNull()
    a = left.join(few, left[key] == F.col("_hot"), "left").withColumn("_salt", F.when(many, F.pmod(spread, F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    b = right.join(few, right[key] == F.col("_hot"), "left")
    b = b.withColumn("_salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def quoted(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def whole_row(df: DataFrame) -> Column:
    """All of df's columns as one struct, so that an operator's own columns clash with none of them."""
    return F.struct(*quoted(df)) if df.columns else F.struct(F.lit(0).alias("none"))


def unfold(df: DataFrame, row: str, schema, made: dict[str, Column]) -> DataFrame:
    """The columns of the struct `row` (schema: what it was made of) and then the columns `made`, which replace
    columns of the same name (in any case)."""
    names = {c.lower() for c in made}
    kept = [F.col(row).getField(f.name).alias(f.name) for f in schema.fields if f.name.lower() not in names]
    df = df.select(row, *[value.alias(f"made{i}") for i, value in enumerate(made.values())])
    return df.select(*kept, *[F.col(f"made{i}").alias(name) for i, name in enumerate(made)])


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(h: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
