"""Streaming forms: upserts, an append-only ledger, corrections, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def plays_stream(spark, folder: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; instants must be of type timestamp for watermarks."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first entry of each key, however much later another one comes: a ledger never seals twice. The state holds
    one entry for each key, so keep it in RocksDB (spark.sql.streaming.stateStore.providerClass) where there are many."""
    return stream.dropDuplicates(keys)


def windowed_counts(stream: DataFrame, at: str, by: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and key, each window emitted once the watermark has passed it."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("opened"), *by, "n", "total")


def session_counts(stream: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each key, closed by a pause of `gap`."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


class Corrections(StatefulProcessor):
    """Per game the last published result; a row leaves only when it is new or differs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ord long, won int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        out = []
        for row in sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: r.ord):
            if known is None or (row.ord > known[0] and row.won != known[1]):
                out.append((key[0], row.ord, row.won, known is not None))
            if known is None or row.ord > known[0]:
                known = (row.ord, row.won)
        if known is not None:
            self.last.update((int(known[0]), int(known[1])))
        if out:
            yield pd.DataFrame(out, columns=["game", "ord", "won", "corrected"])

    def close(self) -> None:
        pass


def corrections(results: DataFrame) -> DataFrame:
    """results(game, ord, won) as a stream -> new and corrected results, in order of ord within a batch."""
    return results.groupBy("game").transformWithStateInPandas(Corrections(), "game string, ord long, won int, corrected boolean", "Append", "None")


def upsert(stream: DataFrame, keys: list[str], version: str, target: str, checkpoint: str):
    """Keep the latest version of each key in a table of versions: every batch is written under its own number, so a
    batch that runs again replaces itself, and readers take the last version by key (see latest)."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(spark, target: str, keys: list[str], version: str) -> DataFrame:
    rows = spark.read.parquet(target)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), version).alias("r")).select("r.*")
