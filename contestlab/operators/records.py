"""The record of a ledger of forecasts: every measure by model version, and by policy revision within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlab.functions.scoring import clamp

SEALS = ("final", "reissued", "morning")  # the first of these that a game has is the one that is scored
SMALL_SAMPLE, FLOOR = 500, 1e-6


def games_of(ledger: DataFrame) -> DataFrame:
    """ledger(ord, game, version, entry, p, reference, incomplete, revision, won) -> a row for each version and game with
    a seal: the first seal of each kind as structs, the scored one, and the game's latest result, whichever version's."""
    seal = F.struct("ord", "p", "reference", "incomplete", "revision")
    first = [F.min_by(seal, F.when(F.col("entry") == k, F.col("ord"))).alias(k) for k in SEALS]
    sealed = ledger.where(F.col("entry").isin(*SEALS)).groupBy("version", "game").agg(*first)
    result = ledger.where("entry = 'result'").groupBy("game").agg(F.max_by("won", "ord").alias("won"))
    kind = F.when(F.col("final").isNotNull(), "final").when(F.col("reissued").isNotNull(), "reissued").otherwise("morning")
    return sealed.join(result, "game", "left").withColumns({"seal": F.coalesce(*SEALS), "kind": kind, "latest": F.coalesce("reissued", "morning")})


def measures(two: Column, prior_rate: float) -> dict[str, Column]:
    """Aggregates over games_of rows; those of final and reissued seals are null for a version without such seals."""
    won, done = F.col("won"), F.col("won").isNotNull()
    p = clamp(F.col("seal.p"), FLOOR)
    square = lambda q: F.pow(clamp(q, FLOOR) - won, F.lit(2))
    had = lambda c: done & F.col(c).isNotNull()
    mean = lambda c: F.avg(F.when(had(c), square(F.col(c)["p"])))
    count = lambda c: F.count(F.when(c, 1))
    only = lambda v: F.when(two, v)
    scored, paired = count(done), count(had("seal") & F.col("seal.reference").isNotNull())
    return {
        "sealed": F.count("*"), "scored": scored, "pending": F.count("*") - scored, "incomplete": count(F.col("seal.incomplete")),
        "brier": F.avg(F.when(done, square(F.col("seal.p")))), "log_loss": F.avg(F.when(done, -F.when(won == 1, F.ln(p)).otherwise(F.ln(1.0 - p)))),
        "accuracy": F.avg(F.when(done, ((p > 0.5) == (won == 1)).cast("double"))), "baseline_brier": F.avg(F.when(done, F.pow(F.lit(prior_rate) - won, F.lit(2)))),
        "no_final_seal": only(count(done & (F.col("kind") != "final"))),
        "latest_brier": only(mean("latest")), "latest_count": only(count(had("latest"))),
        "original_brier": only(mean("morning")), "original_count": only(count(had("morning"))),
        "reissued_brier": only(mean("reissued")), "reissued_count": only(count(had("reissued"))),
        "reference_brier": F.when((paired > 0) & (paired == scored), F.avg(F.when(done, square(F.col("seal.reference"))))),
        "small_sample": scored < SMALL_SAMPLE,
    }


def forecast_record(ledger: DataFrame, prior_rate: float) -> DataFrame:
    """A row of all measures for each version, with its missed entries; the reference's only where all scored have one."""
    two = F.max((F.col("final").isNotNull() | F.col("reissued").isNotNull()).cast("int")) == 1
    made = games_of(ledger).groupBy("version").agg(*[c.alias(n) for n, c in measures(two, prior_rate).items()])
    missed = ledger.where("entry = 'missed'").groupBy("version").agg(F.count("*").alias("missed"))
    return made.join(missed, "version", "left").withColumn("missed", F.coalesce("missed", F.lit(0)))


def revision_record(ledger: DataFrame, revisions: list[int]) -> DataFrame:
    """(version, revision, seal_rows, sealed, scored, brier) for every version with a seal and every revision, even
    those without a row: all seals written under it, and the games whose scored seal was."""
    written = ledger.where(F.col("entry").isin(*SEALS)).groupBy("version", "revision").agg(F.count("*").alias("seal_rows"))
    done = F.col("won").isNotNull()
    scored = games_of(ledger).groupBy("version", F.col("seal.revision").alias("revision")).agg(
        F.count("*").alias("sealed"), F.count("won").alias("scored"), F.avg(F.when(done, F.pow(clamp(F.col("seal.p"), FLOOR) - F.col("won"), F.lit(2)))).alias("brier")
    )
    every = written.select("version").distinct().select("version", F.explode(F.array(*map(F.lit, revisions))).alias("revision"))
    dense = every.join(written, ["version", "revision"], "left").join(scored, ["version", "revision"], "left")
    return dense.fillna(0, ["seal_rows", "sealed", "scored"])
