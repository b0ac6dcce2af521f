"""When a forecast is sealed, missed, stale or due: the job's clock rules as Columns and windows over an append-only ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINAL_MINUTES, WAIT_MINUTES = 60, 360  # before the start: when a final seal is due, and until when others are waited for
FALLBACK_HOURS = WAIT_MINUTES // 60
ROLL_HOUR = 6  # of its day, from when a contest may be sealed
BLOCKING_DAYS = 2  # days before a contest's on which an open one holds it up; older ones are stuck and don't
CLOSED_DAYS = 3  # days from a contest's on after which nothing about it matters
LEAD_HOURS = 6  # of a contest's start after the first row on it, beside the row's own hours
OPEN_STATUSES = ("scheduled", "in-progress")


def decision(minutes_to_start: Column, has_first: Column, has_final: Column, blockers: Column) -> Column:
    """What to do with a contest now: `missed` once it has begun with a first seal but no final one, `final` within the last
    hour (once), `wait` while earlier contests of its teams are open, but from six hours before the start `incomplete`,
    `morning` when nothing is in the way, null when nothing is due."""
    begun = minutes_to_start <= 0
    return (
        F.when(begun, F.when(has_first & ~has_final, "missed"))
        .when(minutes_to_start <= FINAL_MINUTES, F.when(~has_final, "final"))
        .when(has_first, None)
        .when(blockers == 0, "morning")
        .when(minutes_to_start <= WAIT_MINUTES, "incomplete")
        .otherwise("wait")
    )


def seal_times(feed: DataFrame) -> DataFrame:
    """feed(team, at, ord, game, status, hours) -> (team, game, decision, at, incomplete): when each contest is sealed.

    `morning` at the first instant at which it is scheduled and either its day has begun and no open contest of its team of
    the two days before is in the way, or its start is within six hours; `final` once, at the first instant of the last
    hour at which it is scheduled; `missed` at its start if it has a morning seal but no final one. incomplete: something
    was in the way. A rule can come true only with a row of the team or at four instants of the contest's own, so these
    are looked at, day by day of a team: joins on team and day, with a range within the day.
    """
    span = Window.partitionBy("team", "game").orderBy("at", "ord")
    first = Window.partitionBy("team", "game").orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hours = lambda n: F.make_dt_interval(hours=n)
    # The last of a contest's rows at one instant holds, until its next one.
    rows = feed.withColumns({"known": F.first("at").over(first), "lead": F.first("hours").over(first), "until": F.lead("at").over(span)})
    rows = rows.withColumn("start", F.col("known") + hours(F.col("lead") + LEAD_HOURS)).withColumn("day", F.to_date("start"))
    states = rows.where("until is null OR until > at").select("team", "game", "day", "at", "until", "status")
    games = rows.select("team", "game", "known", "start", "day").distinct()
    opens = F.col("day").cast("timestamp") + hours(F.lit(ROLL_HOUR))
    own = games.select("*", F.explode(F.array("known", opens, F.col("start") - hours(F.lit(FALLBACK_HOURS)), F.col("start") - F.make_dt_interval(mins=F.lit(FINAL_MINUTES)))).alias("now"))
    days = games.withColumn("date", F.explode(F.sequence(F.to_date("known"), F.to_date("start"))))
    others = days.join(feed.select("team", F.to_date("at").alias("date"), F.col("at").alias("now")), ["team", "date"]).drop("date")
    instants = own.unionByName(others).where("now >= known AND now < start").distinct()
    now = instants.join(states.select("team", "game", "at", "until", "status"), ["team", "game"]).where("at <= now AND (until is null OR now < until) AND status = 'scheduled'")
    now = now.drop("at", "until", "status")
    before = now.withColumn("other_day", F.explode(F.array(*[F.date_sub("day", n) for n in range(1, BLOCKING_DAYS + 1)])))
    held = states.where(F.col("status").isin(*OPEN_STATUSES)).select("team", F.col("day").alias("other_day"), "at", "until")
    blocked = before.join(held, ["team", "other_day"]).where("at <= now AND (until is null OR now < until)").select("team", "game", "now").distinct()
    looked = now.join(blocked.withColumn("blocked", F.lit(True)), ["team", "game", "now"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    morning = ((F.col("now") >= opens) & ~F.col("blocked")) | (F.col("now") >= F.col("start") - hours(F.lit(FALLBACK_HOURS)))
    final = F.col("now") >= F.col("start") - F.make_dt_interval(mins=F.lit(FINAL_MINUTES))
    seal = F.struct(F.col("now").alias("at"), F.col("blocked").alias("incomplete"))
    found = looked.groupBy("team", "game", "start").agg(F.min(F.when(morning, seal)).alias("morning"), F.min(F.when(final, seal)).alias("final"))
    missed = F.when(F.col("final").isNull(), F.struct(F.col("start").alias("at"), F.lit(False).alias("incomplete")))
    kinds = [F.struct(F.lit(n).alias("decision"), c.alias("s")) for n, c in (("morning", F.col("morning")), ("final", F.col("final")), ("missed", missed))]
    made = found.where("morning is not null").select("team", "game", F.explode(F.array(*kinds)).alias("k")).where("k.s is not null")
    return made.select("team", "game", "k.decision", "k.s.at", "k.s.incomplete")


def order_rules(ledger: DataFrame) -> DataFrame:
    """(game, ord, rule): entries that a ledger may not hold. One window per game in the order of appending."""
    w = Window.partitionBy("game").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda *kinds: F.coalesce(F.max(F.col("entry").isin(*kinds).cast("int")).over(before), F.lit(0)) == 1
    again = F.row_number().over(Window.partitionBy("game", "entry").orderBy("ord")) > 1
    seals = ("morning", "reissued", "final")
    rules = F.array(
        F.when(again & (F.col("entry") != "result"), "repeated"),
        F.when((F.col("entry") == "result") & ~seen(*seals), "result without seal"),
        F.when((F.col("entry") == "final") & seen("result"), "sealed after result"),
        F.when((F.col("entry") == "reissued") & ~seen("morning"), "reissued without morning"),
        F.when((F.col("entry") == "missed") & seen("final"), "missed after final"),
        F.when((F.col("p") < 0) | (F.col("p") > 1), "chance out of bounds"),
    )
    found = ledger.withColumn("rules", F.filter(rules, lambda x: x.isNotNull()))
    return found.select("game", "ord", F.explode("rules").alias("rule"))


def alerts(days: DataFrame) -> DataFrame:
    """days(rows, matched, rejected, stale_hours, report_hours) with the list of alerts that are due."""
    rules = F.array(
        F.when(F.col("rejected") >= 3, "rejections"),
        F.when(F.col("report_hours") > 3, "no report"),
        F.when(F.col("stale_hours") >= 3, "stale"),
        F.when((F.col("rows") >= 10) & (F.col("matched") * 2 < F.col("rows")), "match share"),
    )
    return days.withColumn("alerts", F.array_join(F.filter(rules, lambda x: x.isNotNull()), ", "))


def is_stale(age_hours: Column, game_day: Column) -> Column:
    return age_hours > F.when(game_day, 12).otherwise(36)


def last_streak(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """For each key how many of its last rows in a row failed."""
    w = Window.partitionBy(key).orderBy(*order)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    good_later = F.coalesce(F.max((~failed).cast("int")).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.lit(0))
    return rows.withColumns({"_g": good_later, "_n": F.count("*").over(after)}).groupBy(key).agg(F.sum((F.col("_g") == 0).cast("long")).alias("streak"), F.count("*").alias("rows"))


def checkpoints(days: DataFrame, key: str, day: str, step: int = 21) -> DataFrame:
    """days with the latest checkpoint at or before them: the first day of the key and every `step` days from it."""
    first = F.min(day).over(Window.partitionBy(key))
    return days.withColumn("checkpoint", F.date_add(first, F.floor(F.datediff(day, first) / step).cast("int") * step))


def step_values(rows: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """One row for each key and day with the value summed over all earlier days: what was known before that day's first."""
    each = rows.groupBy(*by, day).agg(F.sum(value).alias("_v"), F.count("*").alias("contests"))
    before = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*by, day, "contests", F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("before"))


def limited(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key, with how many more there are."""
    n = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumns({"place": place, "over": F.greatest(F.lit(0), n - most)}).where(F.col("place") <= most)


def two_pass_match(rows: DataFrame, known: DataFrame, key: str, fallback: str, result: str) -> DataFrame:
    """rows with `result` of known by the full key where that is one row, else by the fallback key where among the known
    rows that no full key used there is exactly one."""
    full = known.groupBy(key).agg(F.min(result).alias("_a"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    first = rows.join(full, key, "left")
    unused = known.join(rows.select(key).distinct(), key, "left_anti")
    rest = unused.groupBy(fallback).agg(F.min(result).alias("_b"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return first.join(rest, fallback, "left").withColumn(result, F.coalesce("_a", "_b")).drop("_a", "_b")
