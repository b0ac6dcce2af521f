"""Nested JSON payloads read by schema: what doesn't fit is told by a reason, never dropped in silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlab.functions import fields as P
from contestlab.functions.scoring import implied_probability, without_margin

EVENT = """id string, date string, competitions array<struct<neutralSite:boolean, status:struct<type:struct<name:string>, displayClock:string, period:int>,
competitors:array<struct<homeAway:string, team:struct<abbreviation:string>, score:string, linescores:array<struct<value:double>>>>,
odds:array<struct<homeTeamOdds:struct<moneyLine:int>, awayTeamOdds:struct<moneyLine:int>>>, notes:array<struct<headline:string>>,
broadcasts:array<struct<market:string, names:array<string>>>>>"""
BOX = "labels array<string>, athletes array<struct<id:long, stats:array<string>>>"
STANDING = "team string, stats array<struct<name:string, value:double>>"
INJURIES = "team string, injuries array<struct<athlete:string, status:string, date:string, details:struct<type:string>>>"


def _first(items: Column, test) -> Column:
    return F.try_element_at(F.filter(items, test), F.lit(1))


def events(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with an event's fields: event_id, starts, status, clock, period, neutral, home, away, their scores and line
    sums, p_home (odds without their margin), round, conference, and reason: why it can't be used, null if it can."""
    read = rows.withColumn("e", F.from_json(payload, EVENT)).withColumn("c", F.try_element_at("e.competitions", F.lit(1)))
    side = lambda which: _first(F.col("c.competitors"), lambda x: x["homeAway"] == which)
    read = read.withColumns({"h": side("home"), "a": side("away"), "odds": F.try_element_at("c.odds", F.lit(1)), "note": F.try_element_at("c.notes", F.lit(1))["headline"]})
    score = lambda s: F.col(s)["score"].try_cast("int")
    lines = lambda s: F.aggregate(F.coalesce(F.transform(F.col(s)["linescores"], lambda x: x["value"]), F.array().cast("array<double>")), F.lit(0.0), lambda t, x: t + x).cast("long")
    state = P.status(F.col("c.status.type.name"))
    reason = (
        F.when(F.col("e.id").isNull(), "unreadable").when(F.col("c").isNull(), "no competition").when(F.col("h").isNull() | F.col("a").isNull(), "sides")
        .when((state == "final") & (score("h").isNull() | score("a").isNull()), "score")
    )
    market = without_margin(implied_probability(F.col("odds.homeTeamOdds.moneyLine")), implied_probability(F.col("odds.awayTeamOdds.moneyLine")))
    made = {
        "event_id": F.col("e.id").try_cast("long"), "starts": F.when(P.is_instant(F.col("e.date")), F.col("e.date")), "status": state, "clock": P.clock_seconds(F.col("c.status.displayClock")), "period": F.col("c.status.period"),
        "neutral": F.coalesce("c.neutralSite", F.lit(False)), "home": F.col("h.team.abbreviation"), "away": F.col("a.team.abbreviation"), "home_score": score("h"), "away_score": score("a"),
        "home_lines": lines("h"), "away_lines": lines("a"), "p_home": market, "round": P.round_of(F.col("note")), "conference": P.conference_of(F.col("note")), "reason": reason,
    }
    return read.select(*rows.columns, *[v.alias(k) for k, v in made.items()], broadcasts(F.col("c.broadcasts")).alias("channels"))


def broadcasts(items: Column, most: int = 2) -> Column:
    """National channels, or else the others; each once, at most two, joined."""
    of = lambda test: F.flatten(F.transform(F.filter(items, test), lambda b: b["names"]))
    national = of(lambda b: b["market"] == "national")
    return F.array_join(F.slice(F.array_distinct(F.when(F.size(national) > 0, national).otherwise(of(lambda b: b["market"] != "national"))), 1, most), ", ")


def box_scores(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with a line for each athlete: minutes in seconds, field goals made and attempted, points, and signed, whatever
    the order of the labels; a missing label or an unreadable entry is null."""
    read = rows.withColumn("b", F.from_json(payload, BOX)).select(*rows.columns, F.col("b.labels").alias("labels"), F.explode("b.athletes").alias("x"))
    stat = lambda label: F.when(F.array_position("labels", label) > 0, F.try_element_at("x.stats", F.array_position("labels", label).cast("int")))
    shots = P.made_attempted(stat("FG"))
    return read.select(
        *rows.columns, F.col("x.id").alias("athlete_id"), P.clock_seconds(stat("MIN")).alias("seconds"), shots["made"].alias("made"), shots["attempted"].alias("attempted"), stat("PTS").try_cast("int").alias("points"),
        F.when(stat("+/-").rlike(r"^[+-]?[0-9]+$"), stat("+/-").try_cast("int")).alias("signed"),
    )


def standings(rows: DataFrame, names: tuple[str, ...], payload: str = "payload") -> DataFrame:
    """(team, one column for each name): key and value pairs turned into columns, missing ones null."""
    read = rows.select(F.from_json(payload, STANDING).alias("s")).select("s.team", F.map_from_entries(F.transform("s.stats", lambda x: F.struct(x["name"], x["value"]))).alias("m"))
    return read.select("team", *[F.try_element_at("m", F.lit(n)).cast("long").alias(n) for n in names])


def injuries(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(team, athlete, status, day, kind) for each listed athlete with a known status; unnamed ones are left out."""
    read = rows.select(F.from_json(payload, INJURIES).alias("p")).select("p.team", F.explode("p.injuries").alias("i"))
    return read.where("i.athlete IS NOT NULL AND i.status IN ('Out', 'Doubtful', 'Questionable', 'Probable')").select(
        "team", F.col("i.athlete").alias("athlete"), F.col("i.status").alias("status"), F.substring("i.date", 1, 10).alias("day"), P.absence_class(F.coalesce("i.details.type", F.lit(""))).alias("kind")
    )
