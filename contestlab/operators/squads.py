"""Teams as they stood: season snapshots with their rotation, reports held against a day's slate, absent players by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestlab.operators.audits import broken_rules
from contestlab.operators.relations import bounded_shares
from contestlab.operators.rules import outside

# What a snapshot holds, and which of its figures can be right.
LEAST_GAMES, MOST_PLAYERS, ROTATION, PLAYER_CAP = 10, 10, 240.0, 40.0
NET_BOUNDS, MOST_MPG, ROTATION_TOLERANCE = (-15, 20), 44, 1e-4
BASE_RATING, RATING_PER_POINT = 1500, 35
LEFTOVER_POINTS = 0.05  # absence points that no named player explains, from which they are worth a line


def team_snapshots(players: DataFrame, ratings: DataFrame) -> DataFrame:
    """(season, team_id, net, rating, players): each rated team's season with its rotation.

    players(season, team_id, athlete_id, games, mpg); ratings(season, team_id, net). Of athletes with LEAST_GAMES games the
    MOST_PLAYERS of most minutes share ROTATION minutes by minutes a game, none above the cap; the list of (athlete_id,
    mpg, minutes) is so bounded before it is built, and empty for a team without such an athlete."""
    place = F.row_number().over(Window.partitionBy("season", "team_id").orderBy(F.desc("mpg"), "athlete_id"))
    held = players.where(F.col("games") >= LEAST_GAMES).withColumn("place", place).where(F.col("place") <= MOST_PLAYERS).withColumn("squad", F.concat_ws("-", "season", "team_id"))
    shared = bounded_shares(held, "squad", "mpg", "athlete_id", ROTATION, PLAYER_CAP)
    listed = shared.groupBy("season", "team_id").agg(F.sort_array(F.collect_list(F.struct("place", "athlete_id", "mpg", F.col("share").alias("minutes")))).alias("players"))
    met = ratings.join(listed, ["season", "team_id"], "left")
    return met.select("season", "team_id", "net", (BASE_RATING + RATING_PER_POINT * F.col("net")).alias("rating"), F.coalesce("players", F.array().cast(listed.schema["players"].dataType)).alias("players"))


def snapshot_anomalies(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """(season, team_id, rule): snapshots with figures that can't be right, and wanted(season, team_id) without one."""
    total = F.aggregate("players", F.lit(0.0), lambda a, x: a + x["minutes"])
    odd = broken_rules(snapshots, ["season", "team_id"], {
        "net rating not plausible": outside(F.col("net"), *NET_BOUNDS),
        "no qualifying players": F.size("players") == 0,
        "rotation doesn't add up": F.abs(total - ROTATION) > ROTATION_TOLERANCE,
        "minutes a game not plausible": F.exists("players", lambda x: x["mpg"] > MOST_MPG),
        "minutes above the cap": F.exists("players", lambda x: x["minutes"] > PLAYER_CAP),
    })
    missing = wanted.select("season", "team_id").distinct().join(snapshots, ["season", "team_id"], "left_anti")
    return odd.unionByName(missing.withColumn("rule", F.lit("no snapshot")))


def slate_reports(games: DataFrame, rows: DataFrame) -> DataFrame:
    """(day, games, shown, usable, listed, not_submitted, unlisted): each day's report as far as it is about the day's slate.

    games(day, home_id, away_id); rows(day, team_id, player, status). Rows of other teams don't count. A game is shown if
    either side has a row; a report that shows less than half of the games is not usable. listed: rows with a player and a
    status; not_submitted: teams with a row without; unlisted: teams without a row; both in order. Rows are counted by day and
    team before they meet the slate, so what is collected is a day's teams."""
    named = F.col("player").isNotNull() & F.col("status").isNotNull()
    told = rows.groupBy("day", "team_id").agg(F.count(F.when(named, 1)).alias("listed"), F.max(~named).alias("open"))
    teams = games.select("day", F.explode(F.array("home_id", "away_id")).alias("team_id")).distinct().join(told, ["day", "team_id"], "left")
    by = teams.groupBy("day").agg(
        F.coalesce(F.sum("listed"), F.lit(0)).alias("listed"), F.sort_array(F.collect_list(F.when(F.col("open"), F.col("team_id")))).alias("not_submitted"),
        F.sort_array(F.collect_list(F.when(F.col("listed").isNull(), F.col("team_id")))).alias("unlisted"),
    )
    seen = told.select("day", "team_id")
    home, away = (seen.withColumnRenamed("team_id", f"{n}_id").withColumn(n, F.lit(1)) for n in ("home", "away"))
    met = games.join(home, ["day", "home_id"], "left").join(away, ["day", "away_id"], "left")
    shown = met.groupBy("day").agg(F.count("*").alias("games"), F.count(F.coalesce("home", "away")).alias("shown"))
    return shown.join(by, "day").select("day", "games", "shown", (F.col("shown") * 2 >= F.col("games")).alias("usable"), "listed", "not_submitted", "unlisted")


def absence_sides(sides: DataFrame, drivers: DataFrame, report: DataFrame) -> DataFrame:
    """(game_id, team_id, points, filing, status, players, known, others, left_over): a side's absent players by status.

    sides(game_id, team_id, points, complete, unfiled, not_submitted); drivers(game_id, team_id, athlete_id, status,
    points): who the number counts; report(game_id, team_id, athlete_id, status): who the report names, of several rows on one
    athlete the least status. Where the stored
    drivers are not complete, the report's others are listed without points, and what the stored ones leave of the side's
    points is theirs (left_over; null where nothing is left to tell). One row for each status of a side, null for none, and one
    with a null count for a side without players."""
    stored = drivers.select("game_id", "team_id", "athlete_id", "status", "points", F.lit(True).alias("stored"))
    named = report.select("game_id", "team_id", "athlete_id", "status", F.lit(None).cast("double").alias("points"), F.lit(False).alias("stored"))
    return absence_sides_of(sides, stored.unionByName(named))


def absence_sides_of(sides: DataFrame, listed: DataFrame) -> DataFrame:
    """The same from listed(game_id, team_id, athlete_id, status, points, stored), where a stored row need not be listed
    again as one that the report names.

    What is listed is shuffled once, by side: in it an athlete's first row, stored ones before others and then by status,
    stands for the athlete unless it is stored, and counts and sums are of a side's rows."""
    keys = ["game_id", "team_id"]
    # An athlete without an id is no stored one.
    athlete = Window.partitionBy(*keys, "athlete_id", F.col("stored") & F.col("athlete_id").isNull()).orderBy(F.desc("stored"), F.asc_nulls_last("status"))
    told = listed.repartition(*keys).withColumn("_first", F.row_number().over(athlete)).where(F.col("stored") | (F.col("_first") == 1))
    held = F.when(F.col("stored"), F.col("points"))
    groups = told.groupBy(*keys, "status").agg(F.count(F.when(F.col("stored"), 1)).alias("_stored"), F.count(F.when(~F.col("stored"), 1)).alias("_rest"), F.coalesce(F.sum(held), F.lit(0.0)).alias("known"))
    side = Window.partitionBy(*keys)
    groups = groups.withColumns({"_known": F.sum("known").over(side), "_others": F.sum("_rest").over(side)}).withColumnsRenamed({k: f"_{k}" for k in keys})
    own = (F.col("game_id") == F.col("_game_id")) & (F.col("team_id") == F.col("_team_id"))
    met = sides.join(groups, own & (~F.col("complete") | (F.col("_stored") > 0)), "left")
    others = F.when(F.col("complete"), 0).otherwise(F.coalesce("_others", F.lit(0))).cast("long")
    left = F.greatest(F.lit(0.0), F.col("points") - F.coalesce("_known", F.lit(0.0)))
    over = F.when(~F.col("complete") & ((others > 0) | (left >= LEFTOVER_POINTS)), left)
    filing = F.when(F.col("complete") & F.col("unfiled"), "unfiled, counted").when(~F.col("complete") & F.col("not_submitted"), "unfiled, nobody counted").otherwise("filed")
    players = F.col("_stored") + F.when(F.col("complete"), 0).otherwise(F.col("_rest"))
    return met.select(*keys, "points", filing.alias("filing"), "status", players.alias("players"), "known", others.alias("others"), over.alias("left_over"))
