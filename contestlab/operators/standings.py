"""Records of teams: standings, head to head, series and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.session import cut_lineage


def won() -> Column:
    return (F.col("scored") > F.col("allowed")).cast("long")


def records(side_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Wins, losses, home wins and point differential by keys; ties count for neither."""
    return side_rows.groupBy(*keys).agg(
        F.sum(won()).alias("wins"),
        F.sum((F.col("scored") < F.col("allowed")).cast("long")).alias("losses"),
        F.sum(F.when(F.col("is_home"), won()).otherwise(0)).alias("home_wins"),
        F.sum(F.col("scored") - F.col("allowed")).alias("diff"),
    )


def standings(side_rows: DataFrame, team_rows: DataFrame, by: str = "season") -> DataFrame:
    """Records with conference and division records beside, ranked within the conference: ties share the better rank.

    One shuffle on (by, team); the dimension is joined to both sides of each contest."""
    own = side_rows.join(team_rows, "team_id")
    other = team_rows.select(F.col("team_id").alias("opp_id"), F.col("conference").alias("_oc"), F.col("division").alias("_od"))
    own = own.join(other, "opp_id")
    same = F.col("conference") == F.col("_oc")
    table = own.groupBy(by, "team_id", "team", "conference").agg(
        F.sum(won()).alias("wins"),
        F.sum(1 - won()).alias("losses"),
        F.sum(F.when(same, won()).otherwise(0)).alias("conf_wins"),
        F.sum(F.when(same & (F.col("division") == F.col("_od")), won()).otherwise(0)).alias("div_wins"),
        F.sum(F.col("scored") - F.col("allowed")).alias("diff"),
    )
    order = Window.partitionBy(by, "conference").orderBy(F.desc(F.col("wins") / (F.col("wins") + F.col("losses"))), F.desc("diff"))
    return table.withColumn("place", F.rank().over(order))


def series_of_pairs(games: DataFrame) -> DataFrame:
    """Each unordered pair's season series: wins of the smaller and of the larger id, first host, first and last date."""
    low, high = F.least("home_id", "away_id"), F.greatest("home_id", "away_id")
    low_won = (F.col("home_score") > F.col("away_score")) == (F.col("home_id") == low)
    return games.withColumns({"low_id": low, "high_id": high, "_w": low_won.cast("long")}).groupBy("season", "low_id", "high_id").agg(
        F.sum("_w").alias("low_wins"),
        F.sum(1 - F.col("_w")).alias("high_wins"),
        F.min_by("home_id", F.struct("game_date", "game_id")).alias("first_host"),
        F.min("game_date").cast("string").alias("first_date"),
        F.max("game_date").cast("string").alias("last_date"),
    )


def running_series(games: DataFrame) -> DataFrame:
    """The series score of the pair before each contest, and the contest's number in it."""
    low = F.least("home_id", "away_id")
    rows = games.withColumns({"low_id": low, "high_id": F.greatest("home_id", "away_id")})
    rows = rows.withColumn("_w", ((F.col("home_score") > F.col("away_score")) == (F.col("home_id") == F.col("low_id"))).cast("long"))
    order = Window.partitionBy("season", "low_id", "high_id").orderBy("game_date", "game_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "game_id", "season", "low_id", "high_id",
        F.row_number().over(order).cast("long").alias("game_number"),
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("low_before"),
        F.coalesce(F.sum(1 - F.col("_w")).over(before), F.lit(0)).alias("high_before"),
    )


def rest_flags(side_rows: DataFrame) -> DataFrame:
    """Days since the team's last contest of the season (-1 for its first), and whether it played the day before."""
    order = Window.partitionBy("team_id", "season").orderBy("game_date", "game_id")
    rest = F.datediff("game_date", F.lag("game_date").over(order))
    return side_rows.select("game_id", "team_id", "season", F.coalesce(rest.cast("long"), F.lit(-1)).alias("rest_days"), F.coalesce((rest == 1).cast("int"), F.lit(0)).alias("back_to_back"))


def streaks(side_rows: DataFrame) -> DataFrame:
    """Runs of losses by gaps and islands: length, first and last date, and whether the season ended in it."""
    order = Window.partitionBy("team_id", "season").orderBy("game_date", "game_id")
    inside = Window.partitionBy("team_id", "season", "_lost").orderBy("game_date", "game_id")
    rows = side_rows.withColumn("_lost", (F.col("scored") < F.col("allowed")).cast("int"))
    rows = rows.withColumns({"_island": F.row_number().over(order) - F.row_number().over(inside), "_open": F.lead("game_id").over(order).isNull().cast("int")})
    return rows.where("_lost = 1").groupBy("team_id", "season", "_island").agg(
        F.count("*").alias("length"), F.min("game_date").cast("string").alias("first_date"), F.max("game_date").cast("string").alias("last_date"), F.max("_open").alias("still_open")
    ).drop("_island")


def prior_rate(season_counts: DataFrame, hits: str, total: str, order: str, back: int | None = None) -> DataFrame:
    """hits / total over strictly earlier values of `order`, all of them or those at most `back` before."""
    window = Window.orderBy(order).rangeBetween(Window.unboundedPreceding if back is None else -back, -1)
    return season_counts.withColumn("prior_rate", F.try_divide(F.sum(hits).over(window).cast("double"), F.sum(total).over(window)))


def as_of_date(games: DataFrame, day: str) -> DataFrame:
    """What a reader of that day could know: results of earlier days, the later ones as scheduled."""
    later = F.col("game_date") >= F.to_date(F.lit(day))
    return games.withColumns(
        {
            "status": F.when(later, F.lit("scheduled")).otherwise(F.col("status")),
            "home_score": F.when(later, F.lit(None).cast("long")).otherwise(F.col("home_score")),
            "away_score": F.when(later, F.lit(None).cast("long")).otherwise(F.col("away_score")),
        }
    )


def blocking(games: DataFrame, horizon: int = 3) -> DataFrame:
    """For each date with scheduled contests, the unfinished ones of the `horizon` days before it.

    Each unfinished contest names the days it blocks, so the range join is an equality join."""
    days = games.where("status = 'scheduled'").select(F.col("game_date").alias("target")).distinct()
    open_games = games.where("status <> 'final'").select("game_id", F.explode(F.sequence(F.date_add("game_date", 1), F.date_add("game_date", horizon))).alias("target"))
    return days.join(open_games, "target", "left").groupBy("target").agg(F.count("game_id").alias("blockers"), F.min("game_id").alias("first_blocker"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: int = 0) -> DataFrame:
    """Full outer comparison of two summaries: missing-left, missing-right, differs or agrees."""
    a, b = left.withColumnRenamed(value, "left_value"), right.withColumnRenamed(value, "right_value")
    status = (
        F.when(F.col("left_value").isNull(), "missing-left")
        .when(F.col("right_value").isNull(), "missing-right")
        .when(F.abs(F.col("left_value") - F.col("right_value")) > tolerance, "differs")
        .otherwise("agrees")
    )
    return a.join(b, keys, "full_outer").withColumn("verdict", status)


def adjusted_net(side_rows: DataFrame, sweeps: int = 10) -> DataFrame:
    """Damped fixed point of opponent-adjusted margin: r = (r + net + mean opponent's r) / 2, in `sweeps` rounds.

    Contests are read once: the graph's edges are pairs of teams, written before the first round. Each round is one join
    of pairs with teams whose result is written, so plans stay of one size."""
    edges = side_rows.groupBy("team_id", "opp_id").agg(F.count("*").alias("w"), F.sum(F.col("scored") - F.col("allowed")).alias("m"))
    edges = cut_lineage(edges)
    net = edges.groupBy("team_id").agg((F.sum("m") / F.sum("w")).alias("net"))
    now = net.select("team_id", "net", F.lit(0.0).alias("r"))
    for _ in range(sweeps):
        other = now.select(F.col("team_id").alias("opp_id"), F.col("r").alias("_o"))
        faced = edges.join(other, "opp_id").groupBy("team_id").agg((F.sum(F.col("w") * F.col("_o")) / F.sum("w")).alias("_f"))
        now = cut_lineage(now.join(faced, "team_id").select("team_id", "net", (F.col("r") * 0.5 + (F.col("net") + F.col("_f")) * 0.5).alias("r")))
    return now
