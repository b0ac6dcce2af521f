"""Queries of ratings, series and simulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlab.functions.scoring import rnd, rnd_sql
from contestlab.operators import folds, simulate
from contestlab.operators.standings import rest_flags, won
from contestlab.plans.registry import registry
from contestlab.sources.views import CONTEST, SIDES, contests, ratable, sides, teams, with_views

QUERIES, ORACLES, query = registry()


def _pooled(s, d):
    """Rated contests in one pool: sides meet across all regions, and a team has one rating."""
    known = teams(s, d).select(F.col("team_id").alias("home_id"))
    return ratable(contests(s, d)).join(known, "home_id", "left_semi").withColumn("pool", F.lit(1))


@query()
def elo_walk(s, d):
    return folds.elo(_pooled(s, d), "pool")


@query()
def kalman_replay(s, d):
    return folds.kalman(_pooled(s, d), "pool")


PAIR = ", pair AS (SELECT team_id, opp_id, (sum((scored > allowed)::INT) + 1) / (count(*) + 2)::DOUBLE AS p FROM rated GROUP BY ALL)"
DP = """, games(team_id, opp_id, p, a, b, q) AS (
  SELECT team_id, opp_id, p, 0, 0, 1.0::DOUBLE FROM pair
  UNION ALL
  SELECT team_id, opp_id, p, a + s, b + 1 - s, sum(q * CASE WHEN s = 1 THEN p ELSE 1 - p END) FROM games, range(2) t(s) WHERE a < 4 AND b < 4 GROUP BY team_id, opp_id, p, a + s, b + 1 - s)"""


@query(
    with_views(CONTEST, SIDES, "rated AS (SELECT * FROM sides WHERE status = 'final' AND scored <> allowed)")
    + PAIR
    + DP
    + f"SELECT team_id, opp_id, {rnd_sql('sum(CASE WHEN a = 4 THEN q ELSE 0 END)')} AS series_win, {rnd_sql('sum(CASE WHEN a = 4 OR b = 4 THEN q * (a + b) ELSE 0 END)')} AS expected_games FROM games GROUP BY 1, 2"
)
def series_exact_dp(s, d):
    """Best of seven for every pair that has met, at the smoothed share of its past wins."""
    pairs = sides(ratable(contests(s, d))).groupBy("team_id", "opp_id").agg(((F.sum(won()) + 1) / (F.count("*") + 2)).alias("p"))
    return pairs.select("team_id", "opp_id", rnd(simulate.series_win(F.col("p"))).alias("series_win"), rnd(simulate.expected_games(F.col("p"))).alias("expected_games"))


@query()
def season_monte_carlo(s, d):
    """The last season's scheduled contests played out from ratings of mean margin and its standard error."""
    games = contests(s, d)
    played = sides(ratable(games)).groupBy("team_id").agg(F.sum(won()).alias("wins"), F.avg(F.col("scored") - F.col("allowed")).alias("m"), F.stddev_samp(F.col("scored") - F.col("allowed")).alias("e"), F.count("*").alias("n"))
    strength = played.join(teams(s, d), "team_id").select("team_id", "conference", "wins", F.col("m").alias("mean"), (F.coalesce("e", F.lit(10.0)) / F.sqrt("n")).alias("sd"))
    left = games.where("status = 'scheduled'").join(strength.select(F.col("team_id").alias("home_id")), "home_id", "left_semi").join(strength.select(F.col("team_id").alias("away_id")), "away_id", "left_semi")
    return simulate.season(strength, left.groupBy("home_id", "away_id").agg(F.count("*").alias("n")))


@query()
def kalman_by_day(s, d):
    """Ratings as above, every day's contests priced before the first of them is learned, with a day's rest worth 1.5."""
    rows = _pooled(s, d)
    rest = rest_flags(sides(rows)).where("back_to_back = 1").select("game_id", "team_id", F.lit(1.5).alias("tired"))
    home = rows.join(rest.withColumnsRenamed({"team_id": "home_id", "tired": "_h"}), ["game_id", "home_id"], "left")
    both = home.join(rest.withColumnsRenamed({"team_id": "away_id", "tired": "_a"}), ["game_id", "away_id"], "left").dropDuplicates(["game_id"])
    points = F.coalesce("_a", F.lit(0.0)) - F.coalesce("_h", F.lit(0.0))
    return folds.kalman(both.withColumn("rest", points), "pool", adjust="rest", by_day=True)


@query()
def series_uncertainty(s, d):
    """The range of each pair's series chance, from the mean margin and its standard error."""
    m = F.col("scored") - F.col("allowed")
    pairs = sides(ratable(contests(s, d))).groupBy("team_id", "opp_id").agg(F.avg(m).alias("m"), F.coalesce(F.stddev_samp(m) / F.sqrt(F.count("*")), F.lit(10.0)).alias("e"))
    return pairs.select("team_id", "opp_id", simulate.series_uncertainty(F.struct("team_id", "opp_id"), F.col("m"), F.col("e"), draws=200).alias("p")).select("team_id", "opp_id", "p.*")
