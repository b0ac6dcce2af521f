"""Contest data drawn from the star-schema tables, as DataFrames and as SQL for the oracle.

A contest is an order: the customer's nation is at home, the nation of the first line's supplier is away, and the
scores are the quantities of its open and of its closed lines. Quantities are whole numbers, so scores are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, season, game_date, status, home_id, away_id, home_score, away_score, neutral), no side against itself."""
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)).cast("long").alias("home_score"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)).cast("long").alias("away_score"),
        F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).getField("l_suppkey").alias("first_supplier"),
    )
    status = F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "P", "in-progress").otherwise("scheduled")
    return (
        t("orders")
        .join(line, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t("customer").select("c_custkey", F.col("c_nationkey").alias("home_id")), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("away_id")), F.col("first_supplier") == F.col("s_suppkey"))
        .where("home_id <> away_id")
        .select(
            F.col("o_orderkey").alias("game_id"),
            F.year("o_orderdate").alias("season"),
            F.to_date("o_orderdate").alias("game_date"),
            status.alias("status"),
            "home_id",
            "away_id",
            "home_score",
            "away_score",
            (F.col("o_orderpriority") == "5-LOW").alias("neutral"),
        )
    )


def ratable(games: DataFrame) -> DataFrame:
    """Finished contests with a winner."""
    return games.where("status = 'final' AND home_score <> away_score")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(team_id, team, conference, division)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team"), F.col("r_name").alias("conference"), (F.col("n_nationkey") % 2).alias("division")
    )


def sides(games: DataFrame) -> DataFrame:
    """Each contest once for either side: team_id, opp_id, is_home, scored, allowed and the contest's own columns."""
    shared = [c for c in games.columns if c not in ("home_id", "away_id", "home_score", "away_score")]
    pair = F.array(
        F.struct(F.col("home_id").alias("team_id"), F.col("away_id").alias("opp_id"), F.lit(True).alias("is_home"), F.col("home_score").alias("scored"), F.col("away_score").alias("allowed")),
        F.struct(F.col("away_id").alias("team_id"), F.col("home_id").alias("opp_id"), F.lit(False).alias("is_home"), F.col("away_score").alias("scored"), F.col("home_score").alias("allowed")),
    )
    return games.select(*shared, F.explode(pair).alias("s")).select(*shared, "s.*")


def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as appearances: (game_id, athlete_id, side, minutes, points, starter, line_no, supplier)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_partkey").alias("athlete_id"),
        F.when(F.col("l_linestatus") == "O", "home").otherwise("away").alias("side"),
        F.col("l_quantity").cast("long").alias("minutes"),
        F.floor(F.col("l_extendedprice") / 1000).cast("long").alias("points"),
        (F.col("l_linenumber") <= 2).alias("starter"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("supplier"),
    )


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as plays: (event_id, ts, user_id, kind, value, k)."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append-only ledger: (ord, happened, game, entry, p, won); several entries of a kind may name one game."""
    entry = F.create_map(*[F.lit(x) for x in ("signup", "morning", "view", "reissued", "purchase", "final", "error", "missed", "click", "result")])
    return plays(spark, sf_dir).select(
        F.col("event_id").alias("ord"),
        F.col("ts").alias("happened"),
        F.concat_ws("-", "user_id", "k").alias("game"),
        entry[F.col("kind")].alias("entry"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 500)).alias("p"),
        (F.floor("value") % 2 == 1).cast("int").alias("won"),
    )


def status_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what users' contests are at an instant: (team, at, ord, game, status, hours)."""
    status = F.create_map(*[F.lit(x) for x in ("signup", "scheduled", "view", "scheduled", "purchase", "in-progress", "error", "delayed", "click", "final")])
    return plays(spark, sf_dir).select(
        F.col("user_id").alias("team"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"),
        F.concat_ws("-", "user_id", F.col("k") % 20).alias("game"), status[F.col("kind")].alias("status"), F.col("k").alias("hours"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as forecasts: (id, season, round, flag, p, p2, y)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 8).alias("season"),
        F.col("lang").alias("round"),
        F.col("toxic").alias("flag"),
        (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"),
        F.lit(0.75).cast("double").alias("p2"),
        F.col("quality").alias("y"),
    )


CONTEST = """
line AS (
  SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END)::BIGINT AS home_score,
         sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END)::BIGINT AS away_score,
         arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS first_supplier
  FROM lineitem GROUP BY l_orderkey),
contest AS (
  SELECT o_orderkey AS game_id, year(o_orderdate)::INT AS season, o_orderdate::DATE AS game_date,
         CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'P' THEN 'in-progress' ELSE 'scheduled' END AS status,
         c_nationkey AS home_id, s_nationkey AS away_id, home_score, away_score, o_orderpriority = '5-LOW' AS neutral
  FROM orders JOIN line ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON first_supplier = s_suppkey
  WHERE c_nationkey <> s_nationkey),
ratable AS (SELECT * FROM contest WHERE status = 'final' AND home_score <> away_score)"""

SIDES = """
sides AS (
  SELECT game_id, season, game_date, status, neutral, home_id AS team_id, away_id AS opp_id, true AS is_home, home_score AS scored, away_score AS allowed FROM contest
  UNION ALL
  SELECT game_id, season, game_date, status, neutral, away_id, home_id, false, away_score, home_score FROM contest)"""

TEAM = """
team AS (
  SELECT n_nationkey AS team_id, n_name AS team, r_name AS conference, n_nationkey % 2 AS division
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

BOX = """
box AS (
  SELECT l_orderkey AS game_id, l_partkey AS athlete_id, CASE WHEN l_linestatus = 'O' THEN 'home' ELSE 'away' END AS side,
         l_quantity::BIGINT AS minutes, floor(l_extendedprice / 1000)::BIGINT AS points, l_linenumber <= 2 AS starter,
         l_linenumber AS line_no, l_suppkey AS supplier
  FROM lineitem)"""

PLAY = """
play AS (
  SELECT event_id, ts, user_id, event_type AS kind, value, json_extract_string(props, '$.k')::INT AS k FROM events)"""

LEDGER = """
ledger AS (
  SELECT event_id AS ord, ts AS happened, user_id || '-' || k AS game,
         CASE kind WHEN 'signup' THEN 'morning' WHEN 'view' THEN 'reissued' WHEN 'purchase' THEN 'final' WHEN 'error' THEN 'missed' ELSE 'result' END AS entry,
         least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 500)) AS p, (floor(value)::BIGINT % 2 = 1)::INT AS won
  FROM play)"""

FEED = """
feed AS (
  SELECT user_id AS team, ts AS happened, event_id AS ord, user_id || '-' || k % 20 AS game,
         CASE kind WHEN 'purchase' THEN 'in-progress' WHEN 'error' THEN 'delayed' WHEN 'click' THEN 'final' ELSE 'scheduled' END AS status, k AS hours
  FROM play)"""

PREDICTION = """
prediction AS (
  SELECT doc_id AS id, doc_id % 8 AS season, lang AS round, toxic AS flag, n_chars / (n_chars + 1500.0::DOUBLE) AS p, 0.75::DOUBLE AS p2, quality AS y
  FROM documents JOIN labels USING (doc_id))"""


def with_views(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)
