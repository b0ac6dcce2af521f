"""Queries over teams as they stood: snapshots, a day's reports, absent players."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlab.functions.scoring import rnd, rnd_sql
from contestlab.operators import squads as Q
from contestlab.operators.relations import dealt
from contestlab.plans.registry import registry
from contestlab.sources.views import CONTEST, SIDES, contests, ratable, sides, table, with_views

QUERIES, ORACLES, query = registry()

SNAPSHOT = """
played AS (SELECT year(o_orderdate)::INT AS season, s_nationkey AS team_id, s_suppkey AS athlete_id, count(DISTINCT l_orderkey) AS games, sum(l_quantity) / count(DISTINCT l_orderkey) AS mpg FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
net AS (SELECT season, team_id, avg(scored - allowed) AS net FROM sides WHERE status = 'final' AND scored <> allowed GROUP BY ALL),
held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, team_id ORDER BY mpg DESC, athlete_id) AS place FROM played WHERE games >= 10) WHERE place <= 10),
lev AS (SELECT *, (240 - (place - 1) * 40) / sum(mpg) OVER (PARTITION BY season, team_id ORDER BY mpg DESC, athlete_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM held),
fixed AS (SELECT season, team_id, arg_min(lev, place) AS found FROM lev WHERE lev * mpg <= 40 GROUP BY ALL),
rotation AS (SELECT season, team_id, place, athlete_id, mpg, least(40.0::DOUBLE, coalesce(found * mpg, 40.0::DOUBLE)) AS minutes FROM held LEFT JOIN fixed USING (season, team_id) WHERE EXISTS (SELECT 1 FROM net n WHERE n.season = held.season AND n.team_id = held.team_id))"""


def snapshots(s, d):
    """Suppliers as athletes of their nation, their orders of a year as its games, the quantity as minutes; the net rating
    is the nation's mean margin."""
    season = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("season"))
    supplier = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("team_id"))
    lines = dealt(table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), ["l_orderkey"])
    games = lines.join(season, "l_orderkey").join(supplier, "l_suppkey").groupBy("season", "team_id", F.col("l_suppkey").alias("athlete_id"), "l_orderkey").agg(F.sum("l_quantity").alias("q"))
    players = games.groupBy("season", "team_id", "athlete_id").agg(F.count("*").alias("games"), (F.sum("q") / F.count("*")).alias("mpg"))
    ratings = sides(ratable(contests(s, d))).groupBy("season", "team_id").agg(F.avg(F.col("scored") - F.col("allowed")).alias("net"))
    return Q.team_snapshots(players, ratings)


@query(
    with_views(CONTEST, SIDES, SNAPSHOT)
    + f"SELECT season, team_id, {rnd_sql('net')} AS net, {rnd_sql('1500 + 35 * net')} AS rating, place, athlete_id, {rnd_sql('mpg')} AS mpg, {rnd_sql('minutes', 4)} AS minutes FROM net LEFT JOIN rotation USING (season, team_id)"
)
def season_snapshots(s, d):
    """Each rated team's season with the players of its rotation; a team without such players has one row of nulls."""
    rows = snapshots(s, d).select("season", "team_id", "net", "rating", F.explode_outer("players").alias("p"))
    return rows.select("season", "team_id", rnd(F.col("net")).alias("net"), rnd(F.col("rating")).alias("rating"), F.col("p.place").alias("place"), F.col("p.athlete_id").alias("athlete_id"), rnd(F.col("p.mpg")).alias("mpg"), rnd(F.col("p.minutes"), 4).alias("minutes"))


@query(
    with_views(CONTEST, SIDES, SNAPSHOT)
    + """, t AS (SELECT season, team_id, net, count(place) AS n, coalesce(sum(minutes), 0) AS total, max(mpg) AS mpg FROM net LEFT JOIN rotation USING (season, team_id) GROUP BY ALL)
SELECT season, team_id, unnest(list_filter([CASE WHEN net NOT BETWEEN -15 AND 20 THEN 'net rating not plausible' END, CASE WHEN n = 0 THEN 'no qualifying players' END, CASE WHEN abs(total - 240) > 1e-4 THEN 'rotation doesn''t add up' END, CASE WHEN mpg > 44 THEN 'minutes a game not plausible' END], lambda z: z IS NOT NULL)) AS rule FROM t
UNION ALL SELECT DISTINCT season, team_id, 'no snapshot' FROM sides ANTI JOIN net USING (season, team_id)"""
)
def snapshot_anomaly_list(s, d):
    """What is odd about each snapshot; every team with a contest in a season should have one."""
    return Q.snapshot_anomalies(snapshots(s, d), sides(contests(s, d)).select("season", "team_id"))


@query(
    with_views(CONTEST)
    + """, told AS (SELECT l_shipdate::DATE AS day, s_nationkey AS team_id, count(*) FILTER (l_returnflag <> 'N') AS listed, bool_or(l_returnflag = 'N') AS open FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
slate AS (SELECT DISTINCT game_date AS day, unnest([home_id, away_id]) AS team_id FROM contest),
t AS (SELECT day, coalesce(sum(listed), 0)::BIGINT AS listed, coalesce(string_agg(team_id::VARCHAR, ',' ORDER BY team_id) FILTER (open), '') AS not_submitted, coalesce(string_agg(team_id::VARCHAR, ',' ORDER BY team_id) FILTER (listed IS NULL), '') AS unlisted FROM slate LEFT JOIN told USING (day, team_id) GROUP BY day),
g AS (SELECT c.game_date AS day, count(*) AS games, count(coalesce(h.team_id, a.team_id)) AS shown FROM contest c LEFT JOIN told h ON h.day = c.game_date AND h.team_id = home_id LEFT JOIN told a ON a.day = c.game_date AND a.team_id = away_id GROUP BY 1)
SELECT day::VARCHAR AS day, games, shown, shown * 2 >= games AS usable, listed, not_submitted, unlisted FROM g JOIN t USING (day)"""
)
def slate_report_coverage(s, d):
    """Each day's slate and what the day's report, the lines shipped on it, says of it."""
    c = contests(s, d).select(F.col("game_date").alias("day"), "home_id", "away_id")
    supplier = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("team_id"))
    rows = table(s, d, "lineitem").join(supplier, "l_suppkey").select(F.to_date("l_shipdate").alias("day"), "team_id", F.col("l_partkey").alias("player"), F.nullif("l_returnflag", F.lit("N")).alias("status"))
    teams = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)
    return Q.slate_reports(c, rows).select(F.col("day").cast("string").alias("day"), "games", "shown", "usable", "listed", teams("not_submitted"), teams("unlisted"))


@query(
    with_views(CONTEST, SIDES)
    + """, l AS (SELECT game_id, CASE l_linestatus WHEN 'O' THEN home_id ELSE away_id END AS team_id, l_partkey AS athlete_id, nullif(l_returnflag, 'N') AS status, l_quantity AS points, l_linenumber AS line_no, contest.status = 'final' AS complete FROM lineitem JOIN contest ON game_id = l_orderkey),
stored AS (SELECT * FROM l WHERE line_no <= 3), rest AS (SELECT game_id, team_id, athlete_id, min(status) AS status FROM l ANTI JOIN stored USING (game_id, team_id, athlete_id) WHERE NOT complete GROUP BY ALL),
listed AS (SELECT game_id, team_id, status, points, 0 AS other FROM stored UNION ALL SELECT game_id, team_id, status, NULL, 1 FROM rest),
g AS (SELECT game_id, team_id, status, count(*) AS players, coalesce(sum(points), 0) AS known, sum(other)::BIGINT AS others FROM listed GROUP BY ALL), t AS (SELECT game_id, team_id, sum(known) AS known, sum(others)::BIGINT AS others FROM g GROUP BY ALL),
x AS (SELECT s.game_id, s.team_id, s.scored::DOUBLE AS points, CASE WHEN s.status = 'final' AND neutral THEN 'unfiled, counted' WHEN s.status = 'in-progress' THEN 'unfiled, nobody counted' ELSE 'filed' END AS filing, s.status = 'final' AS complete, coalesce(others, 0) AS others, greatest(0, scored - coalesce(known, 0))::DOUBLE AS rest FROM sides s LEFT JOIN t USING (game_id, team_id))
SELECT x.game_id, x.team_id, points, filing, g.status, players, known, x.others, CASE WHEN NOT complete AND (x.others > 0 OR rest >= 0.05) THEN rest END AS left_over FROM x LEFT JOIN g USING (game_id, team_id)"""
)
def absent_players_by_side(s, d):
    """The lines of a side as its absent players: the first three are stored with their points, a report names them all."""
    c = contests(s, d)
    both = sides(c).select("game_id", "team_id", F.col("scored").cast("double").alias("points"), (F.col("status") == "final").alias("complete"), F.col("neutral").alias("unfiled"), (F.col("status") == "in-progress").alias("not_submitted"))
    line = table(s, d, "lineitem").join(c.select(F.col("game_id").alias("l_orderkey"), "home_id", "away_id"), "l_orderkey").select(
        F.col("l_orderkey").alias("game_id"), F.when(F.col("l_linestatus") == "O", F.col("home_id")).otherwise(F.col("away_id")).alias("team_id"), F.col("l_partkey").alias("athlete_id"),
        F.nullif("l_returnflag", F.lit("N")).alias("status"), F.col("l_quantity").alias("points"), (F.col("l_linenumber") <= 3).alias("stored"),
    )
    return Q.absence_sides_of(both, line)
