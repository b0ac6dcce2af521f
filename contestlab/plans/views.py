"""Queries of the serving layer: what pages show."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestlab.functions.scoring import rnd, rnd_sql
from contestlab.operators import relations as R
from contestlab.plans.registry import registry
from contestlab.sources.views import BOX, CONTEST, LEDGER, PLAY, SIDES, TEAM, box_lines, contests, ledger, ratable, sides, table, teams, with_views

QUERIES, ORACLES, query = registry()


@query(with_views(CONTEST) + """, n AS (SELECT game_date, count(*) AS games, count(*) FILTER (status = 'final') AS finals FROM contest GROUP BY game_date)
SELECT game_date::VARCHAR AS day, games, finals, coalesce((lag(game_date) OVER (ORDER BY game_date))::VARCHAR, '') AS previous, coalesce((lead(game_date) OVER (ORDER BY game_date))::VARCHAR, '') AS next FROM n""")
def date_navigation(s, d):
    """Days with contests and their neighbours; one row per day passes through the window."""
    n = contests(s, d).groupBy("game_date").agg(F.count("*").alias("games"), F.count(F.when(F.col("status") == "final", 1)).alias("finals"))
    w = Window.orderBy("game_date")
    text = lambda c: F.coalesce(c.over(w).cast("string"), F.lit(""))
    return n.select(F.col("game_date").cast("string").alias("day"), "games", "finals", text(F.lag("game_date")).alias("previous"), text(F.lead("game_date")).alias("next"))


@query(
    with_views(CONTEST)
    + """SELECT game_date::VARCHAR AS day, count(*) AS finals, sum((home_score > away_score)::INT)::BIGINT AS home_wins, max(abs(home_score - away_score))::BIGINT AS widest,
  arg_max(game_id, (abs(home_score - away_score), -game_id)) AS widest_game, arg_min(game_id, (abs(home_score - away_score), game_id)) AS closest_game FROM ratable GROUP BY 1"""
)
def day_summary(s, d):
    m = F.abs(F.col("home_score") - F.col("away_score"))
    return ratable(contests(s, d)).groupBy(F.col("game_date").cast("string").alias("day")).agg(
        F.count("*").alias("finals"), F.sum((F.col("home_score") > F.col("away_score")).cast("long")).alias("home_wins"), F.max(m).alias("widest"),
        F.max_by("game_id", F.struct(m, -F.col("game_id"))).alias("widest_game"), F.min_by("game_id", F.struct(m, "game_id")).alias("closest_game"),
    )


@query(
    with_views(CONTEST, SIDES)
    + """, w AS (SELECT season, team_id, sum((scored > allowed)::INT)::BIGINT AS wins FROM sides WHERE status = 'final' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY wins DESC, team_id) AS n FROM w)
SELECT season, CASE WHEN n <= 5 THEN team_id ELSE -1 END AS team_id, sum(wins)::BIGINT AS wins, count(*) AS teams FROM r GROUP BY 1, 2"""
)
def top_five_and_rest(s, d):
    """Each season's five best by wins, and all others together under -1."""
    w = sides(contests(s, d).where("status = 'final'")).groupBy("season", "team_id").agg(F.sum((F.col("scored") > F.col("allowed")).cast("long")).alias("wins"))
    n = F.row_number().over(Window.partitionBy("season").orderBy(F.desc("wins"), "team_id"))
    return w.withColumn("team_id", F.when(n <= 5, F.col("team_id")).otherwise(-1)).groupBy("season", "team_id").agg(F.sum("wins").alias("wins"), F.count("*").alias("teams"))


@query(
    with_views(CONTEST, SIDES)
    + """, t AS (SELECT game_date, team_id, sum(scored - allowed)::BIGINT AS m FROM sides WHERE status = 'final' GROUP BY ALL), a AS (SELECT game_date, list_sort(list(m)) AS l FROM t GROUP BY game_date)
SELECT game_date::VARCHAR AS day, len(l)::BIGINT AS teams, l[1 + floor(0.1::DOUBLE * (len(l) - 1) + 0.5)::INT]::BIGINT AS low, l[1 + floor(0.5::DOUBLE * (len(l) - 1) + 0.5)::INT]::BIGINT AS mid, l[1 + floor(0.9::DOUBLE * (len(l) - 1) + 0.5)::INT]::BIGINT AS high FROM a"""
)
def band_by_date(s, d):
    """Nearest-rank band of the teams' margins on every day; a day's array has at most one entry per team."""
    t = sides(contests(s, d).where("status = 'final'")).groupBy("game_date", "team_id").agg(F.sum(F.col("scored") - F.col("allowed")).alias("m"))
    a = t.groupBy("game_date").agg(F.sort_array(F.collect_list("m")).alias("l"))
    at = lambda q: F.element_at("l", (1 + F.floor(q * (F.size("l") - 1) + 0.5)).cast("int"))
    return a.select(F.col("game_date").cast("string").alias("day"), F.size("l").cast("long").alias("teams"), at(0.1).alias("low"), at(0.5).alias("mid"), at(0.9).alias("high"))


@query(with_views(CONTEST, "s AS (SELECT season, count(*) FILTER (status = 'final') AS f, count(*) FILTER (status <> 'final') AS p FROM contest GROUP BY season)") + """
SELECT season, i::INT AS cell, CASE WHEN i <= floor(100 * f / (f + p)) THEN 'scored' ELSE 'pending' END AS state FROM s, range(1, 101) t(i)""")
def waffle_cells(s, d):
    """A hundred cells per season, as many scored ones as percent of its contests are."""
    c = contests(s, d).groupBy("season").agg(F.count(F.when(F.col("status") == "final", 1)).alias("f"), F.count("*").alias("t"))
    cells = c.select("season", "f", "t", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("cell"))
    return cells.select("season", "cell", F.when(F.col("cell") <= F.floor(100 * F.col("f") / F.col("t")), "scored").otherwise("pending").alias("state"))


@query(with_views(BOX) + f"""SELECT athlete_id, list_sum(list_transform(l, lambda x: x.p))::BIGINT AS points, len(list_filter(l, lambda x: x.p >= 50))::BIGINT AS big_games, list_max(list_transform(l, lambda x: x.p))::BIGINT AS best
FROM (SELECT athlete_id, list({{'g': game_id, 'p': p}}) AS l FROM (SELECT athlete_id, game_id, sum(points)::BIGINT AS p FROM box GROUP BY ALL) GROUP BY athlete_id)""")
def nested_game_logs(s, d):
    """Totals from nested logs of games, by array functions."""
    per = box_lines(s, d).groupBy("athlete_id", "game_id").agg(F.sum("points").alias("p"))
    logs = per.groupBy("athlete_id").agg(F.collect_list(F.struct("game_id", "p")).alias("l"))
    points = F.transform("l", lambda x: x["p"])
    return logs.select(
        "athlete_id", F.aggregate(points, F.lit(0).cast("long"), lambda a, x: a + x).alias("points"), F.size(F.filter("l", lambda x: x["p"] >= 50)).cast("long").alias("big_games"), F.array_max(points).alias("best")
    )


@query(with_views(PLAY, LEDGER) + """, l AS (SELECT game, ord, p FROM ledger WHERE entry = 'final'), v AS (SELECT game, ord, p, lag(p) OVER (PARTITION BY game ORDER BY ord) AS before FROM l)"""
+ f" SELECT game, max(ord) AS ord, {rnd_sql('arg_max(p, ord)')} AS latest, {rnd_sql('arg_max(p - coalesce(before, p), ord)')} AS change FROM v GROUP BY game")
def latest_version_delta(s, d):
    """Each game's latest final forecast and its change from the one before (0 for the only one)."""
    before = F.lag("p").over(Window.partitionBy("game").orderBy("ord"))
    v = ledger(s, d).where("entry = 'final'").withColumn("before", before)
    g = v.groupBy("game").agg(F.max("ord").alias("ord"), F.max_by("p", "ord").alias("a"), F.max_by(F.col("p") - F.coalesce("before", "p"), "ord").alias("b"))
    return g.select("game", "ord", rnd(F.col("a")).alias("latest"), rnd(F.col("b")).alias("change"))


@query(with_views(PLAY, LEDGER) + "SELECT game, 'final' AS kind, count(*) AS n FROM ledger WHERE entry = 'final' GROUP BY game UNION ALL SELECT game, 'morning', count(*) FROM ledger WHERE entry = 'morning' AND game NOT IN (SELECT game FROM ledger WHERE entry = 'final') GROUP BY game")
def merged_versions(s, d):
    """Final forecasts by game, and morning ones of games that have no final one."""
    rows = ledger(s, d)
    by = lambda k: rows.where(F.col("entry") == k).groupBy("game").agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return R.newest(by("final"), by("morning"), ["game"])


@query(
    with_views(CONTEST, SIDES, TEAM)
    + """, rated AS (SELECT * FROM sides WHERE status = 'final' AND scored <> allowed), t AS (SELECT conference, team_id, sum((scored > allowed)::INT)::BIGINT AS wins, sum((scored < allowed)::INT)::BIGINT AS losses, sum(scored - allowed)::BIGINT AS diff FROM rated JOIN team USING (team_id) GROUP BY ALL),
sh AS (SELECT *, floor(wins / greatest(wins + losses, 1) * 1e9::DOUBLE) AS s FROM t), h AS (SELECT a.conference, a.team_id, avg((r.scored > r.allowed)::INT) AS hh FROM rated r JOIN sh a ON r.team_id = a.team_id JOIN sh b ON r.opp_id = b.team_id AND a.conference = b.conference AND a.s = b.s GROUP BY ALL)
SELECT conference, team_id, wins, losses, row_number() OVER (PARTITION BY conference ORDER BY s DESC, coalesce(hh, 0.5) DESC, diff DESC, team_id) AS seed FROM sh LEFT JOIN h USING (conference, team_id)"""
)
def conference_seeds(s, d):
    """Seeds by share of wins, head to head among the tied, differential."""
    rows = sides(ratable(contests(s, d))).join(teams(s, d).select("team_id", "conference"), "team_id")
    won = (F.col("scored") > F.col("allowed")).cast("long")
    t = rows.groupBy("conference", "team_id").agg(F.sum(won).alias("wins"), F.sum(1 - won).alias("losses"), F.sum(F.col("scored") - F.col("allowed")).alias("diff"))
    return R.break_ties(t, rows.select("conference", F.col("team_id"), "opp_id", "scored", "allowed"), "conference", "team_id").select("conference", "team_id", "wins", "losses", "seed")


@query(
    with_views(BOX)
    + f""", m AS (SELECT game_id, athlete_id, sum(minutes)::DOUBLE AS w FROM box GROUP BY ALL), r AS (SELECT *, row_number() OVER o - 1 AS ahead, sum(w) OVER (PARTITION BY game_id ORDER BY w DESC, athlete_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM m WINDOW o AS (PARTITION BY game_id ORDER BY w DESC, athlete_id)),
l AS (SELECT *, (240 - ahead * 40) / rest AS lev FROM r), f AS (SELECT game_id, arg_min(lev, ahead) AS found FROM l WHERE lev * w <= 40 GROUP BY game_id)
SELECT game_id, athlete_id, {rnd_sql('least(40.0::DOUBLE, coalesce(found * w, 40.0::DOUBLE))', 4)} AS minutes FROM m LEFT JOIN f USING (game_id)"""
)
def rotation_minutes(s, d):
    """240 minutes of a game shared by weight, nobody above 40."""
    m = box_lines(s, d).groupBy("game_id", "athlete_id").agg(F.sum("minutes").cast("double").alias("w"))
    return R.bounded_shares(m, "game_id", "w", "athlete_id", 240.0, 40.0).select("game_id", "athlete_id", rnd(F.col("share"), 4).alias("minutes"))


@query(
    """WITH m AS (SELECT l_suppkey, sum(l_quantity)::BIGINT AS minutes FROM lineitem GROUP BY 1)
SELECT s_suppkey, s_name, s_nationkey AS nation, coalesce(minutes, 0)::BIGINT AS minutes, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(minutes, 0) DESC, s_suppkey) AS place
FROM supplier LEFT JOIN m ON s_suppkey = l_suppkey"""
)
def supplier_index(s, d):
    """The search index: a row for each name with its place in its nation, most minutes first."""
    m = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("minutes"))
    rows = table(s, d, "supplier").join(m, F.col("s_suppkey") == F.col("l_suppkey"), "left").withColumn("minutes", F.coalesce("minutes", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("minutes"), "s_suppkey"))
    return rows.select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"), "minutes", place.alias("place"))
