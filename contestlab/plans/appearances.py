"""Queries over box lines, names, tables and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestlab.functions import text as X
from contestlab.functions.scoring import rnd, rnd_sql
from contestlab.operators import appearances as A
from contestlab.operators.relations import dealt
from contestlab.operators.temporal import decayed
from contestlab.plans.registry import registry
from contestlab.sources.views import BOX, box_lines, table, with_views

QUERIES, ORACLES, query = registry()


@query(with_views(BOX) + f"SELECT athlete_id, count(DISTINCT game_id) AS games, sum(starter::INT)::BIGINT AS starts, sum(minutes)::BIGINT AS minutes, sum(points)::BIGINT AS points, {rnd_sql('sum(points) / count(DISTINCT game_id)')} AS per_game, {rnd_sql('48 * sum(points) / sum(minutes)')} AS per_48 FROM box GROUP BY athlete_id")
def player_totals_shooting(s, d):
    """Totals and averages; lines of one game are added up first."""
    per = box_lines(s, d).groupBy("athlete_id", "game_id").agg(F.sum(F.col("starter").cast("long")).alias("s"), F.sum("minutes").alias("m"), F.sum("points").alias("p"))
    t = per.groupBy("athlete_id").agg(F.count("*").alias("games"), F.sum("s").alias("starts"), F.sum("m").alias("minutes"), F.sum("p").alias("points"))
    return t.select("*", rnd(F.col("points") / F.col("games")).alias("per_game"), rnd(48 * F.try_divide(F.col("points"), F.col("minutes"))).alias("per_48"))


@query(with_views(BOX) + """, v AS (SELECT p_brand AS brand, p_type AS kind, count(*) AS n FROM box JOIN part ON athlete_id = p_partkey GROUP BY ALL)
SELECT brand, arg_min(kind, (-n, kind)) AS mode, max(n) AS votes FROM v GROUP BY brand""")
def modal_category(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("athlete_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    return A.mode_by(box_lines(s, d).join(part, "athlete_id"), "brand", "kind")


@query(with_views(BOX) + f"SELECT game_id, sum(points) FILTER (side = 'home')::BIGINT AS home_points, {rnd_sql('100 * (sum(CASE WHEN side = $$home$$ THEN points ELSE -points END)) / sum(minutes)')} AS net FROM box GROUP BY game_id HAVING count(*) FILTER (side = 'home') > 0".replace("$$", "'"))
def possession_net_rating(s, d):
    signed = F.when(F.col("side") == "home", F.col("points")).otherwise(-F.col("points"))
    home = F.col("side") == "home"
    g = box_lines(s, d).groupBy("game_id").agg(F.sum(F.when(home, F.col("points"))).alias("home_points"), F.sum(signed).alias("n"), F.sum("minutes").alias("m"), F.count(F.when(home, 1)).alias("h"))
    return g.where("h > 0").select("game_id", "home_points", rnd(100 * F.col("n") / F.col("m")).alias("net"))


@query(
    with_views(BOX)
    + """, r AS (SELECT DISTINCT supplier % 50 AS team, game_id, athlete_id FROM box), h AS (SELECT team, game_id, count(*) AS played FROM r GROUP BY team, game_id), g AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY game_id) AS i FROM h)
SELECT a.team, a.game_id, max(a.played) AS played, count(DISTINCT r.athlete_id) AS rotation FROM g a JOIN g b ON a.team = b.team AND b.i BETWEEN a.i - 9 AND a.i JOIN r ON r.team = b.team AND r.game_id = b.game_id GROUP BY 1, 2"""
)
def rotation_last_ten(s, d):
    rows = box_lines(s, d).withColumn("team", F.col("supplier") % 50)
    return A.last_rosters(rows, "team", "game_id", "athlete_id").select("team", "game_id", F.col("played").cast("long").alias("played"), F.col("rotation").cast("long").alias("rotation"))


SPELLS = """, g AS (SELECT DISTINCT supplier % 50 AS team, game_id FROM box), n AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY game_id) AS i FROM g),
x AS (SELECT DISTINCT supplier % 50 AS team, game_id, athlete_id FROM box), k AS (SELECT *, lead(i) OVER (PARTITION BY team, athlete_id ORDER BY i) - i - 1 AS missed FROM x JOIN n USING (team, game_id))"""


@query(with_views(BOX) + SPELLS + "SELECT team, athlete_id, game_id AS last_seen, missed::BIGINT AS missed FROM k WHERE missed > 0")
def absence_spells(s, d):
    return A.absence_spells(box_lines(s, d).withColumn("team", F.col("supplier") % 50), "team", "game_id", "athlete_id")


@query(with_views(BOX) + SPELLS + f"SELECT e::INT AS reached, count(*) AS n, {rnd_sql('avg(missed - e)')} AS mean_left FROM k JOIN (VALUES (1), (2), (4), (8), (16), (31)) t(e) ON missed >= e GROUP BY e")
def survival_table(s, d):
    spells = A.absence_spells(box_lines(s, d).withColumn("team", F.col("supplier") % 50), "team", "game_id", "athlete_id")
    return A.survival(spells, "missed", (1, 2, 4, 8, 16, 31)).select("reached", "n", rnd(F.col("mean_left")).alias("mean_left"))


DECAY = ", o AS (SELECT athlete_id, minutes, points, sum(minutes) OVER (PARTITION BY athlete_id) - sum(minutes) OVER (PARTITION BY athlete_id ORDER BY game_id, line_no, supplier, points ROWS UNBOUNDED PRECEDING) AS passed FROM box)"


@query(with_views(BOX) + DECAY + f"SELECT athlete_id, {rnd_sql('sum(points * power(0.5::DOUBLE, passed / 1000.0::DOUBLE))', 4)} AS decayed_value, {rnd_sql('sum(minutes * power(0.5::DOUBLE, passed / 1000.0::DOUBLE))', 4)} AS decayed_weight FROM o GROUP BY athlete_id")
def decayed_player_value(s, d):
    got = decayed(box_lines(s, d), "athlete_id", ["game_id", "line_no", "supplier", "points"], "minutes", "points", 1000.0)
    return got.select("athlete_id", *[rnd(F.col(c), 4).alias(c) for c in ("decayed_value", "decayed_weight")])


@query(with_views(BOX) + "".join([", w AS (SELECT minutes::DOUBLE AS minutes, points::DOUBLE AS points, line_no::DOUBLE AS line_no FROM box) ", " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, sum({a} * {b}) AS value FROM w" for a, b in (("minutes", "minutes"), ("minutes", "points"), ("minutes", "line_no"), ("points", "points"), ("points", "line_no"), ("line_no", "line_no")))]))
def rapm_gram(s, d):
    return A.gram(box_lines(s, d), ["minutes", "points", "line_no"])


@query(with_views(BOX) + f"SELECT game_id, side, athlete_id, {rnd_sql('sum(minutes) / max(total)')} AS share FROM (SELECT *, sum(minutes) OVER (PARTITION BY game_id, side) AS total FROM box) GROUP BY 1, 2, 3")
def playing_time_shares(s, d):
    lines = dealt(box_lines(s, d).select("game_id", "side", "athlete_id", "minutes"), ["game_id", "side"])
    rows = lines.withColumn("_t", F.sum("minutes").over(Window.partitionBy("game_id", "side")))
    return rows.groupBy("game_id", "side", "athlete_id").agg(rnd(F.sum("minutes") / F.max("_t")).alias("share"))


@query("""SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, sum((l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_rollup_revenue(s, d):
    cube = table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    return cube.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "cents")


NAMES = """, c AS (SELECT c_custkey AS id, c_nationkey AS nation, right(c_name, 4) AS key FROM customer), n AS (SELECT nation, key, min(id) AS i, count(DISTINCT id) AS k FROM c GROUP BY ALL), w AS (SELECT key, min(id) AS i, count(DISTINCT id) AS k FROM c GROUP BY key)"""


@query(
    "WITH q AS (SELECT s_suppkey AS supplier, s_nationkey AS nation, right(s_name, 4) AS key FROM supplier)"
    + NAMES
    + """ SELECT supplier, coalesce(CASE WHEN n.k = 1 THEN n.i WHEN n.k IS NULL AND w.k = 1 THEN w.i END, -1) AS resolved,
  CASE WHEN n.k = 1 THEN 'narrow' WHEN n.k > 1 THEN 'ambiguous' WHEN w.k = 1 THEN 'wide' WHEN w.k > 1 THEN 'ambiguous' ELSE 'unknown' END AS how
  FROM q LEFT JOIN n USING (nation, key) LEFT JOIN w USING (key)"""
)
def entity_resolution_cascade(s, d):
    """Suppliers' name endings matched to customers: of the same nation first, then anywhere, only if unambiguous."""
    end = lambda c: F.substring(c, -4, 4).alias("key")
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), end("c_name"))
    q = table(s, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"), end("s_name"))
    return A.unique_key_cascade(q, c, c, "key", "nation", "id").select("supplier", F.coalesce("resolved", F.lit(-1)).alias("resolved"), "how")


@query("SELECT p_partkey AS id, CASE WHEN f = 'ring' THEN 0 WHEN starts_with(f, 'ring') THEN 1 WHEN contains(f, ' ring') THEN 2 WHEN contains(f, 'ring') THEN 3 END AS tier FROM (SELECT p_partkey, lower(p_name) AS f FROM part) WHERE contains(f, 'ring')")
def text_fold_search(s, d):
    """Parts whose folded name answers a query, by how well it does."""
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), X.match_tier(X.fold(F.col("p_name")), F.lit("ring")).alias("tier")).where("tier IS NOT NULL")


@query("SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(lower(c_name), '[-#]', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) AS name_key FROM customer")
def name_keys(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), X.name_key(F.col("c_name")).alias("name_key"))


@query("SELECT c_custkey AS id, c_name AS name, floor(c_acctbal * 100 + 0.5::DOUBLE)::BIGINT AS cents FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000 ORDER BY c_acctbal DESC NULLS LAST, c_name LIMIT 25 OFFSET 25")
def table_filter_sort_page(s, d):
    """The second page of a filtered, sorted table."""
    rows = table(s, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 1000").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_name").offset(25).limit(25)
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.floor(F.col("c_acctbal") * 100 + 0.5).cast("long").alias("cents"))


@query("SELECT event_type AS kind, json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, len(regexp_extract_all(coalesce(html, ''), '<a [^>]*href="([^"]*)"', 1))::BIGINT AS links, coalesce(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '') AS host FROM pages""")
def html_title_links(s, d):
    html = F.coalesce("html", F.lit(""))
    return table(s, d, "pages").select(
        "page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(html, F.lit('<a [^>]*href="([^"]*)"')).cast("long").alias("links"), F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://([^/]+)", 1).alias("host")
    )


MONTH = ", m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment AS segment, sum((o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), sh AS (SELECT *, cents / sum(cents) OVER (PARTITION BY month) AS share FROM m)"


@query("WITH a AS (SELECT 1)" + MONTH + f" SELECT month, segment, {rnd_sql('share')} AS share, coalesce({rnd_sql('share - lag(share) OVER (PARTITION BY segment ORDER BY month)')}, 0) AS change FROM sh")
def title_odds_change(s, d):
    """Segments' shares of each month's orders, and the change since the month before."""
    orders = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("c_mktsegment").alias("segment")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    share = F.col("cents") / F.sum("cents").over(Window.partitionBy("month"))
    m = m.withColumn("_s", share)
    change = F.col("_s") - F.lag("_s").over(Window.partitionBy("segment").orderBy("month"))
    return m.select("month", "segment", rnd(F.col("_s")).alias("share"), F.coalesce(rnd(change), F.lit(0.0)).alias("change"))
