"""Queries that check, audit and extend."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestlab.functions.scoring import implied_probability, rnd, rnd_sql, without_margin
from contestlab.operators import audits as U
from contestlab.plans.registry import registry
from contestlab.sources.views import BOX, CONTEST, LEDGER, PLAY, PREDICTION, SIDES, TEAM, box_lines, contests, ledger, plays, predictions, ratable, sides, table, teams, with_views

QUERIES, ORACLES, query = registry()


@query(
    with_views(CONTEST, SIDES)
    + """, f AS (SELECT season, team_id, game_date, row_number() OVER (PARTITION BY season, team_id ORDER BY game_date, game_id) AS n FROM sides WHERE status = 'final'),
shot AS (SELECT season, team_id, game_date AS as_of FROM f WHERE n = 10),
x AS (SELECT s.season, CASE WHEN as_of IS NULL THEN 'missing' WHEN as_of >= s.game_date THEN 'not before' END AS rule FROM sides s LEFT JOIN shot USING (season, team_id))
SELECT season, rule, count(*) AS rows FROM x WHERE rule IS NOT NULL GROUP BY ALL"""
)
def snapshot_leakage(s, d):
    """A team's snapshot is dated by its tenth result of the season: sides of contests without one, or not after it."""
    rows = sides(contests(s, d))
    nth = F.row_number().over(Window.partitionBy("season", "team_id").orderBy("game_date", "game_id"))
    shots = rows.where("status = 'final'").withColumn("n", nth).where("n = 10").select("season", "team_id", F.col("game_date").alias("as_of"))
    found = U.leakage(rows.select("season", "team_id", "game_date"), shots, ["season", "team_id"], "game_date", "as_of")
    return found.groupBy("season", "rule").agg(F.count("*").alias("rows"))


@query(with_views(CONTEST) + """SELECT game_id, unnest(list_filter([CASE WHEN status = 'final' AND home_score = away_score THEN 'tied' END, CASE WHEN home_score + away_score = 0 THEN 'no score' END,
  CASE WHEN status = 'scheduled' AND home_score > 0 AND away_score > 0 THEN 'scored early' END, CASE WHEN home_score > 300 THEN 'extreme' END], lambda x: x IS NOT NULL)) AS rule FROM contest""")
def score_rule_violations(s, d):
    rules = {
        "tied": (F.col("status") == "final") & (F.col("home_score") == F.col("away_score")),
        "no score": F.col("home_score") + F.col("away_score") == 0,
        "scored early": (F.col("status") == "scheduled") & (F.col("home_score") > 0) & (F.col("away_score") > 0),
        "extreme": F.col("home_score") > 300,
    }
    return U.broken_rules(contests(s, d), ["game_id"], rules)


CL = {"low p": "p < 0.2", "high p": "p > 0.8", "flagged": "flag = 1", "foreign": "round <> 'en'"}


@query(
    with_views(PREDICTION)
    + ", c AS (SELECT "
    + ", ".join(f"({c})::INT AS c{i}" for i, c in enumerate(CL.values()))
    + " FROM prediction), t AS (SELECT *, c0 + c1 + c2 + c3 AS n FROM c) "
    + " UNION ALL ".join(f"SELECT '{n}' AS clause, sum(c{i})::BIGINT AS rejected, sum((c{i} = 1 AND n = 1)::INT)::BIGINT AS alone, sum((n > 0)::INT)::BIGINT AS \"any\" FROM t" for i, n in enumerate(CL))
)
def rejection_clause_counts(s, d):
    return U.clause_counts(predictions(s, d), {n: F.expr(c) for n, c in CL.items()}).drop("place", "candidates")


@query(
    """WITH o AS (SELECT o_custkey AS key, o_orderpriority AS status, o_orderdate AS seen_at, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
k AS (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_acctbal > 0), x AS (SELECT o.*, k.key IS NULL AS missing FROM o LEFT JOIN k USING (key))
SELECT rule, count(*) AS issues FROM (SELECT unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN missing THEN 'unknown' END, CASE WHEN seen_at >= TIMESTAMP '2000-01-01' THEN 'late' END], lambda r: r IS NOT NULL)) AS rule FROM x) GROUP BY rule"""
)
def observation_audit(s, d):
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("status"), F.col("o_orderdate").alias("seen_at"), F.lit("2000-01-01").cast("timestamp_ntz").alias("until"))
    known = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return U.observation_issues(rows, known, ["key", "status"], "key", "seen_at", "until").groupBy("rule").agg(F.count("*").alias("issues"))


@query(
    with_views(PLAY)
    + """, n AS (SELECT *, coalesce(sum((kind IN ('purchase', 'error'))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS phase FROM play)
SELECT user_id, phase, count(*) AS steps, coalesce(max(CASE kind WHEN 'purchase' THEN 'closed' WHEN 'error' THEN 'reset' END), 'open') AS ended FROM n GROUP BY user_id, phase"""
)
def fsm_possession_ends(s, d):
    return U.phase_ends(plays(s, d), "user_id", ["ts", "event_id"], "kind", ["purchase"], ["error"])


@query(with_views(PLAY, LEDGER) + "SELECT game, min(happened)::VARCHAR[:19] AS first_missed, count(*) AS times FROM ledger l WHERE entry = 'missed' AND NOT EXISTS (SELECT 1 FROM ledger r WHERE r.game = l.game AND r.entry IN ('final', 'reissued', 'morning')) GROUP BY game".replace("min(happened)::VARCHAR[:19]", "strftime(min(happened), '%Y-%m-%d %H:%M:%S')"))
def ledger_missed(s, d):
    rows = ledger(s, d)
    sealed = rows.where(F.col("entry").isin("final", "reissued", "morning")).select("game").distinct()
    return rows.where("entry = 'missed'").join(sealed, "game", "left_anti").groupBy("game").agg(F.date_format(F.min("happened"), "yyyy-MM-dd HH:mm:ss").alias("first_missed"), F.count("*").alias("times"))


@query(with_views(PLAY, LEDGER) + "SELECT strftime(happened, '%Y-%m') AS month, entry, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM ledger GROUP BY 1, 2")
def ledger_partition_months(s, d):
    return ledger(s, d).groupBy(F.date_format("happened", "yyyy-MM").alias("month"), "entry").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query(with_views(PLAY, LEDGER) + "SELECT game, count(*) FILTER (entry = 'morning') AS morning, count(*) FILTER (entry = 'reissued') AS reissued, count(*) FILTER (entry = 'final') AS final, count(*) FILTER (entry = 'missed') AS missed, count(*) FILTER (entry = 'result') AS result FROM ledger GROUP BY game")
def ledger_kinds_pivot(s, d):
    """Entries of each kind by game, as columns."""
    kinds = ["morning", "reissued", "final", "missed", "result"]
    return ledger(s, d).groupBy("game").pivot("entry", kinds).count().na.fill(0, kinds)


@query(
    with_views(PREDICTION)
    + f""", o AS (SELECT *, CASE WHEN id % 2 = 0 THEN -(100 + id % 300) ELSE 100 + id % 250 END AS h, 110 + id % 90 AS a FROM prediction),
i AS (SELECT *, CASE WHEN h < 0 THEN -h / (100.0::DOUBLE - h) ELSE 100.0::DOUBLE / (100.0::DOUBLE + h) END AS ih, 100.0::DOUBLE / (100.0::DOUBLE + a) AS ia FROM o)
SELECT season, count(*) AS n, {rnd_sql('avg((p - y) * (p - y))')} AS model, {rnd_sql('avg(power(ih / (ih + ia) - y, 2))')} AS market FROM i GROUP BY season HAVING count(*) >= 5"""
)
def market_comparison(s, d):
    h = F.when(F.col("id") % 2 == 0, -(100 + F.col("id") % 300)).otherwise(100 + F.col("id") % 250)
    market = without_margin(implied_probability(h), implied_probability(110 + F.col("id") % 90))
    out = predictions(s, d).withColumn("m", market).groupBy("season").agg(F.count("*").alias("n"), rnd(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("model"), rnd(F.avg(F.pow(F.col("m") - F.col("y"), F.lit(2)))).alias("market"))
    return out.where("n >= 5")


PIECE = "power(0.25::DOUBLE, 7 - year(o_orderdate) % 8)"


@query(
    with_views(BOX)
    + f""", p AS (SELECT athlete_id, sum(minutes)::DOUBLE AS poss, avg(points)::DOUBLE AS rating, {PIECE} AS w FROM box JOIN orders ON o_orderkey = game_id GROUP BY athlete_id, year(o_orderdate), {PIECE})
SELECT athlete_id, {rnd_sql('(sum(poss * w * rating) + 250 * -7.0::DOUBLE) / (sum(poss * w) + 250)', 5)} AS value FROM p GROUP BY athlete_id"""
)
def piece_combination(s, d):
    """Season pieces combined with decay by age and shrunk to a prior."""
    year = F.year("o_orderdate")
    season = table(s, d, "orders").select(F.col("o_orderkey").alias("game_id"), year.alias("year"), F.pow(F.lit(0.25), 7 - year % 8).alias("w"))
    p = box_lines(s, d).join(season, "game_id").groupBy("athlete_id", "year", "w").agg(F.sum("minutes").cast("double").alias("poss"), F.avg("points").alias("rating"))
    return p.groupBy("athlete_id").agg(rnd((F.sum(F.col("poss") * F.col("w") * F.col("rating")) + 250 * -7.0) / (F.sum(F.col("poss") * F.col("w")) + 250), 5).alias("value"))


@query(
    with_views(CONTEST)
    + f""", f AS (SELECT season, home_score - away_score AS y, (neutral)::INT::DOUBLE AS x FROM ratable), m AS (SELECT season, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx FROM f GROUP BY season)
SELECT season, {rnd_sql('max(my)')} AS intercept, {rnd_sql('sum((x - mx) / nullif(sx, 0) * (y - my)) / (sum(power((x - mx) / nullif(sx, 0), 2)) + 10)')} AS beta FROM f JOIN m USING (season) GROUP BY season"""
)
def ridge_closed_form(s, d):
    """Margin on neutral ground, standardised, with a penalty of 10: closed form from five sums per season."""
    f = ratable(contests(s, d)).select("season", (F.col("home_score") - F.col("away_score")).cast("double").alias("y"), F.col("neutral").cast("int").cast("double").alias("x"))
    g = f.groupBy("season").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.covar_pop("x", "y").alias("c"))
    return g.select("season", rnd(F.col("my")).alias("intercept"), rnd(F.col("n") * F.col("c") / F.nullif(F.col("sx"), F.lit(0.0)) / (F.col("n") + 10.0)).alias("beta"))


@query(with_views(BOX) + f"SELECT athlete_id, sum(CASE side WHEN 'home' THEN points ELSE -points END)::BIGINT AS raw, {rnd_sql('100 * sum(CASE side WHEN $home$ THEN points ELSE -points END) / sum(minutes)')} AS per_100 FROM box GROUP BY athlete_id".replace("$home$", "'home'"))
def raw_plus_minus(s, d):
    signed = F.when(F.col("side") == "home", F.col("points")).otherwise(-F.col("points"))
    t = box_lines(s, d).groupBy("athlete_id").agg(F.sum(signed).alias("raw"), F.sum("minutes").alias("_m"))
    return t.select("athlete_id", "raw", rnd(100 * F.col("raw") / F.col("_m")).alias("per_100"))


@query()
def approx_distinct_users(s, d):
    """Distinct users of each kind by a sketch of 2 % standard error; the test holds it against the exact count."""
    return table(s, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query(
    with_views(CONTEST, SIDES, TEAM)
    + f""", w AS (SELECT conference, team_id, sum((scored > allowed)::INT)::BIGINT AS wins FROM sides JOIN team USING (team_id) WHERE status = 'final' AND scored <> allowed GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conference ORDER BY wins DESC, team_id) AS seed FROM w)
SELECT a.conference, a.seed AS high, b.seed AS low, a.team_id AS high_id, b.team_id AS low_id, {rnd_sql('1 / (1 + exp(-(a.wins - b.wins) / 50.0::DOUBLE))')} AS p_high
FROM r a JOIN r b ON a.conference = b.conference AND a.seed + b.seed = 5 AND a.seed < b.seed"""
)
def bracket_forecast(s, d):
    """First-round pairings of each conference's best four and the better seed's chance."""
    w = sides(ratable(contests(s, d))).join(teams(s, d), "team_id").groupBy("conference", "team_id").agg(F.sum((F.col("scored") > F.col("allowed")).cast("long")).alias("wins"))
    seeds = w.withColumn("seed", F.row_number().over(Window.partitionBy("conference").orderBy(F.desc("wins"), "team_id"))).where("seed <= 4")
    high = seeds.where("seed <= 2").select("conference", F.col("seed").alias("high"), F.col("team_id").alias("high_id"), F.col("wins").alias("_h"), (5 - F.col("seed")).alias("low"))
    low = seeds.where("seed >= 3").select("conference", F.col("seed").alias("low"), F.col("team_id").alias("low_id"), F.col("wins").alias("_l"))
    return high.join(low, ["conference", "low"]).select("conference", "high", "low", "high_id", "low_id", rnd(1 / (1 + F.exp(-(F.col("_h") - F.col("_l")) / 50.0))).alias("p_high"))


@query(
    with_views(CONTEST)
    + f"""SELECT game_id, {rnd_sql('home_score - away_score - 2.2::DOUBLE * (NOT neutral)::INT')} AS strength, {rnd_sql('2.2::DOUBLE * (NOT neutral)::INT')} AS venue, (home_score - away_score)::BIGINT AS margin FROM ratable"""
)
def margin_breakdown(s, d):
    """A margin in parts that add up to it: the venue's share, the rest to strength."""
    venue = F.when(F.col("neutral"), 0.0).otherwise(2.2)
    m = F.col("home_score") - F.col("away_score")
    return ratable(contests(s, d)).select("game_id", rnd(m - venue).alias("strength"), rnd(venue).alias("venue"), m.alias("margin"))


@query(
    """WITH r AS (SELECT o_orderpriority AS status, count(*) + 2 AS n, sum((o_orderstatus = 'F')::INT) + 1 AS absences FROM orders GROUP BY 1),
c AS (SELECT *, sum(n) OVER o AS cn, sum(absences) OVER o AS ca, row_number() OVER o AS i FROM r WINDOW o AS (ORDER BY status)),
blocks AS (SELECT m.status, a.i AS first, min((b.ca - a.ca + a.absences)::DOUBLE / (b.cn - a.cn + a.n)) AS low
  FROM c m JOIN c a ON a.i <= m.i JOIN c b ON b.i >= m.i GROUP BY ALL)
SELECT status, (n - 2)::BIGINT AS n, (absences - 1)::BIGINT AS absences, """
    + rnd_sql("max(low)")
    + " AS rate FROM blocks JOIN r USING (status) GROUP BY ALL"
)
def status_absence_rates(s, d):
    """Smoothed rate of an outcome for each report status, pooled so that it never falls along the statuses' order."""
    o = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("status")).agg((F.count("*") + 2).alias("n"), (F.sum((F.col("o_orderstatus") == "F").cast("long")) + 1).alias("absences"))
    pooled = U.pooled_rates(o, "status", "absences", "n")
    return pooled.select("status", (F.col("n") - 2).alias("n"), (F.col("absences") - 1).alias("absences"), rnd(F.col("rate")).alias("rate"))
