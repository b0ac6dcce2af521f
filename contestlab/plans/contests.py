"""Queries over contests and teams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestlab.functions.scoring import logistic, rnd, rnd_sql
from contestlab.operators import standings as S
from contestlab.plans.registry import registry
from contestlab.sources.views import CONTEST, SIDES, TEAM, contests, ratable, sides, table, teams, with_views

QUERIES, ORACLES, query = registry()


def _won(s, d):
    return sides(ratable(contests(s, d)))


RATED = CONTEST + "," + SIDES + ", rated AS (SELECT * FROM sides WHERE status = 'final' AND scored <> allowed)"


@query(
    with_views(RATED, TEAM)
    + """, tab AS (
  SELECT season, r.team_id, t.team, t.conference, sum((scored > allowed)::INT)::BIGINT AS wins, sum((scored < allowed)::INT)::BIGINT AS losses,
         sum((scored > allowed AND o.conference = t.conference)::INT)::BIGINT AS conf_wins,
         sum((scored > allowed AND o.conference = t.conference AND o.division = t.division)::INT)::BIGINT AS div_wins,
         sum(scored - allowed)::BIGINT AS diff
  FROM rated r JOIN team t USING (team_id) JOIN team o ON r.opp_id = o.team_id GROUP BY ALL)
SELECT *, rank() OVER (PARTITION BY season, conference ORDER BY wins / (wins + losses) DESC, diff DESC) AS place FROM tab"""
)
def standings_by_season(s, d):
    return S.standings(_won(s, d), teams(s, d))


@query(with_views(RATED) + "SELECT team_id, opp_id, count(*) AS games, sum((scored > allowed)::INT)::BIGINT AS wins, sum(scored - allowed)::BIGINT AS diff FROM rated GROUP BY ALL")
def head_to_head_matrix(s, d):
    return _won(s, d).groupBy("team_id", "opp_id").agg(F.count("*").alias("games"), F.sum(S.won()).alias("wins"), F.sum(F.col("scored") - F.col("allowed")).alias("diff"))


@query(
    with_views(RATED)
    + """SELECT team_id, season, sum((scored > allowed)::INT)::BIGINT AS wins, sum((scored < allowed)::INT)::BIGINT AS losses,
  sum((is_home AND scored > allowed)::INT)::BIGINT AS home_wins, sum(scored - allowed)::BIGINT AS diff
  FROM rated WHERE game_date <= DATE '1997-06-30' GROUP BY ALL"""
)
def records_through_date(s, d):
    return S.records(_won(s, d).where(F.col("game_date") <= F.lit("1997-06-30").cast("date")), ["team_id", "season"])


@query(with_views(CONTEST) + "SELECT game_date::VARCHAR AS day, count(*) AS games, count(*) FILTER (status = 'final') AS finals FROM contest GROUP BY 1")
def games_per_date(s, d):
    return contests(s, d).groupBy(F.col("game_date").cast("string").alias("day")).agg(F.count("*").alias("games"), F.count(F.when(F.col("status") == "final", 1)).alias("finals"))


@query(
    with_views(CONTEST, SIDES)
    + "SELECT season, count(DISTINCT game_id) AS games, count(DISTINCT team_id) AS teams, min(game_date)::VARCHAR AS first_date, max(game_date)::VARCHAR AS last_date FROM sides GROUP BY season"
)
def season_lengths(s, d):
    """Counts by season; the sides are counted per (season, team) first, so nothing distinct crosses whole."""
    per = sides(contests(s, d)).groupBy("season", "team_id").agg(F.sum(F.col("is_home").cast("long")).alias("g"), F.min("game_date").alias("a"), F.max("game_date").alias("b"))
    return per.groupBy("season").agg(F.sum("g").alias("games"), F.count("*").alias("teams"), F.min("a").cast("string").alias("first_date"), F.max("b").cast("string").alias("last_date"))


@query(
    with_views(CONTEST, SIDES)
    + """, n AS (SELECT season, team_id, count(*) AS games FROM sides GROUP BY ALL), m AS (SELECT season, avg(games) AS mean FROM n GROUP BY season)
SELECT season, team_id, games, (games < 0.5::DOUBLE * mean OR games > 1.5::DOUBLE * mean)::INT AS implausible FROM n JOIN m USING (season)"""
)
def schedule_plausibility(s, d):
    n = sides(contests(s, d)).groupBy("season", "team_id").agg(F.count("*").alias("games"))
    mean = F.avg("games").over(Window.partitionBy("season"))
    return n.withColumn("_m", mean).select("season", "team_id", "games", ((F.col("games") < 0.5 * F.col("_m")) | (F.col("games") > 1.5 * F.col("_m"))).cast("int").alias("implausible"))


PAIRS = ", p AS (SELECT *, least(home_id, away_id) AS low_id, greatest(home_id, away_id) AS high_id, ((home_score > away_score) = (home_id < away_id))::BIGINT AS w FROM ratable)"


@query(
    with_views(CONTEST)
    + PAIRS
    + """SELECT season, low_id, high_id, sum(w)::BIGINT AS low_wins, sum(1 - w)::BIGINT AS high_wins, arg_min(home_id, (game_date, game_id)) AS first_host,
  min(game_date)::VARCHAR AS first_date, max(game_date)::VARCHAR AS last_date FROM p GROUP BY season, low_id, high_id"""
)
def series_grouping(s, d):
    return S.series_of_pairs(ratable(contests(s, d)))


@query(
    with_views(CONTEST)
    + PAIRS
    + """SELECT game_id, season, low_id, high_id, row_number() OVER o AS game_number,
  coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low_before,
  coalesce(sum(1 - w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS high_before
  FROM p WINDOW o AS (PARTITION BY season, low_id, high_id ORDER BY game_date, game_id)"""
)
def running_series_score(s, d):
    return S.running_series(ratable(contests(s, d)))


@query(
    with_views(CONTEST, SIDES)
    + """, r AS (SELECT *, game_date - lag(game_date) OVER (PARTITION BY team_id, season ORDER BY game_date, game_id) AS rest FROM sides)
SELECT game_id, team_id, season, coalesce(rest::BIGINT, -1) AS rest_days, coalesce((rest = 1)::INT, 0) AS back_to_back FROM r"""
)
def back_to_back_flags(s, d):
    return S.rest_flags(sides(contests(s, d)))


@query(
    with_views(CONTEST, SIDES)
    + "SELECT game_id, team_id, row_number() OVER (PARTITION BY team_id ORDER BY game_date, game_id) - 1 AS ordinal FROM sides WHERE status = 'scheduled'"
)
def pending_ordinals(s, d):
    order = Window.partitionBy("team_id").orderBy("game_date", "game_id")
    return sides(contests(s, d).where("status = 'scheduled'")).select("game_id", "team_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"))


@query(
    with_views(RATED)
    + """, i AS (SELECT *, (scored < allowed)::INT AS lost, row_number() OVER (PARTITION BY team_id, season ORDER BY game_date, game_id)
    - row_number() OVER (PARTITION BY team_id, season, (scored < allowed)::INT ORDER BY game_date, game_id) AS island,
    (lead(game_id) OVER (PARTITION BY team_id, season ORDER BY game_date, game_id) IS NULL)::INT AS opened FROM rated)
SELECT team_id, season, count(*) AS length, min(game_date)::VARCHAR AS first_date, max(game_date)::VARCHAR AS last_date, max(opened) AS still_open
FROM i WHERE lost = 1 GROUP BY team_id, season, island"""
)
def loss_streaks(s, d):
    return S.streaks(_won(s, d))


@query(
    with_views(CONTEST)
    + """SELECT game_id, CASE WHEN game_date >= DATE '1998-01-01' THEN 'scheduled' ELSE status END AS status,
  CASE WHEN game_date < DATE '1998-01-01' THEN home_score ELSE -1 END AS home_score, CASE WHEN game_date < DATE '1998-01-01' THEN away_score ELSE -1 END AS away_score FROM contest"""
)
def time_travel_season(s, d):
    known = S.as_of_date(contests(s, d), "1998-01-01")
    return known.select("game_id", "status", F.coalesce("home_score", F.lit(-1)).alias("home_score"), F.coalesce("away_score", F.lit(-1)).alias("away_score"))


@query(
    with_views(CONTEST)
    + """, days AS (SELECT DISTINCT game_date AS target FROM contest WHERE status = 'scheduled')
SELECT target::VARCHAR AS target, count(game_id) AS blockers, coalesce(min(game_id), -1) AS first_blocker
FROM days LEFT JOIN (SELECT * FROM contest WHERE status <> 'final') c ON c.game_date < target AND c.game_date >= target - 3 GROUP BY 1"""
)
def blocking_games(s, d):
    return S.blocking(contests(s, d)).select(F.col("target").cast("string").alias("target"), "blockers", F.coalesce("first_blocker", F.lit(-1)).alias("first_blocker"))


@query(
    with_views(RATED)
    + """, a AS (SELECT team_id, season, sum((scored > allowed)::INT)::BIGINT AS left_value FROM rated GROUP BY ALL),
b AS (SELECT team_id, season, count(*) AS right_value FROM rated WHERE scored > allowed AND NOT neutral GROUP BY ALL)
SELECT team_id, season, left_value, right_value, CASE WHEN left_value IS NULL THEN 'missing-left' WHEN right_value IS NULL THEN 'missing-right'
  WHEN abs(left_value - right_value) > 3 THEN 'differs' ELSE 'agrees' END AS verdict FROM a FULL JOIN b USING (team_id, season)"""
)
def standings_reconciliation(s, d):
    """Wins from all rated contests against wins from those not on neutral ground, with three games' tolerance."""
    rows, keys = _won(s, d), ["team_id", "season"]
    every = rows.groupBy(*keys).agg(F.sum(S.won()).alias("wins"))
    settled = rows.where("scored > allowed AND NOT neutral").groupBy(*keys).agg(F.count("*").alias("wins"))
    return S.reconcile(every, settled, keys, "wins", 3)


HOME = ", h AS (SELECT season, sum((home_score > away_score)::INT)::BIGINT AS home_wins, count(*) AS games FROM ratable GROUP BY season)"


@query(with_views(CONTEST) + HOME + f"SELECT season, home_wins, games, {rnd_sql('sum(home_wins) OVER w / sum(games) OVER w')} AS prior_rate FROM h WINDOW w AS (ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def home_rate_expanding(s, d):
    return S.prior_rate(_by_season(s, d), "home_wins", "games", "season").withColumn("prior_rate", rnd(F.col("prior_rate")))


@query(with_views(CONTEST) + HOME + f"SELECT season, home_wins, games, {rnd_sql('sum(home_wins) OVER w / sum(games) OVER w')} AS prior_rate FROM h WINDOW w AS (ORDER BY season RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def climatology_ten_window(s, d):
    return S.prior_rate(_by_season(s, d), "home_wins", "games", "season", back=10).withColumn("prior_rate", rnd(F.col("prior_rate")))


def _by_season(s, d):
    return ratable(contests(s, d)).groupBy("season").agg(F.sum((F.col("home_score") > F.col("away_score")).cast("long")).alias("home_wins"), F.count("*").alias("games"))


def _sweeps_sql(n: int) -> str:
    parts = [
        ", e AS (SELECT team_id, opp_id, count(*) AS w, sum(scored - allowed) AS m FROM rated GROUP BY ALL), r0 AS (SELECT team_id, sum(m) / sum(w)::DOUBLE AS net, 0.0::DOUBLE AS r FROM e GROUP BY team_id)"
    ]
    for k in range(n):
        parts.append(
            f", f{k} AS (SELECT e.team_id, sum(e.w * o.r) / sum(e.w)::DOUBLE AS f FROM e JOIN r{k} o ON e.opp_id = o.team_id GROUP BY e.team_id), r{k + 1} AS (SELECT team_id, net, r * 0.5::DOUBLE + (net + f) * 0.5::DOUBLE AS r FROM r{k} JOIN f{k} USING (team_id))"
        )
    return "".join(parts)


@query(with_views(RATED) + _sweeps_sql(6) + f"SELECT team_id, {rnd_sql('net')} AS net, {rnd_sql('r')} AS adjusted FROM r6")
def adjusted_net_fixed_point(s, d):
    return S.adjusted_net(_won(s, d), sweeps=6).select("team_id", rnd(F.col("net")).alias("net"), rnd(F.col("r")).alias("adjusted"))


GRID = ", g AS (SELECT (20 + k) / 10.0::DOUBLE AS scale FROM range(0, 141) t(k))"


@query(
    with_views(CONTEST)
    + GRID
    + f""", side AS (SELECT season, home_id AS team_id, home_score - away_score AS m FROM ratable UNION ALL SELECT season, away_id, away_score - home_score FROM ratable),
net AS (SELECT season + 1 AS season, team_id, avg(m) AS net FROM side GROUP BY ALL),
x AS (SELECT season, h.net - a.net + CASE WHEN neutral THEN 0.0::DOUBLE ELSE 2.2::DOUBLE END AS m, (home_score > away_score)::INT AS y
  FROM ratable r JOIN net h USING (season) JOIN net a USING (season) WHERE h.team_id = home_id AND a.team_id = away_id),
l AS (SELECT season, scale, avg(power(1.0::DOUBLE / (1.0::DOUBLE + exp(-m / scale)) - y, 2)) AS loss FROM x, g GROUP BY ALL)
SELECT season, arg_min(scale, (floor(loss * 1e9), scale)) AS scale, {rnd_sql('min(loss)')} AS loss FROM l GROUP BY season"""
)
def logistic_scale_grid(s, d):
    """For each season the scale, of 2 to 16 by tenths, whose chances from last season's net margins come nearest the outcomes.

    Every contest meets all scales inside its own row; what shuffles is one partial sum per season and scale."""
    games = ratable(contests(s, d)).select("season", "home_id", "away_id", "neutral", (F.col("home_score") - F.col("away_score")).alias("d"))
    side = games.select("season", F.explode(F.array(F.struct(F.col("home_id").alias("team_id"), F.col("d").alias("m")), F.struct(F.col("away_id").alias("team_id"), (-F.col("d")).alias("m")))).alias("z"))
    net = side.groupBy((F.col("season") + 1).alias("season"), F.col("z.team_id").alias("team_id")).agg(F.avg("z.m").alias("net"))
    of = lambda who: net.select("season", F.col("team_id").alias(who), F.col("net").alias("net_" + who))
    x = games.join(of("home_id"), ["season", "home_id"]).join(of("away_id"), ["season", "away_id"])
    margin = F.col("net_home_id") - F.col("net_away_id") + F.when(F.col("neutral"), 0.0).otherwise(2.2)
    each = x.select("season", margin.alias("m"), (F.col("d") > 0).cast("int").alias("y"), F.explode(F.array(*[F.lit((20 + k) / 10.0) for k in range(141)])).alias("scale"))
    p = 1.0 / (1.0 + F.exp(-F.col("m") / F.col("scale")))
    loss = each.groupBy("season", "scale").agg(F.avg(F.pow(p - F.col("y"), F.lit(2))).alias("loss"))
    return loss.groupBy("season").agg(F.min_by("scale", F.struct(F.floor(F.col("loss") * 1e9), "scale")).alias("scale"), rnd(F.min("loss")).alias("loss"))


@query(
    with_views(CONTEST, TEAM)
    + f""", b AS (SELECT game_id, home_id, away_id, game_date::VARCHAR AS day, neutral, {rnd_sql('1.0::DOUBLE / (1.0::DOUBLE + exp(-(CASE WHEN neutral THEN 0.0::DOUBLE ELSE 2.2::DOUBLE END) / 6.5::DOUBLE))')} AS p_home
  FROM contest WHERE status = 'scheduled')
SELECT game_id, day, h.team AS home, a.team AS away, p_home, (h.conference = a.conference)::INT AS same_conference
FROM b JOIN team h ON home_id = h.team_id JOIN team a ON away_id = a.team_id"""
)
def slate_view(s, d):
    """Scheduled contests with both teams' names and the home side's chance before anything is known of them."""
    t = teams(s, d)
    home = t.select(F.col("team_id").alias("home_id"), F.col("team").alias("home"), F.col("conference").alias("_h"))
    away = t.select(F.col("team_id").alias("away_id"), F.col("team").alias("away"), F.col("conference").alias("_a"))
    games = contests(s, d).where("status = 'scheduled'").join(home, "home_id").join(away, "away_id")
    p = logistic(F.when(F.col("neutral"), 0.0).otherwise(2.2), 6.5)
    return games.select("game_id", F.col("game_date").cast("string").alias("day"), "home", "away", rnd(p).alias("p_home"), (F.col("_h") == F.col("_a")).cast("int").alias("same_conference"))


@query(
    with_views(CONTEST, SIDES)
    + """SELECT team_id, game_id, game_date::VARCHAR AS day, opp_id, is_home::INT AS is_home,
  CASE WHEN status <> 'final' THEN 'pending' WHEN scored > allowed THEN 'W' WHEN scored < allowed THEN 'L' ELSE 'T' END AS outcome,
  sum((status = 'final' AND scored > allowed)::INT) OVER o::BIGINT AS wins, sum((status = 'final' AND scored < allowed)::INT) OVER o::BIGINT AS losses
  FROM sides WINDOW o AS (PARTITION BY team_id, season ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def team_schedule(s, d):
    """Every team's season in order with the outcome and the record so far."""
    o = Window.partitionBy("team_id", "season").orderBy("game_date", "game_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    final = F.col("status") == "final"
    outcome = F.when(~final, "pending").when(F.col("scored") > F.col("allowed"), "W").when(F.col("scored") < F.col("allowed"), "L").otherwise("T")
    return sides(contests(s, d)).select(
        "team_id", "game_id", F.col("game_date").cast("string").alias("day"), "opp_id", F.col("is_home").cast("int").alias("is_home"), outcome.alias("outcome"),
        F.sum((final & (F.col("scored") > F.col("allowed"))).cast("long")).over(o).alias("wins"),
        F.sum((final & (F.col("scored") < F.col("allowed"))).cast("long")).over(o).alias("losses"),
    )


@query(
    with_views(RATED, TEAM)
    + f""", w AS (SELECT team_id, sum((scored > allowed)::INT)::BIGINT AS wins, count(*) AS games FROM rated GROUP BY team_id)
SELECT t.team, t.conference, wins, games, {rnd_sql('wins / sum(wins) OVER ()')} AS share, rank() OVER (ORDER BY wins / games DESC) AS place,
  dense_rank() OVER (PARTITION BY conference ORDER BY wins DESC) AS conference_place, ntile(4) OVER (ORDER BY wins DESC, t.team) AS quarter
FROM w JOIN team t USING (team_id)"""
)
def odds_rows_ranked(s, d):
    """Teams with their share of all wins, rank, place in the conference and quarter of the table."""
    w = _won(s, d).groupBy("team_id").agg(F.sum(S.won()).alias("wins"), F.count("*").alias("games")).join(teams(s, d), "team_id")
    return w.select(
        "team", "conference", "wins", "games",
        rnd(F.col("wins") / F.sum("wins").over(Window.partitionBy())).alias("share"),
        F.rank().over(Window.orderBy(F.desc(F.col("wins") / F.col("games")))).alias("place"),
        F.dense_rank().over(Window.partitionBy("conference").orderBy(F.desc("wins"))).alias("conference_place"),
        F.ntile(4).over(Window.orderBy(F.desc("wins"), "team")).alias("quarter"),
    )


@query(
    with_views(CONTEST)
    + """, m AS (SELECT season, abs(home_score - away_score) AS margin, game_id FROM ratable)
SELECT season, count(*) AS games, quantile_disc(margin, 0.1)::BIGINT AS p10, quantile_disc(margin, 0.5)::BIGINT AS p50, quantile_disc(margin, 0.9)::BIGINT AS p90 FROM m GROUP BY season"""
)
def histogram_quantiles(s, d):
    """Quantiles of the margin from its histogram: the first value whose cumulative count reaches the share."""
    cells = ratable(contests(s, d)).groupBy("season", F.abs(F.col("home_score") - F.col("away_score")).alias("margin")).agg(F.count("*").alias("n"))
    cum = F.sum("n").over(Window.partitionBy("season").orderBy("margin"))
    total = F.sum("n").over(Window.partitionBy("season"))
    c = cells.withColumns({"_c": cum, "_t": total})
    q = lambda share: F.min(F.when(F.col("_c") >= F.col("_t") * share, F.col("margin")))
    return c.groupBy("season").agg(F.sum("n").alias("games"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"))


@query(with_views(CONTEST) + f"SELECT season, {rnd_sql('quantile_cont((home_score - away_score)::DOUBLE, 0.1)')} AS p10, {rnd_sql('quantile_cont((home_score - away_score)::DOUBLE, 0.5)')} AS p50, {rnd_sql('quantile_cont((home_score - away_score)::DOUBLE, 0.9)')} AS p90 FROM ratable GROUP BY season")
def type7_quantiles(s, d):
    m = (F.col("home_score") - F.col("away_score")).cast("double")
    return ratable(contests(s, d)).groupBy("season").agg(*[rnd(F.percentile(m, q)).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)])


@query(
    with_views(CONTEST)
    + f""", t AS (SELECT season, count(*) AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x * x)::DOUBLE AS sxx, sum(x * y)::DOUBLE AS sxy FROM (SELECT season, home_score AS x, away_score AS y FROM ratable) GROUP BY season),
c AS (SELECT season, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM t WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT season, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS a FROM c WHERE n IS NOT NULL)
SELECT season, {rnd_sql('a')} AS intercept, {rnd_sql('b')} AS slope, count(*) AS games, {rnd_sql('sqrt(avg(power(away_score - a - b * home_score, 2)))')} AS rmse
FROM f JOIN ratable USING (season) GROUP BY season, a, b"""
)
def rolling_origin_ols(s, d):
    """Away on home score, fitted on strictly earlier seasons by cumulative sums and judged on the season itself."""
    games = ratable(contests(s, d)).select("season", F.col("home_score").alias("x"), F.col("away_score").alias("y"))
    sums = games.groupBy("season").agg(F.count("*").alias("n"), *[F.sum(e).cast("double").alias(k) for k, e in {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y")}.items()])
    before = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    c = sums.select("season", *[F.sum(k).over(before).alias(k) for k in ("n", "sx", "sy", "sxx", "sxy")]).where("n is not null")
    b = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fit = c.withColumn("b", b).withColumn("a", (F.col("sy") - F.col("b") * F.col("sx")) / F.col("n")).select("season", "a", "b")
    error = F.pow(F.col("y") - F.col("a") - F.col("b") * F.col("x"), F.lit(2))
    out = games.join(fit, "season").groupBy("season", "a", "b").agg(F.count("*").alias("games"), F.sqrt(F.avg(error)).alias("e"))
    return out.select("season", rnd(F.col("a")).alias("intercept"), rnd(F.col("b")).alias("slope"), "games", rnd(F.col("e")).alias("rmse"))


@query(
    with_views(RATED)
    + f"""SELECT season, {rnd_sql('regr_slope(scored, allowed)')} AS slope, {rnd_sql('regr_intercept(scored, allowed)')} AS intercept, {rnd_sql('corr(scored, allowed)')} AS r,
  {rnd_sql('stddev_samp(scored)')} AS sd, {rnd_sql('covar_samp(scored, allowed)')} AS cov FROM rated WHERE is_home GROUP BY season"""
)
def ols_team_line(s, d):
    y, x = F.col("scored").cast("double"), F.col("allowed").cast("double")
    return _won(s, d).where("is_home").groupBy("season").agg(
        rnd(F.regr_slope(y, x)).alias("slope"), rnd(F.regr_intercept(y, x)).alias("intercept"), rnd(F.corr(y, x)).alias("r"), rnd(F.stddev_samp(y)).alias("sd"), rnd(F.covar_samp(y, x)).alias("cov")
    )


@query(
    """WITH c AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal > 5000), s AS (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_acctbal > 5000)
SELECT 'both' AS kind, count(*) AS nations FROM (SELECT n FROM c INTERSECT SELECT n FROM s) UNION ALL
SELECT 'customers only', count(*) FROM (SELECT n FROM c EXCEPT SELECT n FROM s) UNION ALL
SELECT 'suppliers only', count(*) FROM (SELECT n FROM s EXCEPT SELECT n FROM c) UNION ALL SELECT 'either', count(*) FROM (SELECT n FROM c UNION SELECT n FROM s)"""
)
def set_ops_overlap(s, d):
    c = table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n")).distinct()
    v = table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n")).distinct()
    parts = {"both": c.intersect(v), "customers only": c.exceptAll(v), "suppliers only": v.exceptAll(c), "either": c.union(v).distinct()}
    out = None
    for kind, rows in parts.items():
        one = rows.agg(F.count("*").alias("nations")).select(F.lit(kind).alias("kind"), "nations")
        out = one if out is None else out.unionByName(one)
    return out
