"""Queries over models refitted by date and by season, and over seeds refined tie by tie."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestlab.functions.scoring import brier, log_loss, rnd, rnd_sql
from contestlab.operators import absences as A
from contestlab.operators import refits as R
from contestlab.operators import search as D
from contestlab.operators import seeding as S
from contestlab.operators import sparse as P
from contestlab.plans.registry import registry
from contestlab.session import cut_lineage
from contestlab.sources.views import BOX, CONTEST, PREDICTION, SIDES, TEAM, box_lines, contests, predictions, ratable, sides, teams, with_views

QUERIES, ORACLES, query = registry()

RIDGE, HOME, SCALE, SWEEPS = 2.0, 3.0, 12.0, 12


def _sweep_sql() -> str:
    """Ratings of every season and date by unrolled sweeps over dense pair sums."""
    parts = [
        f""", g AS (SELECT season, game_date, home_id, away_id, home_score - away_score - CASE WHEN neutral THEN 0 ELSE {HOME}::DOUBLE END AS m FROM ratable),
side AS (SELECT season, game_date, home_id AS a, away_id AS b, m FROM g UNION ALL SELECT season, game_date, away_id, home_id, -m FROM g),
day AS (SELECT DISTINCT season, game_date AS d FROM g),
pair AS (SELECT s.season, d, a, b, sum(m) AS m, count(*) AS n FROM day JOIN side s ON s.season = day.season AND s.game_date < d GROUP BY ALL),
team AS (SELECT season, d, a, sum(m) AS m, sum(n) AS n FROM pair GROUP BY ALL),
r0 AS (SELECT season, d, a, 0.0::DOUBLE AS r FROM team)"""
    ]
    for k in range(SWEEPS):
        parts.append(f", r{k + 1} AS (SELECT t.season, t.d, t.a, (max(t.m) + sum(p.n * r.r)) / (max(t.n) + {RIDGE}::DOUBLE) AS r FROM team t JOIN pair p ON p.season = t.season AND p.d = t.d AND p.a = t.a JOIN r{k} r ON r.season = p.season AND r.d = p.d AND r.a = p.b GROUP BY ALL)")
    return "".join(parts)


@query(
    with_views(CONTEST)
    + _sweep_sql()
    + f""" SELECT c.season, game_id, {rnd_sql(f'1 / (1 + exp(-(coalesce(h.r, 0) - coalesce(a.r, 0) + CASE WHEN neutral THEN 0 ELSE {HOME}::DOUBLE END) / {SCALE}::DOUBLE))')} AS p
FROM ratable c LEFT JOIN r{SWEEPS} h ON h.season = c.season AND h.d = c.game_date AND h.a = home_id LEFT JOIN r{SWEEPS} a ON a.season = c.season AND a.d = c.game_date AND a.a = away_id"""
)
def ratings_by_date(s, d):
    """Home chances from ratings refitted on every date from the season's contests so far."""
    games = ratable(contests(s, d))
    rated = R.ratings_to_date(games, RIDGE, HOME, SWEEPS)
    home = F.when(F.col("neutral"), 0.0).otherwise(HOME)
    p = 1.0 / (1.0 + F.exp(-(F.col("home_rating") - F.col("away_rating") + home) / SCALE))
    return rated.join(games.select("game_id", "neutral"), "game_id").select("season", "game_id", rnd(p).alias("p"))


def _newton_sql(steps: int) -> str:
    """From d(season, x, y): fits n{steps}(fold, a, b) with the moments st, by unrolled Newton steps."""
    parts = [
        """, fold AS (SELECT DISTINCT season AS fold FROM d), st AS (SELECT fold, avg(x) AS m, coalesce(nullif(stddev_pop(x), 0), 1) AS sd, count(*) AS n FROM fold JOIN d ON season < fold GROUP BY fold HAVING count(*) >= 30),
z AS (SELECT fold, (x - m) / sd AS z, y FROM st JOIN d ON season < fold), n0 AS (SELECT fold, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM st)"""
    ]
    for k in range(steps):
        parts.append(
            f", s{k} AS (SELECT fold, max(a) AS a, max(b) AS b, sum(y - q) AS g0, sum(z * (y - q)) - max(b) AS g1, sum(w) AS h0, sum(w * z) AS h1, sum(w * z * z) + 1 AS h2 FROM (SELECT *, greatest(1e-6::DOUBLE, q * (1 - q)) AS w FROM (SELECT *, 1 / (1 + exp(-(a + b * z))) AS q FROM z JOIN n{k} USING (fold))) GROUP BY fold)"
            f", n{k + 1} AS (SELECT fold, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM s{k})"
        )
    return "".join(parts)


CLAMPED = "least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, p))"


@query(
    with_views(PREDICTION)
    + f", d AS (SELECT season, ln({CLAMPED} / (1 - {CLAMPED})) AS x, p, y FROM prediction)"
    + _newton_sql(10)
    + f""", f AS (SELECT season, p, y, 1 / (1 + exp(-(a + b * (x - m) / sd))) AS q, a, b / sd AS slope FROM d JOIN n10 ON fold = season JOIN st USING (fold))
SELECT season, count(*) AS n, {rnd_sql('max(slope)', 5)} AS slope, {rnd_sql('avg((p - y) ** 2)')} AS raw_brier, {rnd_sql('avg((q - y) ** 2)')} AS brier, {rnd_sql('avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END)')} AS log_loss FROM f GROUP BY season"""
)
def nested_recalibration(s, d):
    """Forecasts recalibrated, season by season, by a logistic curve fitted on the forecasts of earlier seasons only."""
    rows = predictions(s, d).withColumn("x", R.log_odds(F.col("p")))
    fits = R.logistic_by_season(rows, "season", ["x"], "y")
    scored = R.held_out(rows, fits, "season", ["x"]).join(F.broadcast(fits.select("season", (F.col("slopes")[0] / F.col("deviations")[0]).alias("slope"))), "season")
    return scored.groupBy("season").agg(
        F.count("*").alias("n"), rnd(F.max("slope"), 5).alias("slope"), rnd(brier(F.col("p"), F.col("y"))).alias("raw_brier"),
        rnd(brier(F.col("fitted"), F.col("y"))).alias("brier"), rnd(log_loss(F.col("fitted"), F.col("y"), 0.0)).alias("log_loss"),
    )


@query(
    with_views(CONTEST)
    + """, side AS (SELECT season, game_id, game_date, home_id AS t, home_score - away_score AS m FROM ratable UNION ALL SELECT season, game_id, game_date, away_id, away_score - home_score FROM ratable),
daily AS (SELECT season, game_date, t, sum(m) AS m, count(*) AS n FROM side GROUP BY ALL),
run AS (SELECT season, game_date, t, sum(m) OVER w AS m, sum(n) OVER w AS n FROM daily WINDOW w AS (PARTITION BY season, t ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT c.season, game_id, (c.home_score > c.away_score)::INT AS y, coalesce(h.m / (h.n + 2), 0)::DOUBLE - coalesce(a.m / (a.n + 2), 0)::DOUBLE AS x
  FROM ratable c JOIN run h ON h.season = c.season AND h.game_date = c.game_date AND h.t = c.home_id JOIN run a ON a.season = c.season AND a.game_date = c.game_date AND a.t = c.away_id)"""
    + _newton_sql(10)
    + f""", rate AS (SELECT fold, avg(y) AS r FROM st JOIN d ON season < fold GROUP BY fold),
f AS (SELECT season, y, 1 / (1 + exp(-(a + b * (x - m) / sd))) AS q, r FROM d JOIN n10 ON fold = season JOIN st USING (fold) JOIN rate USING (fold))
SELECT season, count(*) AS n, {rnd_sql('avg((q - y) ** 2)')} AS margin_brier, {rnd_sql('avg((r - y) ** 2)')} AS rate_brier, avg((q - y) ** 2) < avg((r - y) ** 2) AS better FROM f GROUP BY season"""
)
def fitted_baselines(s, d):
    """A logistic baseline on the difference of shrunk season-to-date margins, and the home rate, both of earlier seasons."""
    games = ratable(contests(s, d))
    margin = F.col("home_score") - F.col("away_score")
    side = F.array(F.struct(F.col("home_id").alias("t"), margin.alias("m")), F.struct(F.col("away_id").alias("t"), (-margin).alias("m")))
    daily = games.select("season", "game_date", F.explode(side).alias("s")).groupBy("season", "game_date", "s.t").agg(F.sum("s.m").alias("m"), F.count("*").alias("n"))
    w = Window.partitionBy("season", "t").orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)
    form = daily.select("season", "game_date", "t", F.coalesce(F.sum("m").over(w) / (F.sum("n").over(w) + 2), F.lit(0.0)).alias("form"))
    rows = games.select("season", "game_date", "game_id", "home_id", "away_id", (margin > 0).cast("int").alias("y"))
    for where, name in (("home_id", "h"), ("away_id", "a")):
        rows = rows.join(form.withColumnsRenamed({"t": where, "form": name}), ["season", "game_date", where])
    rows = rows.withColumn("x", F.col("h") - F.col("a"))
    fits = R.logistic_by_season(rows, "season", ["x"], "y")
    seasons = rows.groupBy("season").agg(F.sum("y").alias("won"), F.count("*").alias("n"))
    earlier = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)  # one row for each season
    rate = seasons.select("season", (F.sum("won").over(earlier) / F.sum("n").over(earlier)).alias("rate"))
    scored = R.held_out(rows, fits, "season", ["x"]).join(F.broadcast(rate), "season")
    model, plain = brier(F.col("fitted"), F.col("y")), brier(F.col("rate"), F.col("y"))
    return scored.groupBy("season").agg(F.count("*").alias("n"), rnd(model).alias("margin_brier"), rnd(plain).alias("rate_brier"), (model < plain).alias("better"))


def _refine_sql(name: str, source: str, part: str, rounds: int = 6) -> str:
    """name(*, place): source's rows ordered within `part` by unrolled rounds of the tie-break."""
    share = lambda w, l: f"coalesce({w}::DOUBLE / nullif({w} + {l}, 0), 0)"
    parts = [f", {name}0 AS (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY {share('wins', 'losses')} DESC) AS g FROM {source})"]
    for k in range(rounds):
        same = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in [*part.split(","), "g"])
        spread = lambda m: f"max({m}) OVER t - min({m}) OVER t >= 1e-9"
        parts.append(
            f""", {name}h{k} AS (SELECT a.month, a.team_id, sum(w) AS w, sum(l) AS l FROM {name}0 z JOIN {name}{k} a USING (month, team_id) JOIN met m ON m.month = a.month AND m.team_id = a.team_id JOIN {name}{k} b ON b.month = a.month AND b.team_id = m.opp_id AND {same} GROUP BY ALL),
{name}m{k} AS (SELECT x.*, {share('h.w', 'h.l')} AS hh, count(*) OVER t AS n, min(division) OVER t = max(division) OVER t AS one FROM {name}{k} x LEFT JOIN {name}h{k} h USING (month, team_id) WINDOW t AS (PARTITION BY {part}, g)),
{name}s{k} AS (SELECT *, CASE WHEN n = 2 THEN hh ELSE leader END AS m0, CASE WHEN n = 2 THEN leader ELSE hh END AS m1, CASE WHEN one THEN {share('div_wins', 'div_losses')} ELSE 0 END AS m2, {share('conf_wins', 'conf_losses')} AS m3, diff::DOUBLE AS m4 FROM {name}m{k}),
{name}v{k} AS (SELECT *, CASE {' '.join(f'WHEN {spread(m)} THEN {m}' for m in ('m0', 'm1', 'm2', 'm3', 'm4'))} ELSE -team_id END AS v FROM {name}s{k} WINDOW t AS (PARTITION BY {part}, g)),
{name}{k + 1} AS (SELECT * EXCLUDE (hh, n, one, m0, m1, m2, m3, m4, v, g), g + rank() OVER (PARTITION BY {part}, g ORDER BY v DESC) - 1 AS g FROM {name}v{k})"""
        )
    parts.append(f", {name} AS (SELECT * EXCLUDE (g), g AS place FROM {name}{rounds})")
    return "".join(parts)


@query(
    with_views(CONTEST, SIDES, TEAM)
    + """, r AS (SELECT strftime(game_date, '%Y-%m') AS month, s.team_id, opp_id, (scored > allowed)::INT AS won, scored - allowed AS d, a.conference, a.division, a.conference = b.conference AS conf, a.division = b.division AS div
  FROM sides s JOIN team a ON a.team_id = s.team_id JOIN team b ON b.team_id = opp_id WHERE status = 'final' AND scored <> allowed),
met AS (SELECT month, team_id, opp_id, sum(won) AS w, sum(1 - won) AS l FROM r GROUP BY ALL),
base AS (SELECT month, team_id, conference, division, sum(won) AS wins, sum(1 - won) AS losses, sum(won * conf::INT) AS conf_wins, sum((1 - won) * conf::INT) AS conf_losses, sum(won * (conf AND div)::INT) AS div_wins, sum((1 - won) * (conf AND div)::INT) AS div_losses, sum(d) AS diff, 0 AS leader FROM r GROUP BY ALL)"""
    + _refine_sql("p", "base", "month, conference, division")
    + ", led AS (SELECT * EXCLUDE (place, leader), (place = 1)::INT AS leader FROM p)"
    + _refine_sql("q", "led", "month, conference")
    + " SELECT month, conference, team_id, wins::BIGINT AS wins, losses::BIGINT AS losses, leader, place::INT AS place FROM q"
)
def seeds_by_month(s, d):
    """Seeds of every month's conferences by the recursive tie-break, where short records leave many ties."""
    rows = sides(ratable(contests(s, d))).withColumn("month", F.date_format("game_date", "yyyy-MM"))
    return S.seeds(rows.select("month", "team_id", "opp_id", "scored", "allowed"), teams(s, d), "month")


@query()
def paired_effects_by_season(s, d):
    """Each season's teams for and against: home points less away points from season levels, the home court and both teams'
    effects, which shrink towards half of the team's plain mean margin."""
    games = ratable(contests(s, d))
    term = lambda x, *parts: F.struct(F.concat_ws(":", *parts).alias("c"), F.lit(x).alias("x"))
    season = F.col("season").cast("string")
    terms = F.array(term(1.0, F.lit("season"), season), term(1.0, F.lit("team"), season, "home_id"), term(-1.0, F.lit("team"), season, "away_id"))
    court = F.when(~F.col("neutral"), F.array(term(1.0, F.lit("home")))).otherwise(F.array().cast("array<struct<c: string, x: double>>"))
    rows = games.select(F.concat(terms, court).alias("terms"), (F.col("home_score") - F.col("away_score")).cast("double").alias("y"), F.lit(1.0).alias("w"))
    plain = sides(games).groupBy(F.concat_ws(":", F.lit("team"), season, "team_id").alias("c")).agg(F.lit(20.0).alias("penalty"), (F.avg(F.col("scored") - F.col("allowed")) / 2).alias("prior"))
    return P.sparse_ridge(rows, plain).select("c", rnd(F.col("prior"), 4).alias("prior"), rnd(F.col("effect"), 4).alias("effect"))


@query(
    with_views(BOX)
    + f""", own AS (SELECT athlete_id, game_id, sum(points * minutes) AS s, sum(minutes) AS w FROM box GROUP BY ALL),
rest AS (SELECT athlete_id, game_id, s / w AS y, CASE WHEN sum(w) OVER a > w THEN (sum(s) OVER a - s) / (sum(w) OVER a - w) END AS x FROM own WINDOW a AS (PARTITION BY athlete_id))
SELECT athlete_id % 10 AS grp, count(*) AS n, {rnd_sql('avg(x)', 4)} AS mean_left_out, {rnd_sql('regr_slope(y, x)', 4)} AS slope FROM rest WHERE x IS NOT NULL GROUP BY ALL"""
)
def left_out_regression(s, d):
    """How an athlete's points in a game follow from the mean of all of their other games, by group of athletes."""
    lines = box_lines(s, d)
    points, minutes = F.col("points").cast("double"), F.col("minutes").cast("double")
    own = lines.groupBy("athlete_id", "game_id").agg((F.sum(points * minutes) / F.sum(minutes)).alias("y"))
    rest = P.leave_one_out(lines, ["athlete_id"], "game_id", points, minutes).where("left_out is not null")
    rows = own.join(rest, ["athlete_id", "game_id"])
    return rows.groupBy((F.col("athlete_id") % 10).alias("grp")).agg(F.count("*").alias("n"), rnd(F.avg("left_out"), 4).alias("mean_left_out"), rnd(F.regr_slope("y", "left_out"), 4).alias("slope"))


@query(
    with_views(CONTEST, SIDES, BOX)
    + f""", tg AS (SELECT team_id, game_id, is_home, row_number() OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS n FROM sides WHERE status = 'final'),
pl AS (SELECT t.team_id, b.supplier AS athlete_id, t.n, sum(b.points) AS points FROM tg t JOIN box b ON b.game_id = t.game_id AND (b.side = 'home') = t.is_home GROUP BY ALL),
sp AS (SELECT *, lead(n) OVER (PARTITION BY team_id, athlete_id ORDER BY n) - n - 1 AS length FROM pl),
fur AS (SELECT missed, avg(length - missed) AS expected FROM (SELECT length, unnest(range(1, least(length, 20) + 1)) AS missed FROM sp WHERE length > 0) GROUP BY missed),
now AS (SELECT p.team_id, athlete_id, l.last - max(n) AS missed, avg(points) / 10 AS points FROM pl p JOIN (SELECT team_id, max(n) AS last FROM tg GROUP BY 1) l USING (team_id) GROUP BY p.team_id, athlete_id, l.last),
ab AS (SELECT team_id, points, expected FROM now JOIN fur ON fur.missed = least(now.missed, 20) WHERE now.missed > 0 AND expected > 0),
pe AS (SELECT team_id, count(*) AS games FROM sides WHERE status = 'scheduled' GROUP BY 1),
pt AS (SELECT team_id, games, unnest(range(-1, games)) AS place FROM pe),
sh AS (SELECT p.team_id, place, points * least(1.0::DOUBLE, greatest(0.0::DOUBLE, expected - CASE WHEN place < 0 THEN games ELSE place END)) AS v FROM pt p JOIN ab USING (team_id))
SELECT pt.team_id, pt.place::INT AS place, {rnd_sql('coalesce(sum(v), 0)', 4)} AS points, count(*) FILTER (v > 0) AS absent FROM pt LEFT JOIN sh ON sh.team_id = pt.team_id AND sh.place = pt.place GROUP BY ALL"""
)
def absences_ahead(s, d):
    """What absences take from each team's coming contests, by how long absences that have lasted as long went on."""
    side = sides(contests(s, d))
    done = side.where("status = 'final'")
    games = done.select("team_id", "game_id", "is_home", F.row_number().over(Window.partitionBy("team_id").orderBy("game_date", "game_id")).alias("n"))
    lines = box_lines(s, d).select("game_id", (F.col("side") == "home").alias("is_home"), F.col("supplier").alias("athlete_id"), "points")
    played = games.join(lines, ["game_id", "is_home"]).groupBy("team_id", "athlete_id", "n").agg(F.sum("points").alias("points"))
    ended, open_ = A.spells(played, games)
    worth = played.groupBy("team_id", "athlete_id").agg((F.avg("points") / 10).alias("points"))
    going = open_.join(worth, ["team_id", "athlete_id"]).withColumn("missed", F.least("missed", F.lit(A.MOST)))
    absences = going.join(F.broadcast(A.further(ended)), "missed")  # at most MOST rows
    pending = side.where("status = 'scheduled'").groupBy("team_id").agg(F.count("*").alias("games"))
    return A.spread(absences, pending).select("team_id", "place", rnd(F.col("points"), 4).alias("points"), "absent")


CURVE = {"scale": [8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0, 1024.0], "home": [-8.0, -4.0, 0.0, 2.0, 4.0, 8.0, 16.0], "cap": [2.0, 5.0, 10.0, 20.0, 40.0, 80.0]}
START = {"scale": 16.0, "home": 4.0, "cap": 40.0}


def _descent_sql(passes: int = 4) -> str:
    """best{k}(scale, home, cap, loss) after each coordinate, unrolled; from cell(x, neutral, n, won)."""
    loss = "sum(-won * ln(q) - (n - won) * ln(1 - q))"
    q = "least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, 1 / (1 + exp(-(least(cap, greatest(-cap, x)) + CASE WHEN neutral THEN 0 ELSE home END) / scale))))"
    first = ", ".join(f"{v}::DOUBLE AS {k}" for k, v in START.items())
    parts = [f", best0 AS (SELECT scale, home, cap, {loss} AS loss FROM (SELECT *, {q} AS q FROM cell, (SELECT {first})) GROUP BY ALL)"]
    k = 0
    for turn in range(2 * passes):
        for name, values in CURVE.items():
            listed = f"{values}::DOUBLE[]"
            if turn >= passes:  # the grids whose edge was best have one step more
                edge = lambda at, step: f"CASE WHEN (SELECT {name} FROM best{passes * len(CURVE)}) = {at} THEN [{step}]::DOUBLE[] ELSE []::DOUBLE[] END"
                listed = f"({edge(values[0], 2 * values[0] - values[1])} || {listed} || {edge(values[-1], 2 * values[-1] - values[-2])})"
            rest = ", ".join("v AS " + c if c == name else c for c in CURVE)
            parts.append(
                f", try{k} AS (SELECT scale, home, cap, i, {loss} AS loss FROM (SELECT *, {q} AS q FROM cell, (SELECT i, {rest} FROM best{k}, (SELECT unnest({listed}) AS v, generate_subscripts({listed}, 1) AS i))) GROUP BY ALL),"
                f" best{k + 1} AS (SELECT CASE WHEN t.loss < b.loss - 1e-7 THEN t.scale ELSE b.scale END AS scale, CASE WHEN t.loss < b.loss - 1e-7 THEN t.home ELSE b.home END AS home, CASE WHEN t.loss < b.loss - 1e-7 THEN t.cap ELSE b.cap END AS cap, least(t.loss, b.loss) AS loss FROM best{k} b, (SELECT * FROM try{k} ORDER BY loss, i LIMIT 1) t)"
            )
            k += 1
    return "".join(parts) + f", best AS (SELECT * FROM best{k})"


@query(
    with_views(CONTEST)
    + """, cell AS (SELECT (h.m - a.m)::DOUBLE AS x, neutral, count(*) AS n, sum((home_score > away_score)::INT) AS won FROM ratable c
  JOIN (SELECT season, home_id AS t, floor(avg(home_score - away_score)) AS m FROM ratable GROUP BY ALL) h ON h.season = c.season - 1 AND h.t = home_id
  JOIN (SELECT season, away_id AS t, floor(avg(away_score - home_score)) AS m FROM ratable GROUP BY ALL) a ON a.season = c.season - 1 AND a.t = away_id GROUP BY ALL)"""
    + _descent_sql()
    + f" SELECT scale, home, cap, {rnd_sql('loss', 4)} AS loss FROM best"
)
def margin_curve_search(s, d):
    """Scale, home court and cap of a curve from last season's margins to chances, by coordinate descent over its cells."""
    games = ratable(contests(s, d))
    margin = F.col("home_score") - F.col("away_score")
    form = lambda side, m: games.groupBy((F.col("season") + 1).alias("season"), side).agg(F.floor(F.avg(m)).alias("m_" + side))
    rows = games.join(form("home_id", margin), ["season", "home_id"]).join(form("away_id", -margin), ["season", "away_id"])
    x = (F.col("m_home_id") - F.col("m_away_id")).cast("double").alias("x")
    cells = cut_lineage(rows.groupBy(x, "neutral").agg(F.count("*").alias("n"), F.sum((margin > 0).cast("long")).alias("won")))

    def loss(p):
        z = F.least(p["cap"], F.greatest(-p["cap"], F.col("x"))) + F.when(F.col("neutral"), 0.0).otherwise(p["home"])
        q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), 1.0 / (1.0 + F.exp(-z / p["scale"]))))
        return -F.col("won") * F.ln(q) - (F.col("n") - F.col("won")) * F.ln(1.0 - q)

    best, least = D.coordinate_descent(cells, CURVE, START, loss)
    return s.range(1).select(*[F.lit(best[k]).alias(k) for k in CURVE], rnd(F.lit(least), 4).alias("loss"))
