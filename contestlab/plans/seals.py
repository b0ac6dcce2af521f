"""Queries over clocks, ledgers, orders and assembly rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestlab.functions.scoring import rnd, rnd_sql
from contestlab.functions.text import fold
from contestlab.operators import audits as U
from contestlab.operators import sealing as Z
from contestlab.operators import temporal as T
from contestlab.operators.relations import fill_down, within_interval
from contestlab.plans.registry import registry
from contestlab.sources.views import BOX, CONTEST, LEDGER, PLAY, PREDICTION, SIDES, TEAM, box_lines, contests, ledger, plays, predictions, ratable, sides, table, teams, with_views

QUERIES, ORACLES, query = registry()


@query(
    with_views(CONTEST)
    + """, x AS (SELECT game_id, game_date, (game_id * 37 % 900 - 100)::INT AS minutes, game_id % 3 > 0 AS first, game_id % 7 = 0 AS final FROM contest),
b AS (SELECT a.game_id, count(o.game_id) AS blockers FROM contest a LEFT JOIN contest o ON o.status <> 'final' AND o.game_date >= a.game_date - 3 AND o.game_date < a.game_date AND (o.home_id = a.home_id OR o.away_id = a.home_id) GROUP BY 1),
s AS (SELECT CASE WHEN minutes <= 0 THEN CASE WHEN first AND NOT final THEN 'missed' END WHEN minutes <= 60 THEN CASE WHEN NOT final THEN 'final' END WHEN first THEN NULL WHEN blockers = 0 THEN 'morning' WHEN minutes <= 360 THEN 'incomplete' ELSE 'wait' END AS decision FROM x JOIN b USING (game_id))
SELECT coalesce(decision, 'none') AS decision, count(*) AS games FROM s GROUP BY 1"""
)
def seal_decisions(s, d):
    """What is due for each contest at its own now: open earlier contests of the home team within three days hold it up.

    Contests name the days on which they block, so it's an equality join on team and day."""
    c = contests(s, d)
    blocked = F.explode(F.sequence(F.date_add("game_date", 1), F.date_add("game_date", 3)))
    still = sides(c).where("status <> 'final'").select("team_id", blocked.alias("day")).groupBy("team_id", "day").agg(F.count("*").alias("blockers"))
    x = c.join(still, (F.col("home_id") == F.col("team_id")) & (F.col("game_date") == F.col("day")), "left")
    what = Z.decision(F.col("game_id") * 37 % 900 - 100, F.col("game_id") % 3 > 0, F.col("game_id") % 7 == 0, F.coalesce("blockers", F.lit(0)))
    return x.groupBy(F.coalesce(what, F.lit("none")).alias("decision")).agg(F.count("*").alias("games"))


@query(
    with_views(PLAY, LEDGER)
    + """, x AS (SELECT *, row_number() OVER (PARTITION BY game, entry ORDER BY ord) AS again, coalesce(bool_or(entry IN ('morning', 'reissued', 'final')) OVER b, false) AS sealed, coalesce(bool_or(entry = 'result') OVER b, false) AS done,
coalesce(bool_or(entry = 'morning') OVER b, false) AS opened, coalesce(bool_or(entry = 'final') OVER b, false) AS closed FROM ledger WINDOW b AS (PARTITION BY game ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT rule, count(*) AS entries, count(DISTINCT game) AS games FROM (SELECT game, unnest(list_filter([CASE WHEN again > 1 AND entry <> 'result' THEN 'repeated' END, CASE WHEN entry = 'result' AND NOT sealed THEN 'result without seal' END,
CASE WHEN entry = 'final' AND done THEN 'sealed after result' END, CASE WHEN entry = 'reissued' AND NOT opened THEN 'reissued without morning' END, CASE WHEN entry = 'missed' AND closed THEN 'missed after final' END], lambda r: r IS NOT NULL)) AS rule FROM x) GROUP BY rule"""
)
def ledger_order_rules(s, d):
    """Entries that break the ledger's order, by rule."""
    return Z.order_rules(ledger(s, d)).groupBy("rule").agg(F.count("*").alias("entries"), F.count_distinct("game").alias("games"))


@query(
    with_views(PLAY)
    + """, x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (kind <> 'error' AND k < 40) AS matched, count(*) FILTER (kind = 'error') AS rejected, (max(event_id) % 6)::BIGINT AS stale_hours, (min(event_id) % 5)::BIGINT AS report_hours FROM play GROUP BY 1)
SELECT day, rows, concat_ws(', ', CASE WHEN rejected >= 3 THEN 'rejections' END, CASE WHEN report_hours > 3 THEN 'no report' END, CASE WHEN stale_hours >= 3 THEN 'stale' END, CASE WHEN rows >= 10 AND matched * 2 < rows THEN 'match share' END) AS alerts FROM x"""
)
def alert_days(s, d):
    """Each day's alerts."""
    p = plays(s, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("rows"), F.count(F.when((F.col("kind") != "error") & (F.col("k") < 40), 1)).alias("matched"), F.count(F.when(F.col("kind") == "error", 1)).alias("rejected"),
        (F.max("event_id") % 6).alias("stale_hours"), (F.min("event_id") % 5).alias("report_hours"),
    )
    return Z.alerts(p).select("day", "rows", "alerts")


@query(
    with_views(PLAY)
    + """, x AS (SELECT *, max(CASE WHEN kind <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS good, max(ts) OVER () AS now FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM play)),
g AS (SELECT user_id, max(CASE WHEN kind <> 'error' THEN i END) AS last_good, count(*) AS rows, date_sub('second', max(ts), max(now)) // 3600 AS age FROM x GROUP BY user_id)
SELECT user_id, (rows - coalesce(last_good, 0))::BIGINT AS streak, rows, age::BIGINT AS age_hours, age > CASE WHEN user_id % 2 = 0 THEN 12 ELSE 36 END AS stale FROM g"""
)
def failure_streaks(s, d):
    """Each source's run of failures at the end, the age of its last sign of life, and whether that is stale."""
    p = plays(s, d)
    now = p.agg(F.max("ts").alias("now"))
    last = p.groupBy("user_id").agg(F.max("ts").alias("last"))
    # One row, the latest instant, meets every source.
    aged = last.join(F.broadcast(now)).select("user_id", F.floor(F.timestamp_diff("SECOND", F.col("last"), F.col("now")) / 3600).alias("age_hours"))
    got = Z.last_streak(p, "user_id", ["ts", "event_id"], F.col("kind") == "error").join(aged, "user_id")
    return got.select("user_id", "streak", "rows", "age_hours", Z.is_stale(F.col("age_hours"), F.col("user_id") % 2 == 0).alias("stale"))


@query(with_views(PLAY) + """, l AS (SELECT event_id, user_id, ts FROM play WHERE kind = 'purchase'), r AS (SELECT user_id, ts, event_id AS found FROM play WHERE kind = 'view')
SELECT l.event_id, CASE WHEN r.ts >= l.ts - INTERVAL 24 HOUR THEN r.found END AS morning, CASE WHEN f.ts >= l.ts + INTERVAL 6 HOUR - INTERVAL 24 HOUR THEN f.found END AS final
FROM (SELECT *, ts + INTERVAL 6 HOUR AS later FROM l) l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts ASOF LEFT JOIN r f ON l.user_id = f.user_id AND l.later >= f.ts""")
def as_of_two_points(s, d):
    """The latest report at a contest's morning and at its final point, none older than a day."""
    p = plays(s, d)
    right = p.where("kind = 'view'").select("user_id", "ts", F.col("event_id").alias("found"))
    age = F.expr("INTERVAL 24 HOURS")

    def at(shift: str, name: str):
        left = p.where("kind = 'purchase'").select("event_id", "user_id", (F.col("ts") + F.expr(shift)).alias("ts"))
        return T.as_of(left, right, ["user_id"], "ts", ["found"], "found", age).select("event_id", F.col("found").alias(name))

    return at("INTERVAL 0 HOURS", "morning").join(at("INTERVAL 6 HOURS", "final"), "event_id")


@query(
    with_views(CONTEST)
    + """, f AS (SELECT season, min(game_date) AS first FROM contest GROUP BY season), c AS (SELECT season, first + ((game_date - first) // 21 * 21)::INT AS checkpoint FROM contest JOIN f USING (season))
SELECT season, checkpoint::VARCHAR AS checkpoint, count(*) AS games FROM c GROUP BY ALL"""
)
def checkpoint_calendar(s, d):
    """Contests by the latest of their season's checkpoints, 21 days apart."""
    return Z.checkpoints(contests(s, d), "season", "game_date").groupBy("season", F.col("checkpoint").cast("string").alias("checkpoint")).agg(F.count("*").alias("games"))


@query(
    with_views(CONTEST, SIDES)
    + """, d AS (SELECT season, team_id, game_date, sum(scored - allowed)::BIGINT AS m, count(*) AS contests FROM sides WHERE status = 'final' GROUP BY ALL)
SELECT season, team_id, game_date::VARCHAR AS day, contests, coalesce(sum(m) OVER (PARTITION BY season, team_id ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d"""
)
def rating_before_date(s, d):
    """Each team's running margin of the season as it stood before every day on which it plays."""
    rows = sides(contests(s, d)).where("status = 'final'").withColumn("m", F.col("scored") - F.col("allowed"))
    return Z.step_values(rows, ["season", "team_id"], "game_date", "m").select("season", "team_id", F.col("game_date").cast("string").alias("day"), "contests", "before")


@query(
    with_views(BOX)
    + """, q AS (SELECT game_id, line_no AS period, sum(CASE side WHEN 'home' THEN points ELSE -points END)::BIGINT AS m FROM box GROUP BY ALL)
SELECT game_id, period, sum(m) OVER (PARTITION BY game_id ORDER BY period)::BIGINT AS margin FROM q"""
)
def period_margins(s, d):
    """The running margin after each period."""
    q = box_lines(s, d).groupBy("game_id", F.col("line_no").alias("period")).agg(F.sum(F.when(F.col("side") == "home", F.col("points")).otherwise(-F.col("points"))).alias("m"))
    return q.select("game_id", "period", F.sum("m").over(Window.partitionBy("game_id").orderBy("period")).alias("margin"))


@query(
    with_views(CONTEST)
    + """, r AS (SELECT season, game_id, game_date, row_number() OVER (PARTITION BY season ORDER BY game_date DESC, game_id) AS place, count(*) OVER (PARTITION BY season) AS n FROM ratable)
SELECT season, place, game_id, game_date::VARCHAR AS day, greatest(0, n - 15)::BIGINT AS over FROM r WHERE place <= 15"""
)
def newest_results(s, d):
    """The last fifteen results of each season, newest first, and how many more there are."""
    got = Z.limited(ratable(contests(s, d)), ["season"], [F.desc("game_date"), F.col("game_id")], 15)
    return got.select("season", "place", "game_id", F.col("game_date").cast("string").alias("day"), "over")


@query(
    with_views(CONTEST)
    + """, c AS (SELECT game_id, season, status, CASE WHEN status = 'final' THEN home_score - away_score END AS v, home_id, game_date FROM contest)
SELECT game_id, row_number() OVER (t ORDER BY v ASC NULLS LAST, game_id) AS up, row_number() OVER (t ORDER BY v DESC NULLS LAST, game_id) AS down,
row_number() OVER (t ORDER BY CASE status WHEN 'final' THEN 0 WHEN 'in-progress' THEN 1 ELSE 2 END, v DESC NULLS LAST, game_id) AS by_status, row_number() OVER (t ORDER BY game_date, game_id) AS by_time FROM c WINDOW t AS (PARTITION BY home_id, season)"""
)
def sorted_places(s, d):
    """Places in each home team's season under four orders, missing values last in either direction."""
    v = F.when(F.col("status") == "final", F.col("home_score") - F.col("away_score"))
    c = contests(s, d).withColumn("v", v)
    rank = F.when(F.col("status") == "final", 0).when(F.col("status") == "in-progress", 1).otherwise(2)
    place = lambda *o: F.row_number().over(Window.partitionBy("home_id", "season").orderBy(*o))
    return c.select(
        "game_id", place(F.col("v").asc_nulls_last(), "game_id").alias("up"), place(F.col("v").desc_nulls_last(), "game_id").alias("down"),
        place(rank, F.col("v").desc_nulls_last(), "game_id").alias("by_status"), place("game_date", "game_id").alias("by_time"),
    )


@query(
    with_views(CONTEST, TEAM)
    + """, i AS (SELECT season, list_sort(list(DISTINCT home_id)) AS l FROM contest GROUP BY season), c AS (SELECT list_sort(list(team_id)) AS l FROM team)
SELECT season, len(i.l)::BIGINT AS teams, i.l = c.l AS complete, len(list_filter(c.l, lambda x: NOT list_contains(i.l, x)))::BIGINT AS missing FROM i, c"""
)
def configured_teams(s, d):
    """Whether every season's hosts are exactly the registered teams."""
    known = teams(s, d).select("team_id")
    got = contests(s, d).select("season", F.col("home_id").alias("team_id")).distinct()
    every = got.select("season").distinct().join(F.broadcast(known.agg(F.collect_set("team_id").alias("want"))))  # one row, the registry
    have = got.groupBy("season").agg(F.collect_set("team_id").alias("have"))
    lost, extra = F.size(F.array_except("want", "have")), F.size(F.array_except("have", "want"))
    return every.join(have, "season").select("season", F.size("have").cast("long").alias("teams"), ((lost == 0) & (extra == 0)).alias("complete"), lost.cast("long").alias("missing"))


@query(
    with_views(CONTEST)
    + """, d AS (SELECT DISTINCT game_date AS day FROM contest WHERE status = 'scheduled'), o AS (SELECT game_id, game_date FROM contest WHERE status = 'scheduled')
SELECT day::VARCHAR AS day, count(*) AS games, min(game_id) AS first_game FROM d JOIN o ON game_date BETWEEN day AND day + 6 GROUP BY day"""
)
def projection_windows(s, d):
    """Scheduled contests of each day and the six after it; contests name the days whose window holds them."""
    c = contests(s, d).where("status = 'scheduled'").select("game_id", "game_date")
    days = c.select(F.col("game_date").alias("day")).distinct()
    named = c.select("game_id", F.explode(F.sequence(F.date_add("game_date", -6), F.col("game_date"))).alias("day"))
    return named.join(days, "day").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("games"), F.min("game_id").alias("first_game"))


@query(
    with_views(CONTEST)
    + """, spans AS (SELECT home_id, away_id, min(game_date) AS a, min(game_date) + 60 AS b FROM contest GROUP BY ALL)
SELECT s.home_id, s.away_id, count(*) AS games, sum(home_score)::BIGINT AS scored FROM contest c JOIN spans s ON c.home_id = s.home_id AND c.away_id = s.away_id AND game_date BETWEEN a AND b GROUP BY ALL"""
)
def contests_in_spans(s, d):
    """Contests of a pair within sixty days of its first."""
    c = contests(s, d)
    spans = c.groupBy("home_id", "away_id").agg(F.min("game_date").alias("a")).withColumn("b", F.date_add("a", 60))
    return within_interval(c, spans, ["home_id", "away_id"], "game_date", "a", "b").groupBy("home_id", "away_id").agg(F.count("*").alias("games"), F.sum("home_score").alias("scored"))


@query(
    with_views(PLAY)
    + """, x AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN k END AS team FROM play), f AS (SELECT *, last_value(team IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM x)
SELECT filled AS team, count(*) AS rows FROM f GROUP BY 1"""
)
def carried_forward(s, d):
    """Rows under the last heading before them."""
    x = plays(s, d).withColumn("team", F.when(F.col("event_id") % 3 == 0, F.col("k")))
    return fill_down(x, ["user_id"], ["ts", "event_id"], ["team"]).groupBy("team").agg(F.count("*").alias("rows"))


@query(
    """WITH k AS (SELECT c_custkey AS id, 'player ' || c_custkey % 400 AS full_name, 'n' || c_custkey % 97 AS surname FROM customer), r AS (SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 2 = 0 THEN 'player ' || s_suppkey % 400 ELSE 'nobody ' || s_suppkey END AS full_name, 'n' || s_suppkey % 97 AS surname FROM supplier),
a AS (SELECT full_name, min(id) AS a FROM k GROUP BY 1 HAVING count(*) = 1), b AS (SELECT surname, min(id) AS b FROM k WHERE full_name NOT IN (SELECT full_name FROM r) GROUP BY 1 HAVING count(*) = 1)
SELECT row_id, coalesce(a, b) AS id FROM r LEFT JOIN a USING (full_name) LEFT JOIN b USING (surname)"""
)
def surname_fallback(s, d):
    """Listed names by their full name where it is unique, else by a surname that only one unused name has."""
    c, r = table(s, d, "customer"), table(s, d, "supplier")
    named = lambda key, text: F.concat(F.lit(text), (F.col(key) % (400 if text == "player " else 97)).cast("string"))
    known = c.select(F.col("c_custkey").alias("id"), named("c_custkey", "player ").alias("full_name"), named("c_custkey", "n").alias("surname"))
    full = F.when(F.col("s_suppkey") % 2 == 0, named("s_suppkey", "player ")).otherwise(F.concat(F.lit("nobody "), F.col("s_suppkey").cast("string")))
    rows = r.select(F.col("s_suppkey").alias("row_id"), full.alias("full_name"), named("s_suppkey", "n").alias("surname"))
    return Z.two_pass_match(rows, known, "full_name", "surname", "id").select("row_id", "id")


@query(
    with_views(BOX)
    + """SELECT athlete_id, sum(points) FILTER (game_id % 3 = 0)::BIGINT AS a, sum(points) FILTER (game_id % 3 = 1)::BIGINT AS b, sum(points) FILTER (game_id % 3 = 2)::BIGINT AS c, sum(minutes)::BIGINT AS minutes FROM box GROUP BY athlete_id HAVING sum(minutes) >= 250"""
)
def exposed_totals(s, d):
    """Totals per part of the season, of athletes with at least 250 minutes."""
    b = box_lines(s, d).groupBy("athlete_id")
    part = lambda i: F.sum(F.when(F.col("game_id") % 3 == i, F.col("points")))
    return b.agg(part(0).alias("a"), part(1).alias("b"), part(2).alias("c"), F.sum("minutes").alias("minutes")).where("minutes >= 250")


@query(
    with_views(PREDICTION)
    + f""", x AS (SELECT least(9, floor(p * 10))::INT AS bin, p, y FROM prediction)
SELECT bin, count(*) AS n, {rnd_sql('avg(p)')} AS predicted, {rnd_sql('avg(y)')} AS observed, {rnd_sql('avg(abs(p - y))')} AS mae, {rnd_sql('sqrt(avg((p - y) * (p - y)))')} AS rmse FROM x GROUP BY bin"""
)
def calibration_nonempty(s, d):
    """Equal bins of the home side's chance that hold any forecast, with both errors."""
    gap = F.col("p") - F.col("y")
    x = predictions(s, d).withColumn("bin", F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int"))
    return x.groupBy("bin").agg(F.count("*").alias("n"), rnd(F.avg("p")).alias("predicted"), rnd(F.avg("y")).alias("observed"), rnd(F.avg(F.abs(gap))).alias("mae"), rnd(F.sqrt(F.avg(gap * gap))).alias("rmse"))


@query(
    with_views(PREDICTION)
    + f""", e AS (SELECT season, count(*) AS n, sum(p - y) AS s1, sum((p - y) * (p - y)) AS s2 FROM prediction GROUP BY season), c AS (SELECT season, sum(n) OVER w AS n, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM e WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT season, n::BIGINT AS earlier, CASE WHEN n >= 30 THEN {rnd_sql('sqrt((s2 - s1 * s1 / n) / (n - 1))')} END AS sd FROM c WHERE n IS NOT NULL"""
)
def disagreement_sd(s, d):
    """The spread of errors over strictly earlier seasons, where these hold at least thirty forecasts: sums, then a window over seasons."""
    e = predictions(s, d).withColumn("e", F.col("p") - F.col("y")).groupBy("season").agg(F.count("*").alias("n"), F.sum("e").alias("s1"), F.sum(F.col("e") * F.col("e")).alias("s2"))
    w = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    c = e.select("season", *[F.sum(x).over(w).alias(x) for x in ("n", "s1", "s2")]).where("n IS NOT NULL")
    return c.select("season", F.col("n").alias("earlier"), F.when(F.col("n") >= 30, rnd(F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1)))).alias("sd"))


@query(
    with_views(PREDICTION)
    + f""", g AS (SELECT l / 10.0::DOUBLE AS l, r / 10.0::DOUBLE AS r FROM range(0, 6) a(l), range(0, 6) b(r)), x AS (SELECT season, l, r, sum(power(least(1, greatest(0, p * (1 - l) + l * p2 - r * 0.1::DOUBLE)) - y, 2)) AS loss, count(*) AS n FROM prediction, g GROUP BY ALL), t AS (SELECT l, r, sum(loss) / sum(n) AS loss FROM x GROUP BY ALL)
SELECT l, r, {rnd_sql('loss', 7)} AS loss FROM t ORDER BY floor(loss * 1e10), l, r LIMIT 1"""
)
def best_tuning_cell(s, d):
    """The cell of a grid of two settings with the least loss; of equal ones the first in the grid's order."""
    cells = F.explode(F.array(*[F.struct(F.lit(i / 10.0).alias("l"), F.lit(j / 10.0).alias("r")) for i in range(6) for j in range(6)])).alias("c")
    x = predictions(s, d).select("p", "p2", "y", cells).select("*", "c.*")
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") * (1 - F.col("l")) + F.col("l") * F.col("p2") - F.col("r") * 0.1))
    t = x.groupBy("l", "r").agg(F.avg(F.pow(q - F.col("y"), F.lit(2))).alias("loss"))
    return t.orderBy(F.floor(F.col("loss") * 1e10), "l", "r").limit(1).select("l", "r", rnd(F.col("loss"), 7).alias("loss"))


@query(
    with_views(CONTEST, SIDES)
    + """, n AS (SELECT season, team_id, sum(scored - allowed)::BIGINT AS net, count(*) AS games FROM sides WHERE status = 'final' GROUP BY ALL)
SELECT a.season, team_id, a.net, b.net AS next_net FROM n a JOIN n b USING (team_id) WHERE b.season = a.season + 1 AND a.games >= 3 AND b.games >= 3"""
)
def season_to_season(s, d):
    """Net margins of teams in a season and the next, where both have enough results."""
    n = sides(contests(s, d)).where("status = 'final'").groupBy("season", "team_id").agg(F.sum(F.col("scored") - F.col("allowed")).alias("net"), F.count("*").alias("games")).where("games >= 3")
    later = n.select((F.col("season") - 1).alias("season"), "team_id", F.col("net").alias("next_net"))
    return n.join(later, ["season", "team_id"]).select("season", "team_id", "net", "next_net")


@query(
    with_views(CONTEST, SIDES)
    + """, c AS (SELECT season, team_id, count(*) AS n FROM sides GROUP BY ALL HAVING count(*) >= 20)
SELECT season, count(*) AS games FROM contest SEMI JOIN c h ON contest.season = h.season AND home_id = h.team_id SEMI JOIN c a ON contest.season = a.season AND away_id = a.team_id GROUP BY season"""
)
def without_stray_teams(s, d):
    """Contests of seasons in which both sides play often enough."""
    c = contests(s, d)
    often = sides(c).groupBy("season", "team_id").agg(F.count("*").alias("n")).where("n >= 20")
    for side in ("home_id", "away_id"):
        c = c.join(often.select("season", F.col("team_id").alias(side)), ["season", side], "left_semi")
    return c.groupBy("season").agg(F.count("*").alias("games"))


@query(
    with_views(CONTEST, SIDES, TEAM)
    + """, w AS (SELECT season, conference, team_id, sum((scored > allowed)::INT)::BIGINT AS wins, sum(scored - allowed)::BIGINT AS net FROM sides JOIN team USING (team_id) WHERE status = 'final' AND is_home GROUP BY ALL)
SELECT season, conference, team_id, seed, 9 - seed AS meets FROM (SELECT *, row_number() OVER (PARTITION BY season, conference ORDER BY wins DESC, net DESC, team_id) AS seed FROM w) WHERE seed <= 4"""
)
def inferred_seeds(s, d):
    """Seeds of each conference's four best hosts by wins and net margin, and the seed that each meets."""
    w = sides(contests(s, d)).where("status = 'final' AND is_home").join(teams(s, d), "team_id").groupBy("season", "conference", "team_id").agg(F.sum((F.col("scored") > F.col("allowed")).cast("long")).alias("wins"), F.sum(F.col("scored") - F.col("allowed")).alias("net"))
    seed = F.row_number().over(Window.partitionBy("season", "conference").orderBy(F.desc("wins"), F.desc("net"), "team_id"))
    return w.withColumn("seed", seed).where("seed <= 4").select("season", "conference", "team_id", "seed", (9 - F.col("seed")).alias("meets"))


@query(
    with_views(CONTEST, TEAM)
    + """, p AS (SELECT season, least(home_id, away_id) AS a, greatest(home_id, away_id) AS b, min(game_date) AS first, max(game_date) AS last, count(*) AS games, string_agg(CASE WHEN home_id < away_id THEN 'H' ELSE 'A' END, '' ORDER BY game_date, game_id) AS pattern FROM contest GROUP BY ALL)
SELECT season, a, b, first::VARCHAR AS starts, last::VARCHAR AS ends, games, substr(pattern, 1, 7) AS pattern FROM p WHERE games >= 2"""
)
def normalised_series(s, d):
    """Pairs of a season with their first and last day and who is at home in their first seven games."""
    c = contests(s, d)
    low = F.when(F.col("home_id") < F.col("away_id"), "H").otherwise("A")
    place = F.row_number().over(Window.partitionBy("season", F.least("home_id", "away_id"), F.greatest("home_id", "away_id")).orderBy("game_date", "game_id"))
    p = c.withColumns({"a": F.least("home_id", "away_id"), "b": F.greatest("home_id", "away_id"), "low": low, "i": place}).groupBy("season", "a", "b").agg(
        F.min("game_date").cast("string").alias("starts"), F.max("game_date").cast("string").alias("ends"), F.count("*").alias("games"), F.sort_array(F.collect_list(F.when(F.col("i") <= 7, F.struct("i", "low")))).alias("l")
    )
    return p.where("games >= 2").select("season", "a", "b", "starts", "ends", "games", F.array_join(F.transform("l", lambda x: x["low"]), "").alias("pattern"))


@query(
    with_views(CONTEST, SIDES)
    + """, x AS (SELECT team_id, game_date FROM sides WHERE status = 'scheduled'), q AS (SELECT DISTINCT team_id, game_date FROM sides WHERE season = 1996)
SELECT q.team_id, q.game_date::VARCHAR AS day, min(x.game_date)::VARCHAR AS next_day FROM q LEFT JOIN x ON q.team_id = x.team_id AND x.game_date > q.game_date GROUP BY ALL"""
)
def next_scheduled_day(s, d):
    """Each team's next scheduled day after each of its days: carried back through the days in order, without a range join."""
    rows = sides(contests(s, d)).groupBy("team_id", "game_date").agg(F.bool_or(F.col("status") == "scheduled").alias("open"), F.bool_or(F.col("season") == 1996).alias("asked"))
    w = Window.partitionBy("team_id").orderBy(F.desc("game_date")).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("next_day", F.last(F.when(F.col("open"), F.col("game_date")), ignorenulls=True).over(w))
    return found.where("asked").select("team_id", F.col("game_date").cast("string").alias("day"), F.col("next_day").cast("string").alias("next_day"))


@query(
    "WITH n AS (SELECT lower(split_part(c_name, '#', 1)) || c_custkey % 40 AS key, c_nationkey AS team, c_custkey AS id FROM customer), g AS (SELECT key, count(*) AS n, min(id) AS id FROM n GROUP BY key), t AS (SELECT key, team, count(*) AS n, min(id) AS id FROM n GROUP BY ALL) "
    "SELECT t.key, t.team, CASE WHEN t.n = 1 THEN t.id END AS own, CASE WHEN g.n = 1 THEN g.id END AS global FROM t JOIN g USING (key)"
)
def name_index(s, d):
    """Names that tell one athlete, within a team and over all teams."""
    n = table(s, d, "customer").select(F.concat(fold(F.split_part("c_name", F.lit("#"), F.lit(1))), (F.col("c_custkey") % 40).cast("string")).alias("key"), F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("id"))
    only = lambda: F.when(F.count("*") == 1, F.min("id"))
    return n.groupBy("key", "team").agg(only().alias("own")).join(n.groupBy("key").agg(only().alias("global")), "key")


@query(
    with_views(BOX, CONTEST)
    + """, b AS (SELECT game_id, side, sum(points)::BIGINT AS points FROM box GROUP BY ALL), x AS (SELECT game_id, home_score AS score, 'home' AS side FROM contest UNION ALL SELECT game_id, away_score, 'away' FROM contest)
SELECT side, count(*) AS sides, count(*) FILTER (abs(coalesce(points, 0) - score) > 5) AS apart, max(abs(coalesce(points, 0) - score))::BIGINT AS worst FROM x LEFT JOIN b USING (game_id, side) GROUP BY side"""
)
def box_score_gaps(s, d):
    """How often an athlete sum and a final score are more than five points apart."""
    b = box_lines(s, d).groupBy("game_id", "side").agg(F.sum("points").alias("points"))
    x = contests(s, d).select("game_id", F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home_score").alias("score")), F.struct(F.lit("away").alias("side"), F.col("away_score").alias("score")))).alias("z")).select("game_id", "z.*")
    gap = F.abs(F.coalesce("points", F.lit(0)) - F.col("score"))
    return x.join(b, ["game_id", "side"], "left").groupBy("side").agg(F.count("*").alias("sides"), F.count(F.when(gap > 5, 1)).alias("apart"), F.max(gap).alias("worst"))


@query(
    """WITH x AS (SELECT o_orderkey AS id, o_totalprice AS total, o_orderdate AS issued, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5 - 1) AS snapshot, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 7 - 1) AS starts FROM orders)
SELECT rule, count(*) AS issues FROM (SELECT unnest(list_filter([CASE WHEN issued < snapshot THEN 'before snapshot' END, CASE WHEN issued >= starts THEN 'not before start' END, CASE WHEN total <= 0 THEN 'no value' END], lambda r: r IS NOT NULL)) AS rule FROM x) GROUP BY rule"""
)
def issuance_rules(s, d):
    """Forecasts issued before their snapshot or not before their start."""
    day = lambda n: F.expr(f"o_orderdate + make_dt_interval(int(o_orderkey % {n} - 1))")
    x = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("issued"), day(5).alias("snapshot"), day(7).alias("starts"))
    rules = {"before snapshot": F.col("issued") < F.col("snapshot"), "not before start": F.col("issued") >= F.col("starts"), "no value": F.col("total") <= 0}
    return U.broken_rules(x, ["id"], rules).groupBy("rule").agg(F.count("*").alias("issues"))


@query(
    with_views(CONTEST, SIDES)
    + """, h AS (SELECT min(scored) AS low, max(scored) AS high FROM sides WHERE status = 'final' AND season < 1996)
SELECT game_id, team_id, CASE WHEN scored > high THEN 'high' ELSE 'low' END AS flag FROM sides, h WHERE status = 'final' AND season >= 1996 AND (scored > high OR scored < low)"""
)
def historical_extremes(s, d):
    """Scores beyond all that the reference seasons saw: their two bounds are one row."""
    rows = sides(contests(s, d)).where("status = 'final'")
    bounds = rows.where("season < 1996").agg(F.min("scored").alias("low"), F.max("scored").alias("high"))
    x = rows.where("season >= 1996").join(F.broadcast(bounds))
    return x.where("scored > high OR scored < low").select("game_id", "team_id", F.when(F.col("scored") > F.col("high"), "high").otherwise("low").alias("flag"))


@query(
    with_views(CONTEST, SIDES)
    + """, o AS (SELECT DISTINCT team_id, season, game_date FROM sides WHERE status <> 'final'), r AS (SELECT *, dense_rank() OVER (PARTITION BY team_id, season ORDER BY game_date) AS i FROM o)
SELECT team_id, season, min(game_date) FILTER (i = 1)::VARCHAR AS first, min(game_date) FILTER (i = 2)::VARCHAR AS second, count(*) FILTER (i > 2) AS others FROM r GROUP BY team_id, season"""
)
def report_blocks(s, d):
    """The first two dates of each team's report of a season, and how many others follow."""
    o = sides(contests(s, d)).where("status <> 'final'").select("team_id", "season", "game_date").distinct()
    r = o.withColumn("i", F.dense_rank().over(Window.partitionBy("team_id", "season").orderBy("game_date")))
    at = lambda i: F.min(F.when(F.col("i") == i, F.col("game_date"))).cast("string")
    return r.groupBy("team_id", "season").agg(at(1).alias("first"), at(2).alias("second"), F.count(F.when(F.col("i") > 2, 1)).alias("others"))


@query(
    with_views(PLAY, LEDGER)
    + """, g AS (SELECT game, bool_or(entry IN ('morning', 'reissued', 'final')) AS sealed, bool_or(entry = 'result') AS done, bool_or(entry = 'missed') AS missed, arg_min(p, CASE entry WHEN 'final' THEN ord WHEN 'morning' THEN ord + 1000000000 END) AS p FROM ledger GROUP BY game)
SELECT CASE WHEN sealed AND done THEN 'scored' WHEN missed AND NOT sealed THEN 'missed' WHEN sealed THEN 'pending' ELSE 'unsealed' END AS state, count(*) AS games, """
    + rnd_sql("coalesce(avg(p), 0)")
    + " AS mean_p FROM g GROUP BY 1"
)
def version_ledger(s, d):
    """Games of the ledger by state, and the mean of their first final or else first morning chance."""
    rows = ledger(s, d)
    rank = F.when(F.col("entry") == "final", F.col("ord")).when(F.col("entry") == "morning", F.col("ord") + 1_000_000_000)
    is_a = lambda *k: F.bool_or(F.col("entry").isin(*k))
    g = rows.groupBy("game").agg(is_a("morning", "reissued", "final").alias("sealed"), is_a("result").alias("done"), is_a("missed").alias("missed"), F.min_by("p", rank).alias("p"))
    state = F.when(F.col("sealed") & F.col("done"), "scored").when(F.col("missed") & ~F.col("sealed"), "missed").when(F.col("sealed"), "pending").otherwise("unsealed")
    return g.groupBy(state.alias("state")).agg(F.count("*").alias("games"), rnd(F.coalesce(F.avg("p"), F.lit(0.0))).alias("mean_p"))


@query(
    with_views(CONTEST)
    + """, n AS (SELECT max(game_date) - 400 AS today FROM contest)
SELECT game_date::VARCHAR AS day, CASE WHEN game_date < today THEN 'past' WHEN game_date = today THEN 'today' ELSE 'future' END AS part, count(*) AS games, count(*) FILTER (status = 'final') AS finals,
sum(CASE WHEN game_date < today AND status = 'final' THEN home_score - away_score END)::BIGINT AS margin FROM contest, n GROUP BY ALL"""
)
def day_views(s, d):
    """Each day as past, today or future; margins are told of past days only."""
    c = contests(s, d)
    now = c.agg(F.date_add(F.max("game_date"), -400).alias("today"))  # one row
    x = c.join(F.broadcast(now)).withColumn("part", F.when(F.col("game_date") < F.col("today"), "past").when(F.col("game_date") == F.col("today"), "today").otherwise("future"))
    told = F.when((F.col("part") == "past") & (F.col("status") == "final"), F.col("home_score") - F.col("away_score"))
    return x.groupBy(F.col("game_date").cast("string").alias("day"), "part").agg(F.count("*").alias("games"), F.count(F.when(F.col("status") == "final", 1)).alias("finals"), F.sum(told).alias("margin"))
