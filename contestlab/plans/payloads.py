"""Queries that read payloads and fields: the tables are first written as the payloads that a source would send."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestlab.functions import fields as P
from contestlab.functions.scoring import expected_score, game_score, in_game_probability, normal_cdf_sql, rnd, rnd_sql
from contestlab.functions.text import first_last
from contestlab.plans.registry import registry
from contestlab.sources import payloads as J
from contestlab.sources.views import BOX, CONTEST, PLAY, PREDICTION, SIDES, TEAM, box_lines, contests, plays, predictions, ratable, sides, table, teams, with_views

QUERIES, ORACLES, query = registry()

NAMES = {"final": "STATUS_FINAL", "in-progress": "STATUS_HALFTIME", "scheduled": "STATUS_SCHEDULED"}
NOTES = ("East First Round - Game 1", "West Semifinals - Game 2", "Eastern Conference Finals - Game 3", "NBA Finals - Game 4", "")


def schedule_payloads(s, d):
    c = contests(s, d)
    name = P.named(NAMES, F.col("status"))
    score = lambda side: F.when(F.col("status") == "final", F.col(side).cast("string"))
    lines = lambda side: F.array(F.struct(F.floor(F.col(side) / 2).cast("double").alias("value")), F.struct((F.col(side) - F.floor(F.col(side) / 2)).cast("double").alias("value")))
    club = lambda which, team, side: F.struct(F.lit(which).alias("homeAway"), F.struct(F.concat(F.lit("T"), F.col(team)).alias("abbreviation")).alias("team"), score(side).alias("score"), lines(side).alias("linescores"))
    line = lambda a, b: F.struct(F.when(F.col(a) < F.col(b), -110 - 5 * F.col(a)).otherwise(100 + 7 * F.col(b)).cast("int").alias("moneyLine"))
    clock = F.concat((F.col("game_id") % 12).cast("string"), F.lit(":"), F.lpad((F.col("game_id") % 60).cast("string"), 2, "0"))
    competition = F.struct(
        F.col("neutral").alias("neutralSite"), F.struct(F.struct(name.alias("name")).alias("type"), clock.alias("displayClock"), (F.col("game_id") % 4 + 1).cast("int").alias("period")).alias("status"),
        F.when(F.col("game_id") % 89 == 0, F.array(club("home", "home_id", "home_score"))).otherwise(F.array(club("away", "away_id", "away_score"), club("home", "home_id", "home_score"))).alias("competitors"),
        F.array(F.struct(line("home_id", "away_id").alias("homeTeamOdds"), line("away_id", "home_id").alias("awayTeamOdds"))).alias("odds"),
        F.array(F.struct(F.element_at(F.array(*map(F.lit, NOTES)), (F.col("game_id") % 5 + 1).cast("int")).alias("headline"))).alias("notes"),
        F.array(F.struct(F.when(F.col("game_id") % 2 == 0, "national").otherwise("home").alias("market"), F.array(F.lit("A"), F.lit("B"), F.lit("A")).alias("names")), F.struct(F.lit("away").alias("market"), F.array(F.lit("C")).alias("names"))).alias("broadcasts"),
    )
    event = F.to_json(F.struct(F.col("game_id").cast("string").alias("id"), F.date_format("game_date", "yyyy-MM-dd'T'00:00:00'Z'").alias("date"), F.array(competition).alias("competitions")))
    return c.select("game_id", F.when(F.col("game_id") % 97 == 0, "{bad").otherwise(event).alias("payload"))


IMPLIED = "CASE WHEN {a} < {b} THEN (110 + 5 * {a}) / (210 + 5 * {a})::DOUBLE ELSE 100 / (200 + 7 * {b})::DOUBLE END"


@query(
    with_views(CONTEST)
    + f""", x AS (SELECT *, game_id % 97 = 0 AS bad, game_id % 89 = 0 AS lone, {IMPLIED.format(a='home_id', b='away_id')} AS ph, {IMPLIED.format(a='away_id', b='home_id')} AS pa FROM contest)
SELECT game_id, CASE WHEN bad THEN NULL ELSE strftime(game_date, '%Y-%m-%dT00:00:00Z') END AS starts, CASE WHEN bad THEN 'scheduled' ELSE status END AS status, CASE WHEN bad THEN NULL ELSE ((game_id % 12) * 60 + game_id % 60)::INT END AS clock,
CASE WHEN bad THEN NULL ELSE 'T' || home_id END AS home, CASE WHEN bad OR lone THEN NULL ELSE 'T' || away_id END AS away, CASE WHEN bad OR status <> 'final' THEN NULL ELSE home_score::INT END AS home_score, CASE WHEN bad THEN 0 ELSE home_score END::BIGINT AS home_lines,
CASE WHEN bad THEN NULL ELSE {rnd_sql('ph / (ph + pa)')} END AS p_home, CASE WHEN NOT bad AND game_id % 5 < 4 THEN (game_id % 5 + 1)::INT END AS round, CASE WHEN bad THEN NULL WHEN game_id % 5 IN (0, 2) THEN 'East' WHEN game_id % 5 = 1 THEN 'West' END AS conference,
CASE WHEN bad THEN NULL WHEN game_id % 2 = 0 THEN 'A, B' ELSE 'A, B' END AS channels, CASE WHEN bad THEN 'unreadable' WHEN lone THEN 'sides' END AS reason FROM x"""
)
def schedule_events(s, d):
    """Events of a schedule payload, with the reason why one can't be used."""
    e = J.events(schedule_payloads(s, d))
    return e.select("game_id", "starts", "status", "clock", "home", "away", "home_score", "home_lines", rnd(F.col("p_home")).alias("p_home"), "round", "conference", "channels", "reason")


@query(
    with_views(BOX)
    + """SELECT game_id, athlete_id, (minutes % 48) * 60 + line_no AS seconds, CASE WHEN line_no = 7 THEN NULL ELSE least(points, minutes)::INT END AS made, CASE WHEN line_no = 7 THEN NULL ELSE minutes::INT END AS attempted, points::INT AS points,
CASE WHEN game_id % 2 = 0 THEN NULL WHEN line_no % 2 = 0 THEN -line_no ELSE line_no END::INT AS signed FROM box"""
)
def box_score_lines(s, d):
    """Athletes' lines of a box-score payload whose labels come in either of two orders."""
    b = box_lines(s, d)
    time = F.concat((F.col("minutes") % 48).cast("string"), F.lit(":"), F.lpad(F.col("line_no").cast("string"), 2, "0"))
    shots = F.when(F.col("line_no") == 7, "-").otherwise(F.concat_ws("-", F.least("points", "minutes"), F.col("minutes")))
    plus = F.concat(F.when(F.col("line_no") % 2 == 0, "-").otherwise("+"), F.col("line_no").cast("string"))
    stats = F.when(F.col("game_id") % 2 == 0, F.array(F.col("points").cast("string"), time, shots)).otherwise(F.array(time, plus, shots, F.col("points").cast("string")))
    labels = F.when(F.col("game_id") % 2 == 0, F.array(*map(F.lit, ("PTS", "MIN", "FG")))).otherwise(F.array(*map(F.lit, ("MIN", "+/-", "FG", "PTS"))))
    sent = b.groupBy("game_id").agg(F.to_json(F.struct(F.first(labels).alias("labels"), F.collect_list(F.struct(F.col("athlete_id").alias("id"), stats.alias("stats"))).alias("athletes"))).alias("payload"))
    return J.box_scores(sent).select("game_id", "athlete_id", "seconds", "made", "attempted", "points", "signed")


@query(
    with_views(CONTEST, SIDES)
    + "SELECT team_id::VARCHAR AS team, sum((scored > allowed)::INT)::BIGINT AS wins, sum((scored < allowed)::INT)::BIGINT AS losses, CASE WHEN team_id % 3 > 0 THEN sum(scored - allowed)::BIGINT END AS differential FROM sides WHERE status = 'final' GROUP BY team_id"
)
def standings_payload(s, d):
    """Standings sent as names and values, one of them missing for some teams."""
    t = sides(contests(s, d)).where("status = 'final'").groupBy("team_id").agg(F.sum((F.col("scored") > F.col("allowed")).cast("int")).alias("w"), F.sum((F.col("scored") < F.col("allowed")).cast("int")).alias("l"), F.sum(F.col("scored") - F.col("allowed")).alias("x"))
    pair = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value"))
    stats = F.when(F.col("team_id") % 3 > 0, F.array(pair("differential", "x"), pair("losses", "l"), pair("wins", "w"))).otherwise(F.array(pair("wins", "w"), pair("losses", "l")))
    return J.standings(t.select(F.to_json(F.struct(F.col("team_id").cast("string").alias("team"), stats.alias("stats"))).alias("payload")), ("wins", "losses", "differential"))


REASONS = ("G League - Two-Way", "Rest; load management", "Ankle sprain", "Illness", "Personal")


@query(
    "WITH r AS (SELECT c_nationkey, c_name, c_custkey % 5 AS k, ['Out', 'Doubtful', 'Questionable', 'Probable', 'Active'][c_custkey % 5 + 1] AS status, c_custkey % 7 AS n FROM customer WHERE c_custkey % 11 > 0) "
    "SELECT c_nationkey::VARCHAR AS team, c_name AS athlete, status, '2024-01-0' || (1 + n) AS day, ['league', 'rest', 'injury', 'illness', 'other'][n % 5 + 1] AS kind FROM r WHERE k < 4"
)
def injury_payload(s, d):
    """Injury lists of teams, nested; unnamed athletes and unknown states are left out."""
    c = table(s, d, "customer")
    n = F.col("c_custkey") % 7
    item = F.struct(
        F.when(F.col("c_custkey") % 11 > 0, F.col("c_name")).alias("athlete"), F.element_at(F.array(*map(F.lit, ("Out", "Doubtful", "Questionable", "Probable", "Active"))), (F.col("c_custkey") % 5 + 1).cast("int")).alias("status"),
        F.concat(F.lit("2024-01-0"), (n + 1).cast("string"), F.lit("T12:00Z")).alias("date"), F.struct(F.element_at(F.array(*map(F.lit, REASONS)), (n % 5 + 1).cast("int")).alias("type")).alias("details"),
    )
    # A payload holds one team's list, dealt over parts as a source pages it.
    sent = c.groupBy("c_nationkey", (F.col("c_custkey") % 16).alias("page")).agg(F.collect_list(item).alias("l"))
    return J.injuries(sent.select(F.to_json(F.struct(F.col("c_nationkey").cast("string").alias("team"), F.col("l").alias("injuries"))).alias("payload")))


EASTERN = """t AS (SELECT *, make_timestamp(year(u), 3, 8 + ((7 - dayofweek(make_date(year(u), 3, 8))) % 7)::INT, 7, 0, 0) AS opens, make_timestamp(year(u), 11, 1 + ((7 - dayofweek(make_date(year(u), 11, 1))) % 7)::INT, 6, 0, 0) AS closes FROM u),
l AS (SELECT *, u - CASE WHEN u >= opens AND u < closes THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS wall FROM t)"""


@query(
    "WITH u AS (SELECT event_id, ts::TIMESTAMP AS u FROM events), " + EASTERN + """
SELECT wall::DATE::VARCHAR AS day, hour(wall)::INT AS hour, count(*) AS n, min(event_id) AS first_event FROM l GROUP BY ALL"""
)
def local_days_and_hours(s, d):
    """Instants by the day and hour of the eastern wall clock."""
    wall = P.local_time(F.col("ts").cast("timestamp_ntz"))
    e = table(s, d, "events").select("event_id", wall.alias("wall"))
    return e.groupBy(F.to_date("wall").cast("string").alias("day"), F.hour("wall").alias("hour")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    """WITH e AS (SELECT event_id, TIMESTAMP '2024-11-03 00:00:00' + to_minutes(((hour(ts) % 4 * 60 + minute(ts)) // 15 * 15)::BIGINT) AS w FROM events)
SELECT strftime(w, '%H:%M') AS wall, strftime(w + CASE WHEN w < TIMESTAMP '2024-11-03 01:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END, '%Y-%m-%dT%H:%M:%SZ') AS instant, count(*) AS n, min(event_id) AS first_event FROM e GROUP BY ALL"""
)
def wall_clock_instants(s, d):
    """Events by the quarter of their four hours, as if on the night on which an hour comes twice: the later reading counts."""
    quarter = F.floor((F.hour("ts") % 4 * 60 + F.minute("ts")) / 15).cast("int") * 15
    w = F.lit("2024-11-03 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=quarter)
    g = table(s, d, "events").select("event_id", w.alias("w"))
    read = g.select("event_id", F.date_format("w", "HH:mm").alias("wall"), F.date_format(P.utc_instant(F.col("w")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("instant"))
    return read.groupBy("wall", "instant").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    """WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT10:00:00Z') WHEN 1 THEN '2024-02-30T10:00:00Z' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2024-02-29T24:00:00Z' END AS text FROM orders)
SELECT text, count(*) AS n, (right(text, 10) = 'T10:00:00Z' AND text <> '2024-02-30T10:00:00Z')::BOOLEAN AS valid FROM x GROUP BY text"""
)
def well_formed_instants(s, d):
    """Texts that are instants with real calendar fields, and such as only look like it."""
    o = table(s, d, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'10:00:00'Z'")).when(F.col("o_orderkey") % 4 == 1, "2024-02-30T10:00:00Z").when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("2024-02-29T24:00:00Z")
    return o.groupBy(text.alias("text")).agg(F.count("*").alias("n")).select("text", "n", P.is_instant(F.col("text")).alias("valid"))


@query(
    """WITH k AS (SELECT p_partkey AS id, p_size::INT AS n FROM part)
SELECT id, (n - 1 + 2000) || '-' || lpad(((n + 2000) % 100)::VARCHAR, 2, '0') AS season, CASE WHEN n % 100 BETWEEN 11 AND 13 THEN n || 'th' WHEN n % 10 = 1 THEN n || 'st' WHEN n % 10 = 2 THEN n || 'nd' WHEN n % 10 = 3 THEN n || 'rd' ELSE n || 'th' END AS place,
substr('HHAAHAH', 1, n % 7 + 1) AS pattern, translate(substr('HHAAHAH', 1, n % 7 + 1), 'HA', 'AH') AS inverse,
CASE WHEN n = 25 THEN 'even' WHEN n < 25 THEN '-' || ((25 - n) // 10) || '.' || ((25 - n) % 10) ELSE '+' || ((n - 25) // 10) || '.' || ((n - 25) % 10) END AS points,
CASE WHEN n = 50 THEN '100%' ELSE (n * 2) || '%' END AS percent, least(99, greatest(1, n * 2))::INT AS first, (100 - least(99, greatest(1, n * 2)))::INT AS second FROM k"""
)
def labels_and_patterns(s, d):
    """Season labels, places, home patterns and their inverse, signed points, and a chance as text and in whole percent with its complement."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("n"))
    pair = P.percent_pair(F.col("n") / 50.0)
    return p.select(
        "id", P.season_label(F.col("n") + 2000).alias("season"), P.ordinal(F.col("n")).alias("place"), P.home_pattern(F.col("n") % 7 + 1).alias("pattern"), P.home_inverse(P.home_pattern(F.col("n") % 7 + 1)).alias("inverse"),
        P.signed((F.col("n") - 25) / 10.0).alias("points"), P.percent_text(F.col("n") / 50.0).alias("percent"), pair["first"].alias("first"), pair["second"].alias("second"),
    )


@query(
    with_views(CONTEST)
    + f""", x AS (SELECT game_id, home_score - away_score AS m, (720 - game_id % 720)::INT AS clock, (game_id % 5 + 1)::INT AS period, home_id - away_id AS pre FROM ratable),
y AS (SELECT *, CASE WHEN period > 4 THEN clock ELSE (4 - period) * 720 + clock END AS left_s FROM x), z AS (SELECT *, greatest(left_s / 2880.0::DOUBLE, 1 / 48.0::DOUBLE) AS f FROM y), w AS (SELECT *, (m + pre * f) / (18.0::DOUBLE * sqrt(f)) AS q FROM z)
SELECT game_id, left_s::BIGINT AS seconds_left, {rnd_sql('least(1 - 0.005::DOUBLE, greatest(0.005::DOUBLE, ' + normal_cdf_sql('q') + '))')} AS p_home, {rnd_sql('1 / (1 + power(10.0::DOUBLE, -(pre * 25) / 400.0::DOUBLE))')} AS expected FROM w"""
)
def in_game_chances(s, d):
    """The home side's chance with so much time left and such a lead, and the chance that ratings alone give it."""
    c = ratable(contests(s, d)).select("game_id", (F.col("home_score") - F.col("away_score")).alias("m"), (720 - F.col("game_id") % 720).alias("clock"), (F.col("game_id") % 5 + 1).alias("period"), (F.col("home_id") - F.col("away_id")).alias("pre"))
    c = c.withColumn("left", P.seconds_left(F.col("period"), F.col("clock")))
    return c.select("game_id", F.col("left").cast("long").alias("seconds_left"), rnd(in_game_probability(F.col("m"), F.col("left"), F.col("pre"))).alias("p_home"), rnd(expected_score(F.col("pre") * 25)).alias("expected"))


@query(
    with_views(BOX)
    + f"""SELECT athlete_id, count(*) AS games, {rnd_sql('avg(points + 0.4::DOUBLE * (minutes // 2) - 0.7::DOUBLE * minutes - 0.4::DOUBLE * 2 + 0.7::DOUBLE * line_no + 0.3::DOUBLE * 3 + 1 + 0.7::DOUBLE * 2 + 0.7::DOUBLE * 1 - 0.4::DOUBLE * line_no - 2)', 4)} AS score,
{rnd_sql('sum(minutes - line_no + 1 + 0.44::DOUBLE * line_no)', 4)} AS possessions FROM box GROUP BY athlete_id"""
)
def appearance_scores(s, d):
    """The mean one-number summary of an athlete's appearances, and estimated possessions."""
    b = box_lines(s, d)
    half = F.floor(F.col("minutes") / 2)
    one = game_score(F.col("points"), half, F.col("minutes"), F.lit(2), F.lit(4), F.col("line_no"), F.lit(3), F.lit(1), F.lit(2), F.lit(1), F.col("line_no"), F.lit(2))
    return b.groupBy("athlete_id").agg(F.count("*").alias("games"), rnd(F.avg(one), 4).alias("score"), rnd(F.sum(P.possessions(F.col("minutes"), F.col("line_no"), F.lit(1), F.col("line_no"))), 4).alias("possessions"))


@query(
    with_views(PREDICTION)
    + f""", q AS (SELECT id, p, least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, p)) AS c, id % 7 - 3 AS seed, id % 100 - 50 AS gap FROM prediction)
SELECT id, {rnd_sql('1 / (1 + exp(-(0.1::DOUBLE + 0.9::DOUBLE * ln(c / (1 - c)) + 0.05::DOUBLE * seed)))')} AS challenger, {rnd_sql('exp(-abs(gap) / 20.0::DOUBLE)')} AS shrink FROM q"""
)
def challenger_chances(s, d):
    """Recalibrated chances with a term for the seeds, and what a gap of ratings leaves of a correction."""
    q = predictions(s, d)
    return q.select("id", rnd(P.challenger(F.col("p"), F.col("id") % 7 - 3, 0.1, 0.9, 0.05)).alias("challenger"), rnd(P.shrink(F.col("id") % 100 - 50, 20.0)).alias("shrink"))


@query(
    """WITH RECURSIVE w AS (SELECT DISTINCT n_name AS text FROM nation), h AS (SELECT text, 0 AS i, 2166136261::BIGINT AS h FROM w UNION ALL SELECT text, i + 1, (xor(h, ascii(substr(text, i + 1, 1))::BIGINT) * 16777619::HUGEINT % 4294967296)::BIGINT FROM h WHERE i < length(text))
SELECT text, max_by(h, i) AS hash FROM h GROUP BY text"""
)
def name_fingerprints(s, d):
    """32-bit fingerprints of names."""
    return table(s, d, "nation").select(F.col("n_name").alias("text")).distinct().select("text", P.fnv1a(F.col("text")).alias("hash"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN split_part(c_name, '#', 2) || ' ' || split_part(c_name, '#', 1) ELSE c_name END AS name,
CASE c_custkey % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 5.0 WHEN 2 THEN 3.75 END::DOUBLE AS position, CASE c_custkey % 3 WHEN 0 THEN 'Torn ACL of the knee' WHEN 1 THEN 'Sore left foot' ELSE 'Rest' END AS reason FROM customer"""
)
def names_positions_reasons(s, d):
    """Names turned around, positions as numbers, reasons as sentences."""
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    parts = [F.split_part("c_name", F.lit("#"), F.lit(i)) for i in (1, 2)]
    name = F.when(k % 2 == 0, F.concat(parts[0], F.lit(", "), parts[1])).otherwise(F.col("c_name"))
    position = F.when(k % 4 == 0, "G").when(k % 4 == 1, "c").when(k % 4 == 2, "F - PF").otherwise("?")
    reason = F.when(k % 3 == 0, "torn acl; of_the  knee").when(k % 3 == 1, "SORE left foot ").otherwise("rest")
    return c.select(k.alias("id"), first_last(name).alias("name"), P.position_number(position).alias("position"), P.sentence(reason).alias("reason"))


@query(
    with_views(CONTEST, SIDES, BOX)
    + f""", t AS (SELECT team_id, avg(scored - allowed) AS net, count(*) AS n FROM sides WHERE status = 'final' GROUP BY team_id), m AS (SELECT supplier % 25 AS team_id, athlete_id, sum(minutes) AS total FROM box GROUP BY ALL),
a AS (SELECT team_id, athlete_id, total / 50.0::DOUBLE AS minutes FROM m QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY total DESC, athlete_id) <= 10),
v AS (SELECT team_id, sum((athlete_id % 9 - 4) * minutes * (athlete_id % 2)) / 240 AS talent FROM a GROUP BY team_id)
SELECT team_id, {rnd_sql('0.6::DOUBLE * net + 0.3::DOUBLE * (n % 200) / 35.0::DOUBLE + 0.1::DOUBLE * talent', 4)} AS strength FROM t JOIN v USING (team_id)"""
)
def team_strengths(s, d):
    """Strength from net margin, a rating, and the values of those who are available of the ten who play most."""
    t = sides(contests(s, d)).where("status = 'final'").groupBy("team_id").agg(F.avg(F.col("scored") - F.col("allowed")).alias("net"), F.count("*").alias("n"))
    a = box_lines(s, d).groupBy((F.col("supplier") % 25).alias("team_id"), "athlete_id").agg(F.sum("minutes").alias("total"))
    a = a.withColumn("nth", F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("total"), "athlete_id"))).where("nth <= 10").withColumn("minutes", F.col("total") / 50.0)
    v = a.groupBy("team_id").agg(F.collect_list(F.struct((F.col("athlete_id") % 9 - 4).cast("double").alias("impact"), "minutes", (F.col("athlete_id") % 2).alias("available"))).alias("players"))
    return t.join(v, "team_id").select("team_id", rnd(P.team_strength(F.col("net"), 1500 + F.col("n") % 200, F.col("players"), (0.6, 0.3, 0.1)), 4).alias("strength"))


@query(
    with_views(PLAY)
    + """, q AS (SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP) AS day FROM play), n AS (SELECT day, day + INTERVAL 18 HOUR - k * INTERVAL 15 MINUTE AS stamp FROM q, range(0, 4) t(k))
SELECT strftime(day, '%Y-%m-%d') AS day, 'report_' || strftime(stamp, '%Y-%m-%d_%I_%M%p') || '.pdf' AS name FROM n"""
)
def report_names(s, d):
    """Names under which each day's last report before six may lie, quarter by quarter backward."""
    days = table(s, d, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("day")).distinct()
    at = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).withColumn("at", F.expr("day + make_dt_interval(0, 18, -15 * k, 0)"))
    return at.select(F.date_format("day", "yyyy-MM-dd").alias("day"), P.report_name(F.col("at")).alias("name"))


@query(
    with_views(PLAY)
    + """, o AS (SELECT *, lag(k) OVER w AS before, row_number() OVER w AS i FROM play WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS plays, count(*) FILTER (k > before) AS clock_rises, count(*) FILTER (kind = 'purchase') AS made, min(CASE WHEN k > before THEN i END)::BIGINT AS first_rise FROM o GROUP BY user_id"""
)
def play_clock_audit(s, d):
    """Plays in order: how often a clock that may only fall has risen, and first where."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    o = plays(s, d).withColumns({"before": F.lag("k").over(w), "i": F.row_number().over(w)})
    rise = F.col("k") > F.col("before")
    return o.groupBy("user_id").agg(F.count("*").alias("plays"), F.count(F.when(rise, 1)).alias("clock_rises"), F.count(F.when(F.col("kind") == "purchase", 1)).alias("made"), F.min(F.when(rise, F.col("i"))).cast("long").alias("first_rise"))


@query(
    with_views(PLAY)
    + """, h AS (SELECT DISTINCT user_id, k, kind, value FROM play WHERE kind IN ('view', 'click')), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, k, kind ORDER BY value) AS i FROM h)
SELECT a.user_id, a.k, a.i::BIGINT AS pair, floor(a.value * 100)::BIGINT AS leaves, floor(b.value * 100)::BIGINT AS enters FROM n a JOIN n b ON a.user_id = b.user_id AND a.k = b.k AND a.i = b.i AND a.kind = 'view' AND b.kind = 'click'"""
)
def half_substitutions(s, d):
    """Half entries of one moment, repeated ones dropped, paired in order: one leaves, one enters."""
    h = plays(s, d).where("kind IN ('view', 'click')").select("user_id", "k", "kind", "value").distinct()
    n = h.withColumn("i", F.row_number().over(Window.partitionBy("user_id", "k", "kind").orderBy("value")))
    half = lambda kind, name: n.where(F.col("kind") == kind).select("user_id", "k", F.col("i").cast("long").alias("pair"), F.floor(F.col("value") * 100).cast("long").alias(name))
    return half("view", "leaves").join(half("click", "enters"), ["user_id", "k", "pair"])


@query(
    with_views(CONTEST, TEAM)
    + """, c AS (SELECT game_id, lower(replace(h.team, ' ', '-')) AS a, lower(replace(o.team, ' ', '-')) AS b, season FROM contest JOIN team h ON home_id = h.team_id JOIN team o ON away_id = o.team_id)
SELECT game_id, season || '-' || least(a, b) || '-' || greatest(a, b) AS series_id, CASE WHEN a <= b THEN 'first' ELSE 'second' END AS host FROM c"""
)
def series_ids(s, d):
    """The id of the series that a contest belongs to, whoever is at home."""
    t = teams(s, d).select("team_id", F.lower(F.replace("team", F.lit(" "), F.lit("-"))).alias("slug"))
    c = contests(s, d).join(t.select(F.col("team_id").alias("home_id"), F.col("slug").alias("a")), "home_id").join(t.select(F.col("team_id").alias("away_id"), F.col("slug").alias("b")), "away_id")
    return c.select("game_id", F.concat_ws("-", "season", F.least("a", "b"), F.greatest("a", "b")).alias("series_id"), F.when(F.col("a") <= F.col("b"), "first").otherwise("second").alias("host"))


@query("SELECT n_regionkey AS region, count(*) AS teams, (count(*) * (count(*) - 1) * (count(*) - 2) * (count(*) - 3) * (count(*) - 4) // 120)::BIGINT AS fives FROM nation GROUP BY 1")
def lineup_counts(s, d):
    """How many fives each group's members can form."""
    t = table(s, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("teams"))
    return t.select("region", "teams", P.combinations(F.col("teams"), 5).alias("fives"))
