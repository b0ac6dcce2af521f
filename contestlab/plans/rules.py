"""Queries that hold whole records to their rules, and that look at what was known before a day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestlab.functions.scoring import rnd, rnd_sql
from contestlab.operators import rules as R
from contestlab.plans.registry import registry
from contestlab.sources.views import BOX, CONTEST, SIDES, TEAM, box_lines, contests, sides, table, teams, with_views

QUERIES, ORACLES, query = registry()

CLAUSES = {
    "second of its team": "again > 1", "unknown series": "s.series_id IS NULL", "other season": "o.season <> s.season", "team not of the series": "o.team_id NOT IN (s.team_a, s.team_b)",
    "not before the start": "NOT coalesce(o.observed_at < s.starts, false)", "source not secure": "NOT starts_with(source, 'https://')", "too few players": "n < 6",
    "minutes don't add up": "abs(total - 240) > 1e-6", "player not on the roster": "strangers", "player named twice": "names < n", "minutes out of bounds": "odd_minutes", "games out of bounds": "odd_games",
}
OBSERVED = """
obs AS (SELECT o_orderkey AS obs_id, c_nationkey AS home, a.s_nationkey AS away, z.s_nationkey AS team_id, year(o_orderdate)::BIGINT AS season, o_orderdate::DATE AS observed_at,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'http' ELSE 'https' END || '://' || lower(o_orderpriority) AS source, (year(o_orderdate) + (month(o_orderdate) > 6)::INT)::BIGINT AS meant
  FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS f, arg_max(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  JOIN supplier a ON a.s_suppkey = f JOIN supplier z ON z.s_suppkey = l)"""


def observed(s, d):
    """Orders as observed rotations: of the last line's supplier's nation, for a series of the customer's and the first
    line's supplier's nation, in the second half of a year for the next year's; the lines are the players."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    line = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(order)["l_suppkey"].alias("f"), F.max(order)["l_suppkey"].alias("l"))
    nation = lambda key, name: table(s, d, "supplier").select(F.col("s_suppkey").alias(key), F.col("s_nationkey").alias(name))
    o = table(s, d, "orders").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home")), "o_custkey")
    o = o.join(line, "o_orderkey").join(nation("f", "away"), "f").join(nation("l", "team_id"), "l")
    meant = F.year("o_orderdate") + (F.month("o_orderdate") > 6).cast("int")
    source = F.concat(F.when(F.col("o_orderpriority") == "5-LOW", "http").otherwise("https"), F.lit("://"), F.lower("o_orderpriority"))
    return o.select(
        F.col("o_orderkey").alias("obs_id"), F.col("o_orderkey").alias("ord"), F.concat_ws("-", meant, F.least("home", "away"), F.greatest("home", "away")).alias("series_id"), "team_id",
        F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("observed_at"), source.alias("source"),
    )


@query(
    with_views(CONTEST, OBSERVED)
    + """, series AS (SELECT season || '-' || least(home_id, away_id) || '-' || greatest(home_id, away_id) AS series_id, season, least(home_id, away_id) AS team_a, greatest(home_id, away_id) AS team_b, min(game_date) AS starts FROM contest GROUP BY ALL),
roster AS (SELECT DISTINCT year(l_shipdate) AS season, s_nationkey AS team_id, lower(p_name) AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
listed AS (SELECT l_orderkey AS obs_id, lower(p_name) AS name, l_quantity AS minutes, round(l_discount * 100) * 1.5 AS games FROM lineitem JOIN part ON p_partkey = l_partkey),
squad AS (SELECT obs_id, count(*) AS n, sum(minutes) AS total, count(DISTINCT l.name) AS names, bool_or(r.name IS NULL) AS strangers, bool_or(minutes NOT BETWEEN 0 AND 48) AS odd_minutes, bool_or(games NOT BETWEEN 0 AND 10 OR games <> floor(games)) AS odd_games
  FROM listed l JOIN obs USING (obs_id) LEFT JOIN roster r ON r.season = obs.season AND r.team_id = obs.team_id AND r.name = l.name GROUP BY obs_id),
o AS (SELECT *, row_number() OVER (PARTITION BY meant, least(home, away), greatest(home, away), team_id ORDER BY obs_id) AS again, meant || '-' || least(home, away) || '-' || greatest(home, away) AS series_id FROM obs),
c AS (SELECT """
    + ", ".join(f"coalesce({c}, false)::INT AS c{i}" for i, c in enumerate(CLAUSES.values()))
    + " FROM o LEFT JOIN squad USING (obs_id) LEFT JOIN series s ON s.series_id = o.series_id), t AS (SELECT *, "
    + " + ".join(f"c{i}" for i in range(len(CLAUSES)))
    + " AS hits FROM c), u AS ("
    + " UNION ALL ".join(
        f"""SELECT {i} AS place, '{n.replace("'", "''")}' AS clause, sum(c{i})::BIGINT AS rejected, sum((c{i} = 1 AND hits = 1)::INT)::BIGINT AS alone, sum((hits > 0)::INT)::BIGINT AS "any", count(*) AS candidates FROM t"""
        for i, n in enumerate(CLAUSES)
    )
    + ") SELECT *, rejected > 0 AND row_number() OVER (ORDER BY rejected DESC, place) = 1 AS largest FROM u"
)
def rotation_rejections(s, d):
    """What each of the twelve clauses rejects of all observed rotations, and which eliminates the most."""
    c = contests(s, d)
    low, high = F.least("home_id", "away_id"), F.greatest("home_id", "away_id")
    series = c.groupBy("season", low.alias("team_a"), high.alias("team_b")).agg(F.min("game_date").alias("starts")).withColumn("series_id", F.concat_ws("-", "season", "team_a", "team_b"))
    part = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    line = table(s, d, "lineitem").join(part, "l_partkey")
    players = line.select(F.col("l_orderkey").alias("obs_id"), "name", F.col("l_quantity").alias("minutes"), (F.round(F.col("l_discount") * 100) * 1.5).alias("games"))
    supplier = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("team_id"))
    rosters = line.join(supplier, "l_suppkey").select(F.year("l_shipdate").alias("season"), "team_id", "name")
    return R.rotation_rejections(observed(s, d), players, series, rosters)


ENTRIES = {"1-URGENT": "final", "2-HIGH": "reissued", "3-MEDIUM": "morning", "4-NOT SPECIFIED": "missed", "5-LOW": "result"}
KEEP = "365 DAYS"  # the tables know days only, so a final seal's hour is a year here
SEALED = f"""
driven AS (SELECT l_orderkey, list(struct_pack(points := l_quantity, status := nullif(l_returnflag, 'N'), side := l_linestatus, on_day := l_shipdate) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l FROM lineitem GROUP BY 1),
sealed AS (SELECT o_orderkey AS ord, o_custkey AS game, o_orderstatus AS version, CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ENTRIES.items())} END AS entry, o_orderdate AS issued, l[1].on_day AS starts,
    CASE WHEN l[-1].status IS NOT NULL THEN l[-1].on_day END AS report_at, l[1].status IS NULL AS no_report, o_totalprice / 400000 AS p,
    list_sum(list_transform(list_filter(l, lambda x: x.side = 'O'), lambda x: x.points)) / list_sum(list_transform(l, lambda x: x.points)) AS reference,
    o_orderstatus = 'P' AS incomplete, len(list_filter(l, lambda x: x.on_day > o_orderdate)) AS n_waiting,
    {', '.join(f"list_filter(l, lambda x: x.side = '{c}') AS {n}_drivers, coalesce(list_sum(list_transform(list_filter(l, lambda x: x.side = '{c}' AND x.status IS NOT NULL), lambda x: x.points)), 0) AS {n}_points" for n, c in (('home', 'O'), ('away', 'F')))}
  FROM orders JOIN driven ON l_orderkey = o_orderkey),
seal AS (SELECT *, {', '.join(f"len({n}_drivers) > 0 AND len(list_filter({n}_drivers, lambda x: x.status IS NOT NULL)) = 0 AS {n}_unfiled" for n in ('home', 'away'))} FROM sealed)"""


def sealed(s, d):
    """Orders as entries of a ledger: a customer's orders are one game's, the priority is the kind and the status the
    version; the lines are the absent players of either side, those of flag N without status and left out of the sum."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.nullif("l_returnflag", F.lit("N")).alias("status"), "l_linestatus", "l_shipdate")
    l = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("l"))  # noqa: E741
    first, final = F.element_at("l", 1), F.element_at("l", -1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda n, x: n + x["l_quantity"])
    side = lambda c: F.filter("l", lambda x: x["l_linestatus"] == c)
    home = total(side("O"))
    made = {"home_drivers": side("O"), "away_drivers": side("F")}
    points = {f"{n}_points": total(F.filter(side(c), lambda x: x["status"].isNotNull())) for n, c in (("home", "O"), ("away", "F"))}
    unfiled = {f"{n}_unfiled": (F.size(side(c)) > 0) & ~F.exists(side(c), lambda x: x["status"].isNotNull()) for n, c in (("home", "O"), ("away", "F"))}
    entry = F.create_map(*[F.lit(x) for pair in ENTRIES.items() for x in pair])[F.col("o_orderpriority")]
    return table(s, d, "orders").join(l, "o_orderkey").select(
        F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("game"), F.col("o_orderstatus").alias("version"), entry.alias("entry"), F.col("o_orderdate").alias("issued"), first["l_shipdate"].alias("starts"),
        F.when(final["status"].isNotNull(), final["l_shipdate"]).alias("report_at"), first["status"].isNull().alias("no_report"), (F.col("o_totalprice") / 400000).alias("p"),
        F.when(F.size(side("O")) > 0, home / total(F.col("l"))).alias("reference"), (F.col("o_orderstatus") == "P").alias("incomplete"), F.size(F.filter("l", lambda x: x["l_shipdate"] > F.col("o_orderdate"))).alias("n_waiting"),
        *[F.transform(v, lambda x: F.struct(x["l_quantity"].alias("points"), x["status"].alias("status"))).alias(n) for n, v in made.items()], *[v.alias(n) for n, v in (points | unfiled).items()],
    )


SEAL_RULES = {
    "invalid time": "issued IS NULL OR (entry <> 'result' AND starts IS NULL)", "result of an unknown game": "entry = 'result' AND NOT named", "second miss": "entry = 'missed' AND again", "missed though sealed": "entry = 'missed' AND was_sealed",
    "second seal of its kind": "is_seal AND again", "sealed after a miss": "is_seal AND was_missed", "issued at or after the start": "is_seal AND issued >= starts", "report after the issue": "is_seal AND report_at > issued",
    "chance out of bounds": "is_seal AND p NOT BETWEEN 0 AND 1", "incomplete without a game": "is_seal AND incomplete AND n_waiting = 0", "final too early": "entry = 'final' AND NOT late", "reissued too late": "entry = 'reissued' AND late",
    "reissued without need": "entry = 'reissued' AND NOT lacked", "reissued after the final": "entry = 'reissued' AND was_final", "reissued without a report": "entry = 'reissued' AND (no_report OR report_at IS NULL)",
    "no reference": "is_seal AND NOT coalesce(reference BETWEEN 0 AND 1, false)", "negative absence": "is_seal AND (home_points < 0 OR away_points < 0)",
    "report though missing": "is_seal AND no_report AND (home_points <> 0 OR away_points <> 0 OR report_at IS NOT NULL)", "unfiled without a report": "is_seal AND (home_unfiled OR away_unfiled) AND (no_report OR report_at IS NULL)",
} | {f"{n} {rule}": sql.replace("SIDE", n) for n in ("home", "away") for rule, sql in {
    "drivers don't add up": "is_seal AND abs(coalesce(list_sum(list_transform(SIDE_drivers, lambda x: x.points)), 0) - SIDE_points) > 0.01",
    "drivers out of order": "is_seal AND list_transform(SIDE_drivers, lambda x: x.points) <> list_reverse_sort(list_transform(SIDE_drivers, lambda x: x.points))",
    "driver without status": "is_seal AND NOT SIDE_unfiled AND len(list_filter(SIDE_drivers, lambda x: x.status IS NULL)) > 0",
}.items()}


@query(
    with_views(SEALED)
    + f""", x AS (SELECT *, entry IN ('morning', 'reissued', 'final') AS is_seal, starts <= issued + INTERVAL {KEEP} AS late, row_number() OVER (PARTITION BY game, version, entry ORDER BY ord) > 1 AS again,
coalesce(bool_or(entry <> 'result') OVER g, false) AS named, coalesce(bool_or(entry = 'missed') OVER v, false) AS was_missed, coalesce(bool_or(entry IN ('morning', 'reissued', 'final')) OVER v, false) AS was_sealed,
coalesce(bool_or(entry = 'final') OVER v, false) AS was_final, coalesce(bool_or(entry = 'morning' AND no_report) OVER v, false) AS lacked FROM seal
WINDOW g AS (PARTITION BY game ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY game, version ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT game, version, ord, unnest(list_filter([{', '.join("CASE WHEN " + sql + " THEN '" + name.replace("'", "''") + "' END" for name, sql in SEAL_RULES.items())}], lambda z: z IS NOT NULL)) AS rule FROM x)
SELECT rule, count(*) AS entries, count(DISTINCT game) AS games, min(ord) AS first_ord FROM r GROUP BY rule"""
)
def sealed_ledger_rules(s, d):
    """Entries and games that break each rule of a sealed ledger, and the first such entry."""
    broken = R.seal_rules(sealed(s, d), F.expr(f"INTERVAL {KEEP}"))
    return broken.groupBy("rule").agg(F.count("*").alias("entries"), F.count_distinct("game").alias("games"), F.min("ord").alias("first_ord"))


@query(
    with_views(CONTEST)
    + f""", told AS (SELECT year(l_shipdate) AS season, l_shipdate::DATE AS day, s_nationkey AS team_id, arg_max(l_discount, (l_orderkey, l_linenumber, l_partkey, l_discount)) AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
x AS (SELECT game_id, a.day, a.q / (a.q + b.q) AS p FROM contest JOIN told a ON a.season = contest.season AND a.team_id = home_id AND a.day < game_date AND a.q > 0 JOIN told b ON b.season = contest.season AND b.team_id = away_id AND b.day = a.day AND b.q > 0),
l AS (SELECT game_id, max(day) AS told, arg_max(p, day) AS p FROM x GROUP BY game_id)
SELECT game_id, told::VARCHAR AS told, {rnd_sql('p')} AS p FROM contest LEFT JOIN l USING (game_id)"""
)
def outside_forecast_before(s, d):
    """The last outside forecast strictly before each contest that gives both sides a chance; a team's last one of a day counts."""
    nation = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("team_id"))
    day = F.to_date("l_shipdate")
    told = table(s, d, "lineitem").join(nation, "l_suppkey").groupBy(F.year("l_shipdate").alias("season"), day.alias("day"), "team_id").agg(F.max(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_discount"))["l_discount"].alias("q"))
    asked = contests(s, d).select(F.col("game_id").alias("contest_id"), "season", F.col("game_date").alias("day"), "home_id", "away_id")
    return R.last_qualifying(asked, told).select(F.col("contest_id").alias("game_id"), F.col("told").cast("string").alias("told"), rnd(F.col("p")).alias("p"))


@query(
    with_views(BOX, CONTEST)
    + f""", d AS (SELECT athlete_id, season, game_date AS day, sum(minutes) AS d, sum(points) AS r FROM box JOIN contest USING (game_id) GROUP BY ALL), t AS (SELECT athlete_id, season, sum(d) AS d, sum(r) AS r FROM d GROUP BY ALL),
c AS (SELECT athlete_id, season, day, coalesce(sum(d) OVER b, 0) AS d, coalesce(sum(r) OVER b, 0) AS r FROM d WINDOW b AS (PARTITION BY athlete_id, season ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT n.athlete_id, n.season, sum(t.d * power(0.5::DOUBLE, n.season - t.season)) AS d, sum(t.r * power(0.5::DOUBLE, n.season - t.season)) AS r FROM t n JOIN t ON t.athlete_id = n.athlete_id AND t.season < n.season GROUP BY ALL),
z AS (SELECT athlete_id, season, day, c.d + coalesce(p.d, 0) AS played, c.r + coalesce(p.r, 0) AS rated FROM c LEFT JOIN p USING (athlete_id, season))
SELECT athlete_id, season, day::VARCHAR AS day, {rnd_sql('played::DOUBLE')} AS played, CASE WHEN played > 0 THEN {rnd_sql('(rated + 100 * 1.5::DOUBLE) / (played + 100)')} END AS value FROM z"""
)
def value_before_each_day(s, d):
    """Every athlete's points a minute as known before each day of theirs: seasons decayed by half, shrunk to a prior."""
    day = contests(s, d).select("game_id", "season", F.col("game_date").alias("day"))
    rows = box_lines(s, d).join(day, "game_id").select("athlete_id", "season", "day", F.col("minutes").alias("played"), F.col("points").alias("rated"))
    got = R.values_before(rows, 0.5, 100.0, 1.5)
    return got.select("athlete_id", "season", F.col("day").cast("string").alias("day"), rnd(F.col("played")).alias("played"), rnd(F.col("value")).alias("value"))


BRACKET = """
numbered AS (SELECT *, least(home_id, away_id) AS a, greatest(home_id, away_id) AS b, row_number() OVER (PARTITION BY season, least(home_id, away_id), greatest(home_id, away_id) ORDER BY game_date, game_id) AS n FROM contest),
pair AS (SELECT season, a, b, count(*) AS total, CASE WHEN bool_or(neutral AND n <= 7) THEN 3 ELSE 4 END AS need, count(*) FILTER (n <= 7 AND status = 'final') AS games,
    count(*) FILTER (n <= 7 AND status = 'final' AND CASE WHEN home_id = a THEN home_score > away_score ELSE away_score > home_score END) AS wins_a,
    count(*) FILTER (n <= 7 AND status = 'final' AND CASE WHEN home_id = a THEN home_score < away_score ELSE away_score < home_score END) AS wins_b,
    list(home_id ORDER BY n) FILTER (n <= 7) AS pattern FROM numbered GROUP BY ALL),
bracket AS (SELECT pair.*, season || '-' || a || '-' || b AS series_id, total % 5 AS bracket_order, x.conference AS ca, y.conference AS cb, CASE WHEN x.conference = y.conference THEN x.conference ELSE 'Finals' END AS conference,
    CASE WHEN x.conference <> y.conference THEN 'Finals' ELSE CASE row_number() OVER (PARTITION BY season, x.conference, x.conference = y.conference ORDER BY total DESC, a, b) WHEN 5 THEN 'Conference Semifinal' WHEN 6 THEN 'Conference Semifinal' WHEN 7 THEN 'Conference Final' ELSE 'First Round' END END AS round
  FROM pair JOIN team x ON x.team_id = a JOIN team y ON y.team_id = b)"""


def bracket(s, d):
    """Pairs of teams as a season's series of at most seven contests: pairs of one conference are its rounds, the fifth
    and sixth most frequent the semifinals, the seventh the final; pairs of two conferences are finals."""
    c = contests(s, d).withColumns({"team_a": F.least("home_id", "away_id"), "team_b": F.greatest("home_id", "away_id")})
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("season", "team_a", "team_b").orderBy("game_date", "game_id")))
    held, done = F.col("n") <= 7, F.col("status") == "final"
    lead = F.when(F.col("home_id") == F.col("team_a"), 1).otherwise(-1) * (F.col("home_score") - F.col("away_score"))
    pair = c.groupBy("season", "team_a", "team_b").agg(
        F.count("*").alias("total"), F.when(F.max(F.col("neutral") & held), 3).otherwise(4).alias("wins_required"), F.count(F.when(held & done, 1)).alias("games"),
        F.count(F.when(held & done & (lead > 0), 1)).alias("wins_a"), F.count(F.when(held & done & (lead < 0), 1)).alias("wins_b"), F.sort_array(F.collect_list(F.when(held, F.struct("n", "home_id"))))["home_id"].alias("home_pattern"),
    )
    of = lambda side: teams(s, d).select(F.col("team_id").alias(f"team_{side}"), F.col("conference").alias(f"c{side}"))
    both = pair.join(F.broadcast(of("a")), "team_a").join(F.broadcast(of("b")), "team_b").withColumn("inner", F.col("ca") == F.col("cb"))
    place = F.row_number().over(Window.partitionBy("season", "ca", "inner").orderBy(F.desc("total"), "team_a", "team_b"))
    rounds = F.when(~F.col("inner"), "Finals").when(place.isin(5, 6), "Conference Semifinal").when(place == 7, "Conference Final").otherwise("First Round")
    return both.select(
        "season", F.col("season").alias("bracket"), F.concat_ws("-", "season", "team_a", "team_b").alias("series_id"), F.when(F.col("inner"), F.col("ca")).otherwise("Finals").alias("conference"), rounds.alias("round"),
        (F.col("total") % 5).alias("bracket_order"), "team_a", "team_b", "wins_required", "wins_a", "wins_b", "games", "home_pattern", F.try_divide(F.col("wins_a"), F.col("wins_a") + F.col("wins_b")).alias("p"),
    )


SERIES_RULES = {
    ("error", "must need three or four wins"): "need NOT IN (3, 4)", ("error", "finals outside their conference"): "round = 'Finals' AND conference <> 'Finals'", ("error", "finals' conference in another round"): "round <> 'Finals' AND conference = 'Finals'",
    ("error", "bracket order not positive"): "bracket_order <= 0", ("error", "home pattern names another team"): "len(list_filter(pattern, lambda x: x <> a AND x <> b)) > 0", ("error", "negative score"): "wins_a < 0 OR wins_b < 0",
    ("error", "score above the wins needed"): "wins_a > need OR wins_b > need", ("error", "both have the wins needed"): "wins_a = need AND wins_b = need", ("error", "more games than possible"): "wins_a + wins_b > need * 2 - 1",
    ("error", "finals in one conference"): "round = 'Finals' AND ca = cb", ("error", "chance out of bounds"): "wins_a + wins_b = 0", ("warning", "home pattern of another length"): "len(pattern) <> need * 2 - 1",
}


def _listed(rules: dict) -> str:
    """SQL of the broken rules of a row, as structs of level and rule."""
    cases = [f"CASE WHEN {sql} THEN struct_pack(level := '{level}', rule := '{rule.replace(chr(39), chr(39) * 2)}') END" for (level, rule), sql in rules.items()]
    return f"unnest(list_filter([{', '.join(cases)}], lambda z: z IS NOT NULL))"


@query(with_views(CONTEST, TEAM, BRACKET) + f", x AS (SELECT series_id, {_listed(SERIES_RULES)} AS r FROM bracket) SELECT series_id, r.level AS level, r.rule AS rule FROM x")
def series_rule_violations(s, d):
    """Errors and warnings of every series of every season's bracket."""
    return R.series_rules(bracket(s, d), teams(s, d)).select("series_id", "level", "rule")


COVERAGE = """
expected AS (SELECT unnest(['First Round', 'Conference Semifinal', 'Conference Final']) AS round, unnest([4, 2, 1]) AS expected),
coverage AS (SELECT f.season AS bracket, f.conference, f.round, expected, count(b.series_id) AS configured, count(b.series_id) > count(DISTINCT b.bracket_order) AS repeated, count(b.series_id) = expected OR (count(b.series_id) = 0 AND f.round <> 'First Round') AS complete
  FROM (SELECT DISTINCT season, team.conference, expected.round, expected FROM bracket, team, expected) f LEFT JOIN bracket b ON b.season = f.season AND b.conference = f.conference AND b.round = f.round GROUP BY f.season, f.conference, f.round, expected)"""


@query(with_views(CONTEST, TEAM, BRACKET, COVERAGE) + "SELECT * FROM coverage")
def bracket_round_coverage(s, d):
    """How many series each round of each conference holds, of those that it should."""
    return R.bracket_coverage(bracket(s, d), teams(s, d))


@query(
    with_views(CONTEST, TEAM, BRACKET, COVERAGE)
    + """SELECT bracket, conference, round, 'error' AS level, 'bracket orders repeated' AS rule FROM coverage WHERE repeated UNION ALL SELECT bracket, conference, round, 'warning', 'round not whole' FROM coverage WHERE NOT complete
UNION ALL SELECT season, 'Finals', 'Finals', 'error', 'more than one finals series' FROM bracket WHERE round = 'Finals' GROUP BY season HAVING count(*) > 1"""
)
def bracket_rule_violations(s, d):
    """What is wrong with each season's bracket as a whole."""
    return R.bracket_rules(bracket(s, d), teams(s, d))


SETTINGS_RULES = {
    ("error", "weights far from one"): "w NOT BETWEEN 0.5 AND 1.5", ("error", "iterations not a positive whole number"): "n <= 0", ("error", "scale not positive"): "scale <= 0",
    ("warning", "weights don't add up to one"): "abs(w - 1) > 0.15", ("warning", "home advantage out of range"): "home NOT BETWEEN 0 AND 5",
}


@query(
    f"""WITH s AS (SELECT p_partkey AS settings_id, p_size / 50 + 0.25::DOUBLE + 0.25::DOUBLE AS w, p_retailprice / 250 AS home, p_size * 200 - 200 AS n, p_size - 2 AS scale FROM part), x AS (SELECT {_listed(SETTINGS_RULES)} AS r FROM s)
SELECT r.level AS level, r.rule AS rule, count(*) AS settings FROM x GROUP BY ALL"""
)
def settings_rule_violations(s, d):
    """Parts as candidate settings, by size and price: how many break each rule."""
    p = table(s, d, "part")
    size = F.col("p_size")
    settings = p.select(
        F.col("p_partkey").alias("settings_id"), (size / 50).alias("player_weight"), F.lit(0.25).alias("rating_weight"), F.lit(0.25).alias("elo_weight"), (F.col("p_retailprice") / 250).alias("home_advantage"),
        (size * 200 - 200).alias("iterations"), (size - 2).alias("scale"),
    )
    return R.settings_rules(settings).groupBy("level", "rule").agg(F.count("*").alias("settings"))


ANOMALIES = {
    ("", "games out of bounds"): "games NOT BETWEEN need AND need * 2 - 1", ("", "winner without the wins needed"): "coalesce(CASE WHEN wins_a > wins_b THEN wins_a WHEN wins_b > wins_a THEN wins_b END <> need, true)",
    ("", "wins don't add up to games"): "wins_a + wins_b <> games", ("", "home pattern of another length"): "len(pattern) <> games", ("", "bubble flag"): "(need = 3) <> (season = 1996)",
}


@query(with_views(CONTEST, TEAM, BRACKET) + f", x AS (SELECT season, series_id, {_listed(ANOMALIES)} AS r FROM bracket) SELECT season, series_id, r.rule AS rule FROM x")
def series_anomaly_list(s, d):
    """What is odd about each series as a finished one; 1996 is the season of neutral ground, where three wins are needed."""
    winner = F.when(F.col("wins_a") > F.col("wins_b"), F.col("team_a")).when(F.col("wins_b") > F.col("wins_a"), F.col("team_b"))
    rows = bracket(s, d).withColumns({"winner": winner, "bubble": F.col("wins_required") == 3, "bubble_season": F.col("season") == 1996})
    return R.series_anomalies(rows)


@query(
    with_views(CONTEST)
    + """, r AS (SELECT game_id, row_number() OVER o AS number, coalesce(count(*) FILTER (status = 'final') OVER b, 0) AS included, coalesce(count(*) FILTER (status = 'final' AND home_score <> away_score) OVER b, 0) AS wins, lag(game_date) OVER o AS shot, game_date FROM contest
WINDOW o AS (PARTITION BY season, least(home_id, away_id), greatest(home_id, away_id) ORDER BY game_date, game_id), b AS (PARTITION BY season, least(home_id, away_id), greatest(home_id, away_id) ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT game_id, unnest(list_filter([CASE WHEN included <> number - 1 THEN 'other results included' END, CASE WHEN wins <> included THEN 'score differs from the results included' END, CASE WHEN shot >= game_date THEN 'snapshot not before the forecast' END], lambda z: z IS NOT NULL)) AS rule FROM r"""
)
def archive_leakage_list(s, d):
    """Each contest as a forecast of its day that includes its pair's finished contests and was taken at the one before."""
    c = contests(s, d).withColumns({"a": F.least("home_id", "away_id"), "b": F.greatest("home_id", "away_id")})
    order = Window.partitionBy("season", "a", "b").orderBy("game_date", "game_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("status") == "final"
    lead = F.when(F.col("home_id") == F.col("a"), 1).otherwise(-1) * (F.col("home_score") - F.col("away_score"))
    count = lambda what: F.count(F.when(what, 1)).over(before)
    records = c.select(
        F.col("game_id").alias("id"), F.row_number().over(order).alias("number"), count(done).alias("included"), count(done & (lead > 0)).alias("wins_a"), count(done & (lead < 0)).alias("wins_b"),
        F.lag("game_date").over(order).alias("snapshot_as_of"), F.col("game_date").alias("forecast_as_of"),
    )
    return R.archive_leakage(records).withColumnRenamed("id", "game_id")


@query(
    with_views(BOX)
    + """, x AS (SELECT athlete_id, floor(100 * sum(CASE side WHEN 'home' THEN points ELSE -points END)::DOUBLE / sum(minutes) / 4 * 1000 + 0.5) / 1000 AS score, floor(100 * sum(CASE WHEN starter THEN CASE side WHEN 'home' THEN points ELSE -points END END)::DOUBLE / sum(minutes) / 4 * 1000 + 0.5) / 1000 AS box,
floor(100 * sum(CASE WHEN line_no IN (3, 4) THEN CASE side WHEN 'home' THEN points ELSE -points END END)::DOUBLE / sum(minutes) / 4 * 1000 + 0.5) / 1000 AS on_court, sum(minutes) FILTER (starter)::DOUBLE / sum(minutes) AS share FROM box GROUP BY athlete_id)
SELECT athlete_id, unnest(list_filter([CASE WHEN NOT coalesce(score BETWEEN -25 AND 25, false) THEN 'score out of bounds' END, CASE WHEN NOT coalesce(box BETWEEN -25 AND 25, false) THEN 'box value out of bounds' END, CASE WHEN NOT coalesce(on_court BETWEEN -10 AND 10, false) THEN 'on-court value out of bounds' END,
CASE WHEN NOT coalesce(abs(score - (box + on_court)) <= 0.0011, false) THEN 'not the sum of its parts' END, CASE WHEN NOT coalesce(share BETWEEN 0 AND 1, false) THEN 'share out of bounds' END], lambda z: z IS NOT NULL)) AS rule FROM x"""
)
def published_score_rules(s, d):
    """Signed points a minute of every athlete, in two parts to three decimals: what a published score may not be."""
    signed = F.when(F.col("side") == "home", F.col("points")).otherwise(-F.col("points"))
    per = lambda what: F.floor(100 * F.sum(what).cast("double") / F.sum("minutes") / 4 * 1000 + 0.5) / 1000
    scores = box_lines(s, d).groupBy("athlete_id").agg(
        per(signed).alias("score"), per(F.when(F.col("starter"), signed)).alias("box"), per(F.when(F.col("line_no").isin(3, 4), signed)).alias("on_court"),
        (F.sum(F.when(F.col("starter"), F.col("minutes"))).cast("double") / F.sum("minutes")).alias("share"),
    )
    return R.score_rules(scores)


PROJECTION_RULES = {
    "chance not between 0 and 1": "NOT (p > 0 AND p < 1)", "drivers not complete": "neutral", "unfiled without a report": "status <> 'in-progress' AND ((hn = 0 AND hl > 0) OR (an = 0 AND al > 0))", "not due": "status <> 'scheduled'",
    "rest differs from the schedule": "ht <> hs OR at_ <> as_", "not from the ratings and absences": "abs(1 / (1 + exp(-(gap - hp + ap) / 10.0::DOUBLE)) - p) > 1e-6",
    "home drivers don't add up": "abs(hn - hp) > 0.01", "away drivers don't add up": "abs(an - ap) > 0.01",
}


@query(
    with_views(CONTEST, SIDES)
    + """, strength AS (SELECT season, team_id, avg(scored - allowed) AS net FROM sides WHERE status = 'final' GROUP BY ALL), busy AS (SELECT DISTINCT team_id, game_date + 1 AS day FROM sides), pending AS (SELECT DISTINCT team_id, game_date + 1 AS day FROM sides WHERE status = 'scheduled'),
named AS (SELECT l_orderkey AS game_id, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O' AND l_returnflag <> 'N'), 0) / 100 AS hn, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F' AND l_returnflag <> 'N'), 0) / 100 AS an, count(*) FILTER (l_linestatus = 'O') AS hl, count(*) FILTER (l_linestatus = 'F') AS al FROM lineitem GROUP BY 1),
g AS (SELECT c.*, coalesce(h.net, 0) - coalesce(a.net, 0) AS gap, home_score / 100 AS hp, away_score / 100 AS ap, bh.day IS NOT NULL AS ht, ba.day IS NOT NULL AS at_, ph.day IS NOT NULL AS hs, pa.day IS NOT NULL AS as_, hn, an, hl, al FROM contest c JOIN named USING (game_id)
  LEFT JOIN strength h ON h.season = c.season AND h.team_id = home_id LEFT JOIN strength a ON a.season = c.season AND a.team_id = away_id LEFT JOIN busy bh ON bh.team_id = home_id AND bh.day = game_date LEFT JOIN busy ba ON ba.team_id = away_id AND ba.day = game_date
  LEFT JOIN pending ph ON ph.team_id = home_id AND ph.day = game_date LEFT JOIN pending pa ON pa.team_id = away_id AND pa.day = game_date),
x AS (SELECT *, 1 / (1 + exp(-(gap - hn + an) / 10.0::DOUBLE)) AS p FROM g WHERE status = 'in-progress' OR (status = 'scheduled' AND NOT (hl = 0 AND neutral)))
SELECT game_id, unnest(list_filter(["""
    + ", ".join("CASE WHEN " + sql + " THEN '" + rule.replace("'", "''") + "' END" for rule, sql in PROJECTION_RULES.items())
    + "], lambda z: z IS NOT NULL)) AS rule FROM x UNION ALL SELECT game_id, 'no projection' FROM g WHERE status = 'scheduled' AND hl = 0 AND neutral"
)
def projection_rule_violations(s, d):
    """Open contests as projections: the lines' quantities are the absences, those of flag N not named as drivers; rest is
    taken from scheduled contests alone, and neutral contests without a home line have no projection."""
    c = contests(s, d)
    both = sides(c)
    net = both.where("status = 'final'").groupBy("season", "team_id").agg(F.avg(F.col("scored") - F.col("allowed")).alias("net"))
    after = lambda rows, flag: rows.select("team_id", F.date_add("game_date", 1).alias("game_date")).distinct().withColumn(flag, F.lit(True))
    busy, pending = after(both, "busy"), after(both.where("status = 'scheduled'"), "pending")
    told = both.join(net, ["season", "team_id"], "left").join(busy, ["team_id", "game_date"], "left").join(pending, ["team_id", "game_date"], "left").na.fill({"net": 0.0, "busy": False, "pending": False})
    side = lambda home, n: told.where(F.col("is_home") == home).select("game_id", F.col("net").alias(f"{n}_net"), F.col("busy").alias(f"{n}_tired"), F.col("pending").alias(f"{n}_guess"))
    games = c.select("game_id", "status", "neutral", (F.col("home_score") / 100).alias("home_points"), (F.col("away_score") / 100).alias("away_points")).join(side(True, "home"), "game_id").join(side(False, "away"), "game_id")
    games = games.withColumns({"gap": F.col("home_net") - F.col("away_net"), "due": F.col("status") == "scheduled"})
    of = lambda code: F.when(F.col("l_linestatus") == code, F.col("l_quantity"))
    named = lambda code: (F.coalesce(F.sum(F.when(F.col("l_returnflag") != "N", of(code))), F.lit(0)) / 100)
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(*[x for n, code in (("home", "O"), ("away", "F")) for x in (named(code).alias(f"{n}_named"), F.min(of(code)).alias(f"{n}_least"), F.count(of(code)).alias(f"{n}_lines"))])
    rows = games.join(lines, "game_id").where("status = 'in-progress' OR (status = 'scheduled' AND NOT (home_lines = 0 AND neutral))")
    p = 1.0 / (1.0 + F.exp(-(F.col("gap") - F.col("home_named") + F.col("away_named")) / 10.0))
    made = [x for n in ("home", "away") for x in (F.col(f"{n}_points"), F.col(f"{n}_named"), F.col(f"{n}_least"), ((F.col(f"{n}_named") == 0) & (F.col(f"{n}_lines") > 0)).alias(f"{n}_unfiled"), F.col(f"{n}_guess").alias(f"{n}_tired"))]
    projections = rows.select("game_id", p.alias("p_home"), (1.0 - p).alias("p_away"), (~F.col("neutral")).alias("complete"), F.when(F.col("due"), "current").otherwise("report").alias("basis"), *made)
    return R.projection_rules(projections, games.select("game_id", "due", "gap", "home_tired", "away_tired"), 10.0)
