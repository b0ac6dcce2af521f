"""Queries over printed reports, drawn from the web pages' link lists first, over the instants of seals and the record of forecasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestlab.functions.scoring import rnd, rnd_sql
from contestlab.operators import records as L
from contestlab.operators import sealing as Z
from contestlab.plans.registry import registry
from contestlab.session import shared_dir
from contestlab.sources import html_tables as H
from contestlab.sources import positioned as P
from contestlab.sources import published as B
from contestlab.sources.views import FEED, LEDGER, PLAY, ledger, status_feed, table, with_views

QUERIES, ORACLES, query = registry()

LISTED = """WITH listed AS (
  SELECT page_id AS report, names, len(names) AS n
  FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '<a href="/([^"]*)">', 1), lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: w <> '') AS names FROM pages)
  WHERE len(names) > 0),
line AS (SELECT report, n, names[i + 1] AS name, names[n - i] AS other, i FROM listed, unnest(range(0, n)) AS u(i))"""


def listed_names(s, d):
    """(report, i, n, name, other): each page's link words, letters only, in order; other is the one from the end."""
    words = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<a href="/([^"]*)">'), 1), lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    named = table(s, d, "pages").select(F.col("page_id").alias("report"), F.filter(words, lambda w: w != "").alias("names")).withColumn("n", F.size("names"))
    each = named.select("report", "n", "names", F.posexplode("names").alias("i", "name"))
    return each.select("report", "i", "n", "name", F.element_at("names", F.col("n") - F.col("i")).alias("other"))


def printed(s, d):
    """The names as positioned fragments of reports: three rows to a sheet, every other report printed sideways, sheets
    after the first with a header in two of three reports, cells wrapped above and below their row and over a sheet's end."""
    x = listed_names(s, d)
    sheet, row = F.floor(F.col("i") / 3).cast("int"), F.col("i") % 3
    down = F.lit(100.0) + row * 36
    at = lambda along, dy, *parts: F.struct(F.lit(float(along)).alias("along"), (down + dy).alias("down"), F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("text"))
    i, n, lost = F.col("i"), F.col("n"), F.col("i") % 5 == 4
    day = F.format_string("%02d", F.col("report") % 28 + 1)
    status = F.element_at(F.array(*map(F.lit, P.STATUSES)), (i % 5 + 1).cast("int"))
    cells = F.filter(
        F.array(
            F.when(i == 0, at(20, 0, "11/", day, "/2026")),
            F.when(i % 2 == 0, at(90, 0, "07:00")), F.when(i % 2 == 0, at(112, 0.5, "(ET)")),
            F.when(i % 2 == 0, at(150, 0, "AB@C", F.char(F.lit(65) + i))),
            F.when(i % 2 == 0, at(220, 0.8, "Team")), F.when(i % 2 == 0, at(250, 0, F.col("name"))),
            F.when(~lost, at(330, 1.2, F.col("name"), ",")), F.when(~lost, at(370, 0, F.col("other"))),
            F.when(~lost, at(450, 0, status)),
            F.when(lost, at(520, 0, P.NOT_SUBMITTED)),
            F.when(~lost & (i % 3 != 2), at(520, -9, "Injury/Illness - ", F.col("name"), " Two-")),
            F.when(~lost, at(520, 0, F.when(i % 3 == 2, "Rest").otherwise("Way"))), F.when(~lost, at(575, 1, F.col("other"))),
            F.when(~lost & (i % 3 != 2), at(520, 9, "(first half)")),
        ),
        lambda c: c.isNotNull(),
    )
    # What the last row of a full sheet still has to say stands at the head of the next one.
    over = F.when((i % 3 == 0) & (i > 0), F.array(F.struct(F.lit(520.0).alias("along"), F.lit(52.0).alias("down"), F.concat(F.lit("continued "), F.col("name")).alias("text"))))
    heads = F.array(*[F.struct(F.lit(float(a)).alias("along"), F.lit(40.0 + e).alias("down"), F.lit(t).alias("text")) for a, e, t in ((20, 0, "Game"), (48, 0, "Date"), (90, 1, "Game"), (118, 0, "Time"), (150, 0, "Matchup"), (220, 0, "Team"), (330, 2, "Player"), (370, 0, "Name"), (450, 0, "Current"), (480, 0, "Status"), (520, 0, "Reason"))])
    title = F.array(F.struct(F.lit(30.0).alias("along"), F.lit(15.0).alias("down"), F.concat(F.lit("Injury Report: 11/"), day, F.lit("/26 05:30 PM")).alias("text")))
    foot = F.array(F.struct(F.lit(300.0).alias("along"), F.lit(240.0).alias("down"), F.format_string("Page %d of %d", sheet + 1, F.ceil(n / 3)).alias("text")))
    nothing = F.array().cast("array<struct<along: double, down: double, text: string>>")
    opens = F.col("i") % 3 == 0
    headed = opens & ((i == 0) | (F.col("report") % 3 < 2))
    all_ = F.concat(cells, F.coalesce(over, nothing), F.when(headed, heads).otherwise(nothing), F.when(opens, title).otherwise(nothing), F.when(opens, foot).otherwise(nothing))
    tokens = x.select("report", sheet.alias("page"), "i", F.posexplode(all_).alias("k", "c"))
    sideways = F.col("report") % 2 == 1
    return tokens.select(
        "report", "page", (F.col("i") * 100 + F.col("k")).alias("item"),
        F.when(sideways, F.col("c.down")).otherwise(F.col("c.along")).alias("x"), F.when(sideways, F.col("c.along")).otherwise(-F.col("c.down")).alias("y"), F.col("c.text").alias("text"),
    )


@query(
    LISTED
    + """, lost AS (SELECT *, i % 5 = 4 AS lost, i - i % 2 AS g FROM line)
SELECT l.report, printf('2026-11-%02dT17:30', l.report % 28 + 1) AS issued, l.i // 3 AS page, (l.i + 1)::INT AS nth, printf('2026-11-%02d', l.report % 28 + 1) AS game_date, 'AB@C' || chr((65 + l.g)::INT) AS matchup, 'Team ' || t.name AS team,
  CASE WHEN NOT l.lost THEN l.name || ', ' || l.other END AS player, CASE WHEN NOT l.lost THEN ['Available', 'Probable', 'Questionable', 'Doubtful', 'Out'][l.i % 5 + 1] END AS status,
  CASE WHEN l.lost THEN 'NOT YET SUBMITTED' WHEN l.i % 3 = 2 THEN 'Rest ' || l.other ELSE 'Injury/Illness - ' || l.name || ' Two-Way ' || l.other || ' (first half)' END || CASE WHEN l.i % 3 = 2 AND m.name IS NOT NULL THEN ' continued ' || m.name ELSE '' END AS reason,
  NULL::VARCHAR AS issue
FROM lost l JOIN line t ON t.report = l.report AND t.i = l.g LEFT JOIN line m ON m.report = l.report AND m.i = l.i + 1"""
)
def printed_reports(s, d):
    """Reports printed as positioned text, upright and sideways, read back as rows."""
    return P.report_rows(printed(s, d))


@query(
    with_views(PLAY, FEED)
    + """, g AS (SELECT team, game, min(happened) AS known, arg_min(hours, (happened, ord)) AS lead FROM feed GROUP BY ALL),
game AS (SELECT *, known + to_hours((6 + lead)::BIGINT) AS start, (known + to_hours((6 + lead)::BIGINT))::DATE AS day FROM g),
now AS (SELECT DISTINCT * FROM (
  SELECT team, game, unnest([known, day::TIMESTAMP + INTERVAL 6 HOUR, start - INTERVAL 6 HOUR, start - INTERVAL 1 HOUR]) AS now, known, start, day FROM game
  UNION ALL SELECT x.team, x.game, f.happened, x.known, x.start, x.day FROM game x JOIN feed f ON f.team = x.team AND f.happened BETWEEN x.known AND x.start) WHERE now >= known AND now < start),
state AS (SELECT n.team, n.game, n.now, arg_max(f.status, (f.happened, f.ord)) AS status FROM now n JOIN feed f ON f.team = n.team AND f.game = n.game AND f.happened <= n.now GROUP BY ALL),
other AS (SELECT n.team, n.game, n.now, o.game AS other, arg_max(f.status, (f.happened, f.ord)) AS status FROM now n JOIN game o ON o.team = n.team AND o.day < n.day AND o.day >= n.day - 2 JOIN feed f ON f.team = o.team AND f.game = o.game AND f.happened <= n.now GROUP BY ALL),
block AS (SELECT team, game, now, bool_or(status IN ('scheduled', 'in-progress')) AS blocked FROM other GROUP BY ALL),
look AS (SELECT n.*, coalesce(blocked, false) AS blocked FROM now n JOIN state s USING (team, game, now) LEFT JOIN block USING (team, game, now) WHERE s.status = 'scheduled'),
seal AS (SELECT team, game, start, min(now) FILTER (now >= day::TIMESTAMP + INTERVAL 6 HOUR AND NOT blocked OR now >= start - INTERVAL 6 HOUR) AS m, min(now) FILTER (now >= start - INTERVAL 1 HOUR) AS f FROM look GROUP BY ALL)
SELECT s.team, s.game, 'morning' AS decision, strftime(m, '%Y-%m-%dT%H:%M:%S.%f') AS "at", blocked AS incomplete FROM seal s JOIN look l ON l.team = s.team AND l.game = s.game AND l.now = s.m
UNION ALL SELECT s.team, s.game, 'final', strftime(f, '%Y-%m-%dT%H:%M:%S.%f'), blocked FROM seal s JOIN look l ON l.team = s.team AND l.game = s.game AND l.now = s.f WHERE m IS NOT NULL
UNION ALL SELECT team, game, 'missed', strftime(start, '%Y-%m-%dT%H:%M:%S.%f'), false FROM seal WHERE m IS NOT NULL AND f IS NULL"""
)
def seal_timeline(s, d):
    """When each contest of a team is sealed in the morning and for good, or missed, from all that the events tell of it."""
    return Z.seal_times(status_feed(s, d)).withColumn("at", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


VERSIONED = """, entries AS (
  SELECT ord, game, CASE WHEN hour(happened) < 12 THEN 'v1' ELSE 'v2' END AS version, entry, p, lag(p) OVER (PARTITION BY split_part(game, '-', 1) ORDER BY ord) AS reference, hour(happened) >= 20 AS incomplete,
         CASE WHEN happened >= TIMESTAMP '2024-01-20' THEN 3 WHEN happened >= TIMESTAMP '2024-01-10' THEN 2 ELSE 1 END AS revision, won
  FROM ledger),
seal AS (SELECT version, game, arg_min(p, ord) FILTER (entry = 'final') AS f, arg_min(p, ord) FILTER (entry = 'reissued') AS r, arg_min(p, ord) FILTER (entry = 'morning') AS m,
  min(ord) FILTER (entry = 'final') AS fo, min(ord) FILTER (entry = 'reissued') AS ro, min(ord) FILTER (entry = 'morning') AS mo FROM entries WHERE entry IN ('final', 'reissued', 'morning') GROUP BY ALL),
res AS (SELECT game, arg_max(won, ord) AS won FROM ledger WHERE entry = 'result' GROUP BY game),
g AS (SELECT s.*, e.p, e.reference, e.incomplete, e.revision, res.won, coalesce(r, m) AS l FROM seal s JOIN entries e ON e.ord = coalesce(fo, ro, mo) LEFT JOIN res ON res.game = s.game),
c AS (SELECT *, least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, p)) AS q, least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, l)) AS lq, least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, m)) AS mq, least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, r)) AS rq, least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, reference)) AS eq FROM g)"""


def versioned_ledger(s, d):
    """The ledger with what a version's seals carry: rows before noon are one model's, later ones another's; a seal's
    reference is the user's forecast before it, and inputs are incomplete late in the day."""
    rows, hour = ledger(s, d), F.hour("happened")
    before = F.lag("p").over(Window.partitionBy(F.substring_index("game", "-", 1)).orderBy("ord"))
    revision = F.when(F.col("happened") >= F.lit("2024-01-20").cast("timestamp_ntz"), 3).when(F.col("happened") >= F.lit("2024-01-10").cast("timestamp_ntz"), 2).otherwise(1)
    return rows.select("ord", "game", F.when(hour < 12, "v1").otherwise("v2").alias("version"), "entry", "p", before.alias("reference"), (hour >= 20).alias("incomplete"), revision.alias("revision"), "won")


@query(
    with_views(PLAY, LEDGER)
    + VERSIONED
    + f""" SELECT version, count(*) AS sealed, count(won) AS scored, count(*) - count(won) AS pending, count(*) FILTER (incomplete) AS incomplete, {rnd_sql('avg((q - won) ** 2)')} AS brier,
  {rnd_sql('avg(-CASE WHEN won = 1 THEN ln(q) WHEN won = 0 THEN ln(1 - q) END)')} AS log_loss, {rnd_sql('avg(((q > 0.5) = (won = 1))::INT)')} AS accuracy, {rnd_sql('avg((0.6::DOUBLE - won) ** 2)')} AS baseline_brier,
  count(*) FILTER (won IS NOT NULL AND fo IS NULL) AS no_final_seal, {rnd_sql('avg((lq - won) ** 2) FILTER (l IS NOT NULL)')} AS latest_brier, count(*) FILTER (won IS NOT NULL AND l IS NOT NULL) AS latest_count,
  {rnd_sql('avg((mq - won) ** 2) FILTER (m IS NOT NULL)')} AS original_brier, count(*) FILTER (won IS NOT NULL AND m IS NOT NULL) AS original_count, {rnd_sql('avg((rq - won) ** 2) FILTER (r IS NOT NULL)')} AS reissued_brier, count(*) FILTER (won IS NOT NULL AND r IS NOT NULL) AS reissued_count,
  CASE WHEN count(won) > 0 AND count(won) FILTER (reference IS NOT NULL) = count(won) THEN {rnd_sql('avg((eq - won) ** 2)')} END AS reference_brier, count(won) < 500 AS small_sample,
  (SELECT count(*) FROM entries e WHERE e.entry = 'missed' AND e.version = c.version) AS missed FROM c GROUP BY version"""
)
def full_forecast_record(s, d):
    """All measures of each model version's forecasts, nulls where they don't apply."""
    got = L.forecast_record(versioned_ledger(s, d), 0.6)
    return got.select(*[rnd(F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in got.dtypes])


@query(
    with_views(PLAY, LEDGER)
    + VERSIONED
    + f""", every AS (SELECT DISTINCT version, revision FROM (SELECT DISTINCT version FROM seal), unnest([1, 2, 3, 4]) AS u(revision))
SELECT version, revision, (SELECT count(*) FROM entries e WHERE e.version = v.version AND e.revision = v.revision AND entry IN ('final', 'reissued', 'morning')) AS seal_rows, count(c.game) AS sealed, count(won) AS scored, {rnd_sql('avg((q - won) ** 2)')} AS brier
FROM every v LEFT JOIN c USING (version, revision) GROUP BY ALL"""
)
def record_by_revision(s, d):
    """The record by policy revision, one that no row has yet included."""
    got = L.revision_record(versioned_ledger(s, d), [1, 2, 3, 4])
    return got.withColumn("brier", rnd(F.col("brier")))


@query(
    LISTED
    + """, wide AS (SELECT report, n, i, name, other, first_value(name) OVER (PARTITION BY report, i // 2 ORDER BY i) AS lead FROM line)
SELECT DISTINCT report, r AS "row", c AS col, t AS text, h AS heading FROM (
  SELECT report, 0 AS r, unnest([0, 1, 2]) AS c, unnest(['Who & whom', 'Who & whom', 'Other']) AS t, true AS h FROM wide
  UNION ALL SELECT report, i + 1, unnest([0, 1, 2]), unnest([lead, name, other || ' & co']), false FROM wide)"""
)
def hidden_tables(s, d):
    """Tables hidden in comments, with cells over several rows and columns, read back place by place."""
    x = listed_names(s, d)
    lead = F.when(F.col("i") % 2 == 0, F.concat(F.lit('<td rowspan="2">'), "name", F.lit("</td>"))).otherwise("")
    row = F.concat(F.lit("<tr>"), lead, F.lit('<td class="a"><a href="/x">'), "name", F.lit("</a></td>\n<td>"), "other", F.lit(" &amp; co</td></tr>"))
    rows = x.groupBy("report").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", row.alias("h")))), lambda r: r["h"]), "").alias("rows"))
    head = "<table id='other'><tr><td>no</td></tr></table><!-- note --><!--<div><table class='s' id=\"stats\"><tr><th colspan=2>Who &amp;\n whom</th><th>Other</th></tr>"
    pages = rows.select("report", F.concat(F.lit(head), "rows", F.lit("</table></div>--><p>after</p>")).alias("html"))
    return H.table_cells(pages, "report", "html", "stats").select("report", "row", "col", "text", "heading")


@query("SELECT o_orderstatus AS status, count(*) AS orders, '2' AS version, 'older' AS delivery FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY ALL")
def published_snapshot(s, d):
    """Orders published three times as they grew; the last version is torn, so the one before it is read, whole."""
    root = f"{shared_dir(s)}/published-{uuid.uuid4().hex}"
    orders = table(s, d, "orders")
    for version, until in (("1", "1997-01-01"), ("2", "1999-01-01"), ("3", "2100-01-01")):
        B.publish({"orders": orders.where(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz"))}, root, version)
    orders.limit(1).write.mode("overwrite").parquet(f"{root}/data/3/orders")
    found = B.Snapshot(s, root)
    return found.table("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders")).select("*", F.lit(found.version).alias("version"), F.lit(found.delivery).alias("delivery"))
