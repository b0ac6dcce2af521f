"""Queries over forecasts and the ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestlab.functions.scoring import brier, normal_cdf, normal_cdf_sql, rnd, rnd_sql
from contestlab.operators import evaluation as E
from contestlab.operators import temporal as T
from contestlab.plans.registry import registry
from contestlab.sources.views import LEDGER, PLAY, PREDICTION, ledger, plays, predictions, table, with_views

QUERIES, ORACLES, query = registry()


Q = "least(1 - 1e-7::DOUBLE, greatest(1e-7::DOUBLE, p))"
SCORES = f"count(*) AS n, {rnd_sql('avg((p - y) * (p - y))')} AS brier, {rnd_sql(f'avg(-CASE WHEN y = 1 THEN ln({Q}) ELSE ln(1.0::DOUBLE - {Q}) END)')} AS log_loss, {rnd_sql('avg(CASE WHEN p = 0.5 THEN 0.5::DOUBLE ELSE ((p > 0.5) = (y = 1))::INT END)')} AS accuracy"


@query(with_views(PREDICTION) + f"SELECT coalesce(season::VARCHAR, '*') AS season, coalesce(round, '*') AS round, coalesce(flag::VARCHAR, '*') AS flag, {SCORES} FROM prediction GROUP BY GROUPING SETS ((season), (round), (flag), ())")
def brier_by_slice(s, d):
    """All slices in one pass over the rows by grouping sets."""
    keys = ["season", "round", "flag"]
    rows = predictions(s, d).groupingSets([["season"], ["round"], ["flag"], []], *keys).agg(*E.scores())
    return rows.select(*[F.coalesce(F.col(k).cast("string"), F.lit("*")).alias(k) for k in keys], "n", *[rnd(F.col(c)).alias(c) for c in ("brier", "log_loss", "accuracy")])


@query(with_views(PREDICTION) + f"""SELECT b::INT AS bin, count(id) AS n, coalesce({rnd_sql('avg(p)')}, -1) AS mean_p, coalesce({rnd_sql('avg(y)')}, -1) AS rate
FROM range(10) t(b) LEFT JOIN prediction ON least(9, floor(p * 10)) = b GROUP BY b""")
def calibration_equal_width(s, d):
    """Ten bins of width 0.1; -1 marks an empty bin's means."""
    return E.equal_width(predictions(s, d)).select("bin", "n", *[F.coalesce(rnd(F.col(c)), F.lit(-1.0)).alias(c) for c in ("mean_p", "rate")])


BINNED = ", binned AS (SELECT *, ((row_number() OVER (ORDER BY p, id) * 10 - 1) // count(*) OVER ())::INT AS bin FROM prediction)"


@query(with_views(PREDICTION) + BINNED + f"SELECT bin, count(*) AS n, {rnd_sql('min(p)')} AS low, {rnd_sql('max(p)')} AS high, {rnd_sql('avg(p)')} AS mean_p, {rnd_sql('avg(y)')} AS rate FROM binned GROUP BY bin")
def calibration_equal_count(s, d):
    c = lambda f, x: rnd(f(x))
    return E.equal_count(predictions(s, d)).groupBy("bin").agg(F.count("*").alias("n"), c(F.min, "p").alias("low"), c(F.max, "p").alias("high"), c(F.avg, "p").alias("mean_p"), c(F.avg, "y").alias("rate"))


@query(
    with_views(PREDICTION)
    + BINNED
    + f""", c AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum((p - y) * (p - y)) AS se FROM binned GROUP BY bin), b AS (SELECT sum(n) AS t, sum(n * my) / sum(n) AS base FROM c),
m AS (SELECT max(t)::BIGINT AS n, sum(se) / max(t) AS brier, max(base) * (1 - max(base)) AS unc, sum(n * power(my - base, 2)) / max(t) AS res, sum(n * power(mp - my, 2)) / max(t) AS rel FROM c, b)
SELECT n, {rnd_sql('brier')} AS brier, {rnd_sql('unc')} AS uncertainty, {rnd_sql('res')} AS resolution, {rnd_sql('rel')} AS reliability, {rnd_sql('brier - (unc - res + rel)')} AS residual FROM m"""
)
def murphy_decomposition(s, d):
    out = E.murphy(E.equal_count(predictions(s, d)))
    return out.select("n", *[rnd(F.col(c)).alias(c) for c in ("brier", "uncertainty", "resolution", "reliability", "residual")])


def _newton_sql(steps: int) -> str:
    parts = [", d AS (SELECT ln(least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, p)) / (1 - least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, p)))) AS x, y FROM prediction), n0 AS (SELECT 1.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        parts.append(
            f", s{k} AS (SELECT max(a) AS a, max(b) AS b, sum((q - y) * x) AS g0, sum(q - y) AS g1, sum(q * (1 - q) * x * x) AS h0, sum(q * (1 - q) * x) AS h1, sum(q * (1 - q)) AS h2 FROM (SELECT *, 1 / (1 + exp(-(x * a + b))) AS q FROM d, n{k}))"
            f", n{k + 1} AS (SELECT a - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM s{k})"
        )
    return "".join(parts)


@query(with_views(PREDICTION) + _newton_sql(8) + f"SELECT {rnd_sql('a', 5)} AS slope, {rnd_sql('b', 5)} AS intercept FROM n8")
def calibration_newton(s, d):
    a, b = E.newton_calibration(predictions(s, d))
    return s.range(1).select(rnd(F.lit(a), 5).alias("slope"), rnd(F.lit(b), 5).alias("intercept"))


@query(with_views(PREDICTION) + f"""SELECT season, count(*) AS n, {rnd_sql('avg((p - y) * (p - y) - (p2 - y) * (p2 - y))')} AS mean_difference, {rnd_sql('stddev_samp((p - y) * (p - y) - (p2 - y) * (p2 - y))')} AS sd,
sum(((p - y) * (p - y) < (p2 - y) * (p2 - y))::INT)::BIGINT AS wins FROM prediction GROUP BY season""")
def paired_model_difference(s, d):
    a, b = F.pow(F.col("p") - F.col("y"), F.lit(2)), F.pow(F.col("p2") - F.col("y"), F.lit(2))
    return predictions(s, d).groupBy("season").agg(F.count("*").alias("n"), rnd(F.avg(a - b)).alias("mean_difference"), rnd(F.stddev_samp(a - b)).alias("sd"), F.sum((a < b).cast("long")).alias("wins"))


def _draws_sql(cluster: str, sums: str, draws: int = 1000) -> str:
    """drawn(draw, times, *sums of the cluster): the same Poisson numbers from the same digests."""
    cuts = ", ".join(repr(p) for p in E.POISSON)
    return f""", c AS (SELECT {cluster} AS k, {sums} FROM prediction GROUP BY 1),
u AS (SELECT draw, c.*, ('0x' || substr(md5('17:' || k || ':' || draw // 4), 1 + 8 * (draw % 4)::INT, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM c, range(0, {draws}) d(draw)),
drawn AS (SELECT *, len(list_filter([{cuts}], lambda p: u >= p)) AS times FROM u)"""


@query(
    with_views(PREDICTION)
    + _draws_sql("season", "sum((p - y) * (p - y) - (p2 - y) * (p2 - y)) AS s, count(*) AS n")
    + f""", m AS (SELECT draw, sum(times * s) / sum(times * n) AS m FROM drawn WHERE times > 0 GROUP BY draw), r AS (SELECT m, row_number() OVER (ORDER BY m) AS r, count(*) OVER () AS k FROM m)
SELECT (SELECT count(*) FROM c) AS clusters, (SELECT {rnd_sql('sum(s) / sum(n)')} FROM c) AS mean, {rnd_sql('max(m) FILTER (r = floor(k * 0.025::DOUBLE) + 1)')} AS low, {rnd_sql('max(m) FILTER (r = ceil(k * 0.975::DOUBLE))')} AS high FROM r"""
)
def cluster_bootstrap_ci(s, d):
    """Difference of two models' squared errors, with an interval over seasons as clusters."""
    rows = predictions(s, d).withColumn("gain", F.pow(F.col("p") - F.col("y"), F.lit(2)) - F.pow(F.col("p2") - F.col("y"), F.lit(2)))
    return E.cluster_bootstrap(rows, "season", "gain").select("clusters", *[rnd(F.col(c)).alias(c) for c in ("mean", "low", "high")])


@query(
    with_views(PREDICTION)
    + _draws_sql("id", "sum((p - y) ** 2) AS a, sum((p2 - y) ** 2) AS b")
    + f""", m AS (SELECT draw, sqrt(sum(times * a) / sum(times * b)) AS r FROM drawn WHERE times > 0 GROUP BY draw)
SELECT (SELECT {rnd_sql('sqrt(sum(a) / sum(b))')} FROM c) AS ratio, {rnd_sql('quantile_cont(r, 0.025)')} AS low, {rnd_sql('quantile_cont(r, 0.5)')} AS median, {rnd_sql('quantile_cont(r, 0.975)')} AS high, {rnd_sql('avg((r <= 1)::INT)')} AS share_at_or_below FROM m"""
)
def ratio_bootstrap_ci(s, d):
    """Ratio of two models' root mean squared errors, with an interval over all forecasts."""
    rows = predictions(s, d).withColumns({"e": F.col("p") - F.col("y"), "e2": F.col("p2") - F.col("y")})
    got = E.ratio_bootstrap(rows, "id", "e", "e2")
    return got.select(*[rnd(F.col(c)).alias(c) for c in ("ratio", "low", "median", "high", "share_at_or_below")])


@query("SELECT o_orderkey AS game_id, ((row_number() OVER (ORDER BY md5('17:' || o_orderkey), o_orderkey) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT o_orderkey FROM orders)")
def contest_folds(s, d):
    """Five folds of all contests, dealt in a seeded order."""
    return E.seeded_folds(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("game_id")), "game_id", 5)


@query(with_views(PREDICTION) + f"SELECT id, {rnd_sql('(p - y) * (p - y)')} AS loss FROM prediction ORDER BY (p - y) * (p - y) DESC, id LIMIT 12")
def worst_forecasts_top12(s, d):
    loss = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    return predictions(s, d).select("id", loss.alias("_l")).orderBy(F.desc("_l"), "id").limit(12).select("id", rnd(F.col("_l")).alias("loss"))


@query(with_views(PREDICTION) + f"SELECT round, count(*) FILTER (p <> 0.5) AS decided, sum(((p > 0.5) = (y = 1) AND p <> 0.5)::INT)::BIGINT AS won, {rnd_sql('sum(CASE WHEN p <> 0.5 THEN greatest(p, 1 - p) ELSE 0 END)', 4)} AS expected FROM prediction GROUP BY round")
def favorite_summary(s, d):
    decided = F.col("p") != 0.5
    return predictions(s, d).groupBy("round").agg(
        F.count(F.when(decided, 1)).alias("decided"), F.sum((decided & ((F.col("p") > 0.5) == (F.col("y") == 1))).cast("long")).alias("won"), rnd(F.sum(F.when(decided, F.greatest(F.col("p"), 1 - F.col("p"))).otherwise(0.0)), 4).alias("expected")
    )


@query(
    with_views(PLAY, LEDGER)
    + f""", seal AS (SELECT game, p, entry FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY CASE entry WHEN 'final' THEN 0 WHEN 'reissued' THEN 1 ELSE 2 END, ord) AS r FROM ledger WHERE entry IN ('final', 'reissued', 'morning')) WHERE r = 1),
res AS (SELECT game, arg_max(won, ord) AS won FROM ledger WHERE entry = 'result' GROUP BY game)
SELECT entry, count(*) AS sealed, count(won) AS scored, {rnd_sql('avg((p - won) * (p - won))')} AS brier, sum((p > 0.5 AND won = 1 OR p <= 0.5 AND won = 0)::INT)::BIGINT AS right_side FROM seal LEFT JOIN res USING (game) GROUP BY entry"""
)
def ledger_record_summary(s, d):
    rows = T.ledger_scores(ledger(s, d)).where("seal IS NOT NULL").select(F.col("seal.entry").alias("entry"), F.col("seal.p").alias("p"), F.col("result.won").alias("won"))
    return rows.groupBy("entry").agg(F.count("*").alias("sealed"), F.count("won").alias("scored"), rnd(brier(F.col("p"), F.col("won"))).alias("brier"), F.sum(((F.col("p") > 0.5) == (F.col("won") == 1)).cast("long")).alias("right_side"))


@query(
    with_views(PLAY, LEDGER)
    + """, g AS (SELECT game, bool_or(entry IN ('final', 'reissued', 'morning')) AS sealed, count(*) FILTER (entry = 'result') AS results, bool_or(entry = 'missed') AS missed, count(DISTINCT won) FILTER (entry = 'result') AS kinds FROM ledger GROUP BY game)
SELECT game, results, CASE WHEN sealed AND results > 0 THEN 'scored' WHEN sealed THEN 'pending' WHEN missed THEN 'missed' ELSE 'absent' END AS state, (kinds > 1)::INT AS corrected FROM g"""
)
def ledger_rule_violations(s, d):
    """The state of every game in the ledger, and whether later results correct earlier ones."""
    rows = ledger(s, d).groupBy("game").agg(
        F.bool_or(F.col("entry").isin(*T.PRIORITY)).alias("sealed"), F.count(F.when(F.col("entry") == "result", 1)).alias("results"), F.bool_or(F.col("entry") == "missed").alias("missed"),
        F.min(F.when(F.col("entry") == "result", F.col("won"))).alias("a"), F.max(F.when(F.col("entry") == "result", F.col("won"))).alias("b"),
    )
    state = F.when(F.col("sealed") & (F.col("results") > 0), "scored").when(F.col("sealed"), "pending").when(F.col("missed"), "missed").otherwise("absent")
    return rows.select("game", "results", state.alias("state"), F.coalesce((F.col("a") < F.col("b")).cast("int"), F.lit(0)).alias("corrected"))


@query(with_views(PLAY, LEDGER) + "SELECT game, max(ord) AS ord, arg_max(won, ord) AS won, strftime(max(happened), '%Y-%m') AS month FROM ledger WHERE entry = 'result' GROUP BY game")
def ledger_latest_result(s, d):
    return ledger(s, d).where("entry = 'result'").groupBy("game").agg(F.max("ord").alias("ord"), F.max_by("won", "ord").alias("won"), F.date_format(F.max("happened"), "yyyy-MM").alias("month"))


@query(with_views(PLAY, LEDGER) + "SELECT strftime(happened, '%Y-%m-%d') AS day, count(*) AS n, sum(('0x' || substr(sha256(ord || ':' || entry), 1, 12))::BIGINT)::VARCHAR AS digest FROM ledger GROUP BY 1")
def manifest_hashes(s, d):
    """Each day's entries under one digest, as a manifest of published partitions: the sum of the entries' own digests, so
    it needs no order and no list of a day's entries."""
    line = F.conv(F.substring(F.sha2(F.concat_ws(":", "ord", "entry"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return ledger(s, d).groupBy(F.date_format("happened", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum(line).cast("string").alias("digest"))


@query(with_views(PLAY) + """, l AS (SELECT event_id, user_id, ts FROM play WHERE kind = 'purchase'), r AS (SELECT user_id, ts, event_id AS found, value FROM play WHERE kind = 'view')
SELECT l.event_id, coalesce(found, -1) AS found, coalesce(floor(value * 100)::BIGINT, -1) AS cents FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def as_of_latest_report(s, d):
    """Each purchase with the user's latest view at or before it; -1 where there is none."""
    p = plays(s, d)
    left = p.where("kind = 'purchase'").select("event_id", "user_id", "ts")
    right = p.where("kind = 'view'").select("user_id", "ts", F.col("event_id").alias("found"), "value")
    got = T.as_of(left, right, ["user_id"], "ts", ["found", "value"], "found")
    return got.select("event_id", F.coalesce("found", F.lit(-1)).alias("found"), F.coalesce(F.floor(F.col("value") * 100).cast("long"), F.lit(-1)).alias("cents"))


@query(
    with_views(PLAY)
    + """, o AS (SELECT *, sum((date_diff('millisecond', prev, ts) // 1000 > 86400)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM play))
SELECT user_id, coalesce(session, 0)::BIGINT AS session, count(*) AS plays, min(event_id) AS first_event, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM o GROUP BY 1, 2"""
)
def session_stints(s, d):
    """Users' sessions, apart by more than a day."""
    rows = T.sessions(plays(s, d), "user_id", "ts", "event_id", 86400)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("plays"), F.min("event_id").alias("first_event"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("started"))


@query(with_views(PLAY) + "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS opened, kind, count(*) AS n FROM play GROUP BY 1, 2")
def tumbling_counts(s, d):
    return plays(s, d).groupBy(F.window("ts", "6 hours").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("opened"), "kind", "n")


@query(with_views(PLAY) + "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * o, '%Y-%m-%d %H:%M:%S') AS opened, count(*) AS n FROM play, range(2) t(o) GROUP BY 1")
def sliding_counts(s, d):
    return plays(s, d).groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("opened"), "n")


@query(with_views(PLAY) + f"SELECT event_id, {rnd_sql(normal_cdf_sql('((value - 250) / 100)'))} AS p FROM play")
def normal_cdf_in_game(s, d):
    return plays(s, d).select("event_id", rnd(normal_cdf((F.col("value") - 250) / 100)).alias("p"))


@query(
    with_views(PLAY, LEDGER)
    + f""", r AS (SELECT *, CASE WHEN happened >= TIMESTAMP '2024-01-20' THEN 3 WHEN happened >= TIMESTAMP '2024-01-10' THEN 2 WHEN happened >= TIMESTAMP '2024-01-01' THEN 1 ELSE 0 END AS revision FROM ledger)
SELECT revision::INT AS revision, count(*) AS n, {rnd_sql('avg(p)')} AS mean_p FROM r GROUP BY 1"""
)
def policy_revision_in_force(s, d):
    steps = [("2024-01-01", 1), ("2024-01-10", 2), ("2024-01-20", 3)]
    rows = ledger(s, d)
    return rows.withColumn("revision", F.coalesce(T.in_force(rows, steps, "happened"), F.lit(0))).groupBy("revision").agg(F.count("*").alias("n"), rnd(F.avg("p")).alias("mean_p"))


@query("SELECT role, count(*) AS turns, coalesce(sum((prev = role)::INT), 0)::BIGINT AS repeats, max(n)::BIGINT AS longest FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY role")
def conversation_turn_windows(s, d):
    w = Window.partitionBy("conv_id")
    rows = table(s, d, "conversations").withColumns({"prev": F.lag("role").over(w.orderBy("turn")), "n": F.count("*").over(w)})
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.coalesce(F.sum((F.col("prev") == F.col("role")).cast("long")), F.lit(0)).alias("repeats"), F.max("n").alias("longest"))
