"""Operators on small hand-made rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlab.functions import scoring, text
from contestlab.operators import appearances, evaluation, folds, simulate, standings, temporal

GAME = "game_id long, season int, game_date date, status string, home_id int, away_id int, home_score long, away_score long, neutral boolean"


def games(spark, rows):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(i, 2020, day + dt.timedelta(days=d), "final", h, a, hs, as_, False) for i, (d, h, a, hs, as_) in enumerate(rows)], GAME)


def test_as_of_takes_the_latest_at_or_before(spark):
    t = lambda m: dt.datetime(2020, 1, 1, 0, m)
    left = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(0)), (3, "b", t(9)), (4, None, t(9))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", t(5), 1, 10), ("a", t(5), 2, 20), ("a", t(6), 3, 30), ("b", t(1), 4, 40)], "k string, ts timestamp, n int, v int")
    got = {r["id"]: r["v"] for r in temporal.as_of(left, right, ["k"], "ts", ["v"], "n").collect()}
    assert got == {1: 20, 2: None, 3: 40, 4: None}
    aged = temporal.as_of(left, right, ["k"], "ts", ["v"], "n", F.expr("interval 5 minutes"))
    assert {r["id"]: r["v"] for r in aged.collect()} == {1: 20, 2: None, 3: None, 4: None}


@pytest.mark.parametrize("n", [1, 5, 17, 100])
def test_equal_count_bins_have_the_stated_boundaries(spark, n):
    rows = spark.createDataFrame([(i, (i * 7 % n) / n) for i in range(n)], "id int, p double")
    got = {r["bin"]: r["count"] for r in evaluation.equal_count(rows).groupBy("bin").count().collect()}
    want = {b: (b + 1) * n // 10 - b * n // 10 for b in range(10)}
    assert got == {b: c for b, c in want.items() if c}


def test_newton_recovers_a_distorted_forecast(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(2 * x + 0.5)))
    rows = spark.createDataFrame([(float(1 / (1 + np.exp(-a))), int(b)) for a, b in zip(x, y)], "p double, y int")
    slope, intercept = evaluation.newton_calibration(rows)
    assert abs(slope - 2) < 0.2 and abs(intercept - 0.5) < 0.15


def test_streaks_and_rest(spark):
    side = standings
    from contestlab.sources.views import sides

    rows = sides(games(spark, [(0, 1, 2, 1, 5), (1, 1, 2, 2, 5), (3, 2, 1, 9, 1), (4, 1, 2, 7, 1)]))
    got = {(r["team_id"], r["length"], r["still_open"]) for r in side.streaks(rows).collect()}
    assert got == {(1, 3, 0), (2, 1, 1)}
    rest = {(r["game_id"], r["team_id"]): (r["rest_days"], r["back_to_back"]) for r in side.rest_flags(rows).collect()}
    assert rest[0, 1] == (-1, 0) and rest[1, 1] == (1, 1) and rest[2, 2] == (2, 0)


def test_as_of_date_hides_the_future(spark):
    got = standings.as_of_date(games(spark, [(0, 1, 2, 1, 5), (5, 1, 2, 2, 5)]), "2020-01-03").orderBy("game_id").collect()
    assert [r["home_score"] for r in got] == [1, None] and got[1]["status"] == "scheduled"


def test_elo_uses_nothing_but_the_past(spark):
    rows = [(d, 1 + d % 3, 1 + (d + 1) % 3, 10 + d, 9) for d in range(8)]
    whole = {r["game_id"]: r["p_home"] for r in folds.elo(games(spark, rows).withColumn("pool", F.lit(1)), "pool").collect()}
    part = {r["game_id"]: r["p_home"] for r in folds.elo(games(spark, rows[:5]).withColumn("pool", F.lit(1)), "pool").collect()}
    assert part == {k: whole[k] for k in part}


def test_kalman_first_game_is_the_home_advantage(spark):
    first = folds.kalman(games(spark, [(0, 1, 2, 1, 5)]).withColumn("pool", F.lit(1)), "pool").first()
    assert first["expected_margin"] == pytest.approx(1.0) and first["variance"] == pytest.approx(1 + 2 * 4.5**2)


def test_series_chances(spark):
    row = spark.range(1).select(simulate.series_win(F.lit(0.5)).alias("w"), simulate.expected_games(F.lit(0.5)).alias("g"), simulate.series_win(F.lit(1.0)).alias("one")).first()
    assert row["w"] == pytest.approx(0.5) and row["g"] == pytest.approx(5.8125) and row["one"] == 1


def test_season_chances_add_up(spark):
    strength = spark.createDataFrame([(i, "EW"[i % 2], 10, float(i), 1.0) for i in range(6)], "team_id long, conference string, wins long, mean double, sd double")
    fixtures = spark.createDataFrame([(a, b, 2) for a in range(6) for b in range(6) if a != b], "home_id long, away_id long, n long")
    got = simulate.season(strength, fixtures, iterations=200, parts=4).collect()
    assert sum(r["leads"] for r in got) == pytest.approx(2) and sum(r["top_two"] for r in got) == pytest.approx(4)
    assert sum(r["mean_wins"] for r in got) == pytest.approx(60 + 60)


def test_cascade_never_falls_back_from_an_ambiguous_match(spark):
    known = spark.createDataFrame([("x", "k", 1), ("x", "k", 2), ("y", "k", 3), ("y", "m", 4)], "team string, key string, id int")
    asked = spark.createDataFrame([(1, "x", "k"), (2, "y", "k"), (3, "z", "m"), (4, "z", "k"), (5, "z", "q")], "n int, team string, key string")
    got = {r["n"]: (r["resolved"], r["how"]) for r in appearances.unique_key_cascade(asked, known, known, "key", "team", "id").collect()}
    assert got == {1: (None, "ambiguous"), 2: (3, "narrow"), 3: (4, "wide"), 4: (None, "ambiguous"), 5: (None, "unknown")}


def test_scalars(spark):
    row = spark.range(1).select(
        scoring.normal_cdf(F.lit(1.959963984540054)).alias("z"), scoring.normal_cdf(F.lit(-8.0)).alias("t"), scoring.implied_probability(F.lit(-150)).alias("m"), scoring.implied_probability(F.lit(50)).alias("bad"),
        text.name_key(F.lit("José  O'Neil-Smith Jr.")).alias("k"), text.first_last(F.lit("Doe, Jane")).alias("f"), text.match_tier(F.lit("new york"), F.lit("york")).alias("y"),
    ).first()
    assert row["z"] == pytest.approx(0.975, abs=1e-12) and row["t"] == pytest.approx(0.5 * math.erfc(8 / math.sqrt(2)), rel=1e-6)
    assert row["m"] == pytest.approx(0.6) and row["bad"] is None
    assert row["k"] == "jose oneil smith" and row["f"] == "Jane Doe" and row["y"] == 2


def test_readers_are_strict(spark, tmp_path):
    from contestlab.sources import readers

    (tmp_path / "a.csv").write_text("b,a\n1.5,x\n2.5,y\n")
    got = readers.csv_by_header(spark, str(tmp_path / "a.csv"), {"a": "string", "b": "double"})
    assert [tuple(r) for r in got.orderBy("a").collect()] == [("x", 1.5), ("y", 2.5)]
    with pytest.raises(ValueError):
        readers.csv_by_header(spark, str(tmp_path / "a.csv"), {"z": "string"})
    (tmp_path / "l.jsonl").write_text('{"k": 1}\n{"k": }\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "l.jsonl"), "k int").collect()


def test_manifest_tells_rewritten_days(spark):
    from contestlab.sources import readers

    rows = lambda x: spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", x)], "day string, n int")
    old = readers.manifest(rows(3), "day", ["day", "n"])
    assert readers.intact(readers.manifest(rows(3), "day", ["day", "n"]), old, "day").count() == 0
    assert [r["day"] for r in readers.intact(readers.manifest(rows(4), "day", ["day", "n"]), old, "day").collect()] == ["d2"]


def test_rules_name_every_breach(spark):
    from contestlab.operators import audits

    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    got = audits.broken_rules(rows, ["id"], {"null": F.col("v").isNull(), "negative": F.col("v") < 0}).collect()
    assert {(r["id"], r["rule"]) for r in got} == {(2, "null"), (3, "negative")}
    assert audits.broken_rules(rows.limit(0), ["id"], {"null": F.col("v").isNull()}).count() == 0


def test_ridge_and_left_out_penalty(spark):
    from contestlab.operators import linear

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2)) * [1, 5]
    y = 2 + x @ [1.5, -0.3] + rng.normal(size=600) * 0.1
    rows = spark.createDataFrame([(int(i % 4), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "season int, a double, b double, y double")
    sums = linear.moment_sums(rows, "season", ["a", "b"], "y")
    assert linear.ridge(sum(sums.values()), 1e-9) == pytest.approx(np.linalg.lstsq(np.c_[np.ones(600), x], y, rcond=None)[0], abs=1e-8)
    best, loss = linear.penalty_left_out(sums)
    assert best in (0.01, 0.1, 1.0) and loss[100.0] > loss[best]


def test_logistic_finds_the_coefficients(spark):
    from contestlab.operators import linear

    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 2))
    y = rng.random(5000) < 1 / (1 + np.exp(-(0.4 + x @ [1.0, -2.0])))
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    assert linear.logistic(rows, ["a", "b"], "y") == pytest.approx([0.4, 1.0, -2.0], abs=0.2)


def test_paired_effects_recover_a_league(spark):
    from contestlab.operators import linear

    rng = np.random.default_rng(5)
    true = rng.normal(size=20)
    true -= true.mean()
    rows = []
    for _ in range(3000):
        ten = rng.permutation(20)[:10]
        rows.append((ten[:5].tolist(), ten[5:].tolist(), float(true[ten[:5]].sum() - true[ten[5:]].sum() + rng.normal() + 3), 1.0))
    got = linear.paired_effects(spark.createDataFrame(rows, "p array<int>, m array<int>, y double, w double"), "p", "m", "y", "w", 1.0).orderBy("entity").collect()
    assert np.corrcoef([r["effect"] for r in got], true)[0, 1] > 0.99


def test_monotone_pools_violators():
    from contestlab.operators.linear import monotone

    assert monotone([1, 3, 2, 4], [1, 1, 1, 1]) == [1, 2.5, 2.5, 4] and monotone([3, 2, 1], [1, 1, 2]) == [1.75] * 3 and monotone([], []) == []


def test_relations(spark):
    from contestlab.operators import relations as R

    day = lambda n: dt.date(2020, 1, n)
    points = spark.createDataFrame([("a", day(1)), ("a", day(5)), ("b", day(2))], "k string, d date")
    spans = spark.createDataFrame([("a", day(1), day(3), 1), ("a", day(2), day(5), 2), ("b", day(5), day(2), 3)], "k string, s date, e date, n int")
    assert sorted(r["n"] for r in R.within_interval(points, spans, ["k"], "d", "s", "e").collect()) == [1, 2]
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 1, None)], "k string, t int, v int")
    assert {(r["k"], r["t"]): r["v"] for r in R.fill_down(rows, ["k"], ["t"], ["v"]).collect()} == {("a", 1): 5, ("a", 2): 5, ("b", 1): None}
    assert sorted((r["k"], r["v"]) for r in R.newest(rows.where("t = 2"), rows.where("t = 1"), ["k"]).select("k", F.coalesce("v", F.lit(0)).alias("v")).collect()) == [("a", 0), ("b", 0)]
    shares = R.bounded_shares(spark.createDataFrame([("g", 1, 60.0), ("g", 2, 30.0), ("g", 3, 10.0)], "g string, i int, w double"), "g", "w", "i", 100.0, 50.0).orderBy("i").collect()
    assert [r["share"] for r in shares] == pytest.approx([50.0, 37.5, 12.5])


def test_ties_go_to_head_to_head(spark):
    from contestlab.operators import relations as R

    table = spark.createDataFrame([("c", 1, 5, 5, 50), ("c", 2, 5, 5, -50), ("c", 3, 8, 2, 0)], "conf string, team int, wins long, losses long, diff long")
    met = spark.createDataFrame([("c", 1, 2, 3, 9), ("c", 2, 1, 9, 3), ("c", 3, 1, 0, 1)], "conf string, team_id int, opp_id int, scored long, allowed long")
    assert {r["team"]: r["seed"] for r in R.break_ties(table, met, "conf", "team").collect()} == {3: 1, 2: 2, 1: 3}


def test_a_day_is_priced_from_the_state_before_it(spark):
    rows = games(spark, [(0, 1, 2, 30, 1), (0, 1, 3, 30, 1), (1, 1, 2, 9, 8)]).withColumn("pool", F.lit(1))
    got = {r["game_id"]: r["expected_margin"] for r in folds.kalman(rows, "pool", by_day=True).collect()}
    assert got[0] == got[1] == pytest.approx(1.0) and got[2] > 1.0
    one = {r["game_id"]: r["expected_margin"] for r in folds.kalman(rows, "pool").collect()}
    assert one[1] > 1.0
    moved = {r["game_id"]: r["expected_margin"] for r in folds.kalman(rows.withColumn("a", F.lit(2.0)), "pool", adjust="a").collect()}
    assert moved[0] == pytest.approx(3.0)


def test_uncertain_series_bracket_the_certain_one(spark):
    row = spark.range(1).select(simulate.series_uncertainty(F.col("id"), F.lit(2.0), F.lit(1.0)).alias("p"), simulate.series_win(1 / (1 + F.exp(F.lit(-2.0 / 6.5)))).alias("w")).first()
    assert row["p"]["p10"] < row["w"] < row["p"]["p90"] and abs(row["p"]["p50"] - row["w"]) < 0.03


def test_a_team_has_one_rating_wherever_it_plays(spark):
    from contestlab.plans import models
    from contestlab.sources.views import contests, ratable

    sf = "/root/testdata/sf0.001"
    rows = ratable(contests(spark, sf)).orderBy("season", "game_date", "game_id").collect()
    got = {r["game_id"]: r for r in models.elo_walk(spark, sf).collect()}
    assert len(got) == len(rows)
    ratings, season = {}, rows[0]["season"]
    for g in rows:
        if g["season"] != season:
            season, ratings = g["season"], {t: 0.75 * r + 0.25 * 1505 for t, r in ratings.items()}
        h, a = (ratings.get(g[x], 1505.0) for x in ("home_id", "away_id"))
        want = 1 / (1 + 10 ** (-(h - a + (0 if g["neutral"] else 100)) / 400))
        assert got[g["game_id"]]["p_home"] == pytest.approx(want)
        ratings[g["home_id"]], ratings[g["away_id"]] = got[g["game_id"]]["home_rating"], got[g["game_id"]]["away_rating"]
