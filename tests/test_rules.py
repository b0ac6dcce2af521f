"""Rule sets by hand: each case breaks what it says and nothing else."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from contestlab.operators import rules as R
from contestlab.operators.audits import broken_rules

DAY = dt.date(2024, 5, 1)


FIELDS = ("obs_id int, ord int, series_id string, team_id int, season int, observed_at date, source string", "obs_id int, name string, minutes double, games double", "series_id string, season int, team_a int, team_b int, starts date", "season int, team_id int, name string")


def squad(names="ABCDEF", minutes=(40.0,) * 6, games=(5.0,) * 6):
    return list(zip(names, minutes, games))


def test_each_clause_of_a_rotation(spark):
    none = {"series_id": "none"}
    cases = [
        ({}, squad(), []),
        (none, squad(), ["not before the start", "unknown series"]),
        ({"season": 2023}, squad(), ["other season"]),
        ({"team_id": 3}, squad(), ["team not of the series"]),
        ({"observed_at": DAY + dt.timedelta(1)}, squad(), ["not before the start"]),
        ({"observed_at": None}, squad(), ["not before the start"]),
        ({"source": "http://x"}, squad(), ["source not secure"]),
        ({"source": None}, squad(), ["source not secure"]),
        ({}, squad("ABCDE", (48.0,) * 5), ["too few players"]),
        ({}, [], ["minutes don't add up", "too few players"]),
        ({}, squad(minutes=(40.0,) * 5 + (39.0,)), ["minutes don't add up"]),
        ({}, squad("ABCDEZ"), ["player not on the roster"]),
        ({}, squad("ABCDEa"), ["player named twice"]),
        ({}, squad(minutes=(49.0, 31.0) + (40.0,) * 4), ["minutes out of bounds"]),
        *[({}, squad(games=(x,) + (5.0,) * 5), ["games out of bounds"]) for x in (11.0, -1.0, 2.5, None, float("nan"))],
        ({"series_id": "0", "ord": 99}, squad(), ["second of its team"]),
    ]
    obs = [tuple(({"obs_id": i, "ord": i, "series_id": str(i), "team_id": 1, "season": 2024, "observed_at": DAY, "source": "https://x"} | changed).values()) for i, (changed, _, _) in enumerate(cases)]
    players = [(i, *p) for i, (_, listed, _) in enumerate(cases) for p in listed]
    series = [(str(i), 2024, 1, 2, DAY + dt.timedelta(1)) for i in range(len(cases))]
    rosters = [(y, t, n) for y in (2023, 2024) for t in (1, 2, 3) for n in "abcdefg"]
    given = [spark.createDataFrame(rows, schema) for rows, schema in zip((obs, players, series, rosters), FIELDS)]
    rows, clauses = R.rotation_clauses(*given)
    got = sorted(tuple(r) for r in broken_rules(rows, ["obs_id"], clauses).collect())
    assert got == [(i, rule) for i, (_, _, rules) in enumerate(cases) for rule in rules]
    counts = R.rotation_rejections(*given).collect()
    want = [rule for _, _, rules in cases for rule in rules]
    assert {r.clause: r.rejected for r in counts} == {c: want.count(c) for c in clauses}
    assert [r.clause for r in counts if r.largest] == ["games out of bounds"] and {(r.any, r.candidates) for r in counts} == {(len(cases) - 1, len(cases))}


def test_no_observations_reject_nothing(spark):
    got = R.rotation_rejections(*[spark.createDataFrame([], schema) for schema in FIELDS]).collect()
    assert len(got) == 12 and all(r.rejected == r.any == r.candidates == 0 and not r.largest for r in got)


NOW = dt.datetime(2024, 5, 1, 12)
SEAL = {
    "ord": 0, "game": "g", "version": "v", "entry": "morning", "issued": NOW, "starts": NOW + dt.timedelta(hours=5), "report_at": NOW, "no_report": False, "p": 0.5, "reference": 0.5, "incomplete": False, "n_waiting": 0,
    "home_points": 3.0, "away_points": 0.0, "home_unfiled": False, "away_unfiled": False, "home_drivers": [(2.0, "out"), (1.0, "doubtful")], "away_drivers": [],
}
TYPES = (
    "ord int, game string, version string, entry string, issued timestamp, starts timestamp, report_at timestamp, no_report boolean, p double, reference double, incomplete boolean, n_waiting int, home_points double, "
    "away_points double, home_unfiled boolean, away_unfiled boolean, home_drivers array<struct<points: double, status: string>>, away_drivers array<struct<points: double, status: string>>"
)
LACKING = {"no_report": True, "report_at": None, "home_points": 0.0, "home_drivers": []}


def broken(spark, *entries):
    rows = [tuple((SEAL | {"ord": i} | e).values()) for i, e in enumerate(entries)]
    return sorted((r.ord, r.rule) for r in R.seal_rules(spark.createDataFrame(rows, TYPES)).collect())


def test_rules_of_one_seal(spark):
    hour = dt.timedelta(hours=1)
    cases = [
        ({}, []),
        ({"issued": None}, ["invalid time"]),
        ({"issued": NOW + 5 * hour}, ["issued at or after the start"]),
        ({"report_at": NOW + dt.timedelta(microseconds=1)}, ["report after the issue"]),
        ({"p": 1.5}, ["chance out of bounds"]),
        ({"p": float("nan")}, ["chance out of bounds"]),
        ({"incomplete": True}, ["incomplete without a game"]),
        ({"incomplete": True, "n_waiting": 1}, []),
        ({"entry": "final", "starts": NOW + hour}, []),
        ({"entry": "final"}, ["final too early"]),
        ({"reference": None}, ["no reference"]),
        (LACKING, []),
        ({"no_report": True, "report_at": None}, ["report though missing"]),
        (LACKING | {"away_unfiled": True}, ["unfiled without a report"]),
        ({"home_points": 3.5}, ["home drivers don't add up"]),
        ({"home_points": 3.009}, []),
        ({"away_drivers": [(-1.0, "out")], "away_points": -1.0}, ["away drivers out of order", "negative absence"]),
        ({"home_drivers": [(1.0, "out"), (2.0, "out")]}, ["home drivers out of order"]),
        ({"home_drivers": [(3.0, None)]}, ["home driver without status"]),
        ({"home_drivers": [(3.0, None)], "home_unfiled": True}, []),
    ]
    # Each in a game of its own, in one job.
    got = broken(spark, *[e | {"game": str(i)} for i, (e, _) in enumerate(cases)])
    assert got == [(i, rule) for i, (_, rules) in enumerate(cases) for rule in rules]


def test_rules_of_the_order_of_entries(spark):
    final = {"entry": "final", "starts": NOW + dt.timedelta(minutes=30)}
    cases = [
        ([LACKING, {"entry": "reissued"}, final, {"entry": "result"}], []),
        ([{"entry": "result"}, {}], [(0, "result of an unknown game")]),
        ([{}, {"version": "w"}, {}], [(2, "second seal of its kind")]),
        ([{"entry": "missed"}, {"version": "w"}, {"entry": "missed"}, {}], [(2, "second miss"), (3, "sealed after a miss")]),
        ([{}, {"entry": "missed"}], [(1, "missed though sealed")]),
        ([{}, {"entry": "reissued"}], [(1, "reissued without need")]),
        ([LACKING, final, {"entry": "reissued"}], [(2, "reissued after the final")]),
        ([LACKING, LACKING | {"entry": "reissued"}], [(1, "reissued without a report")]),
        ([LACKING, {"entry": "reissued", "starts": NOW + dt.timedelta(hours=1)}], [(1, "reissued too late")]),
    ]
    got = broken(spark, *[e | {"game": str(i), "ord": 10 * i + j} for i, (entries, _) in enumerate(cases) for j, e in enumerate(entries)])
    assert got == [(10 * i + j, rule) for i, (_, rules) in enumerate(cases) for j, rule in rules]


def test_last_qualifying_day(spark):
    d = lambda n: DAY + dt.timedelta(n)
    contests = spark.createDataFrame([(1, 2024, d(5), 1, 2), (2, 2024, d(3), 1, 2), (3, 2024, d(9), 2, 1), (4, 2024, d(9), 1, 3), (5, 2025, d(9), 1, 2)], "contest_id int, season int, day date, home_id int, away_id int")
    told = [(2024, d(3), 1, 0.2), (2024, d(3), 2, 0.6), (2024, d(4), 1, 0.5), (2024, d(4), 2, 0.0), (2024, d(5), 1, 0.5), (2024, d(5), 2, 0.5), (2024, d(6), 1, 0.5), (2024, d(6), 2, None), (2024, d(6), 3, 0.5), (2025, d(9), 1, 0.5), (2025, d(9), 2, 0.5)]
    got = R.last_qualifying(contests, spark.createDataFrame(told, "season int, day date, team_id int, q double"))
    assert {r.contest_id: (r.told, r.p) for r in got.collect()} == {1: (d(3), pytest.approx(0.25)), 2: (None, None), 3: (d(5), 0.5), 4: (d(6), 0.5), 5: (None, None)}


def test_values_before_each_day(spark):
    rows = [("a", 2023, 1, 10, 20), ("a", 2024, 1, 10, 5), ("a", 2024, 1, 10, 5), ("a", 2024, 2, 4, 4), ("b", 2024, 2, 4, 4), ("a", 2026, 1, 1, 1)]
    got = R.values_before(spark.createDataFrame(rows, "athlete_id string, season int, day int, played int, rated int"), 0.5, 5.0, 1.0)
    by = {(r.athlete_id, r.season, r.day): (r.played, r.value) for r in got.collect()}
    assert by == {
        ("a", 2023, 1): (0.0, None), ("b", 2024, 2): (0.0, None), ("a", 2024, 1): (5.0, pytest.approx(15 / 10)), ("a", 2024, 2): (25.0, pytest.approx(25 / 30)),
        ("a", 2026, 1): (24 / 4 + 10 / 8, pytest.approx((14 / 4 + 20 / 8 + 5) / (24 / 4 + 10 / 8 + 5))),
    }
    assert got.where(F.col("value").isNull()).count() == 2


SERIES = {
    "bracket": 1, "series_id": "s", "conference": "East", "round": "First Round", "bracket_order": 1.0, "team_a": "a", "team_b": "b", "wins_required": 4, "wins_a": 4.0, "wins_b": 3.0,
    "home_pattern": list("aabbaba"), "p": 0.5,
}
SERIES_TYPES = "bracket int, series_id string, conference string, round string, bracket_order double, team_a string, team_b string, wins_required int, wins_a double, wins_b double, home_pattern array<string>, p double"


def test_rules_of_a_series(spark):
    teams = spark.createDataFrame([("a", "East"), ("b", "East"), ("w", "West")], "team_id string, conference string")
    finals = {"round": "Finals", "conference": "Finals", "team_b": "w", "home_pattern": list("aawwawa")}
    cases = [
        ({}, []),
        (finals, []),
        (finals | {"conference": "East"}, ["finals outside their conference"]),
        (finals | {"team_b": "b", "home_pattern": list("aabbaba")}, ["finals in one conference"]),
        ({"conference": "Finals"}, ["finals' conference in another round"]),
        ({"wins_required": 5, "home_pattern": list("aabbabaab")}, ["must need three or four wins"]),
        ({"wins_required": 3, "home_pattern": list("aabba"), "wins_a": 3.0, "wins_b": 2.0}, []),
        *[({"bracket_order": x}, ["bracket order not positive"]) for x in (0.0, 1.5, None)],
        ({"team_a": "x", "home_pattern": list("xxbbxbx")}, ["missing team A"]),
        ({"team_b": "x", "home_pattern": list("aaxxaxa"), "p": None}, ["missing team B"]),
        ({"home_pattern": list("aawbaba")}, ["home pattern names another team"]),
        ({"home_pattern": list("aabbab")}, ["home pattern of another length"]),
        ({"wins_a": 2.5}, ["score not whole"]),
        ({"wins_b": -1.0}, ["negative score"]),
        ({"wins_a": 5.0, "wins_b": 1.0}, ["score above the wins needed"]),
        ({"wins_b": 4.0}, ["both have the wins needed", "more games than possible"]),
        *[({"p": x}, ["chance out of bounds"]) for x in (None, 1.01, float("nan"))],
    ]
    rows = [tuple((SERIES | {"series_id": f"{i:02}"} | c).values()) for i, (c, _) in enumerate(cases)]
    got = sorted((int(r.series_id), r.rule, r.level) for r in R.series_rules(spark.createDataFrame(rows, SERIES_TYPES), teams).collect())
    assert got == [(i, rule, "warning" if "length" in rule else "error") for i, (_, rules) in enumerate(cases) for rule in rules]


def test_rounds_of_a_bracket(spark):
    row = lambda **c: tuple((SERIES | c).values())
    whole = [row(bracket_order=float(i)) for i in range(4)]
    rows = whole + [row(conference="West", bracket_order=1.0)] * 2 + [row(conference="West", round="Conference Final")] + [row(conference="Finals", round="Finals")] * 2
    series, conferences = spark.createDataFrame(rows, SERIES_TYPES), spark.createDataFrame([("East",), ("West",)], "conference string")
    got = {(r.conference, r.round): (r.configured, r.repeated, r.complete) for r in R.bracket_coverage(series, conferences).collect()}
    assert got == {
        ("East", "First Round"): (4, False, True), ("East", "Conference Semifinal"): (0, False, True), ("East", "Conference Final"): (0, False, True),
        ("West", "First Round"): (2, True, False), ("West", "Conference Semifinal"): (0, False, True), ("West", "Conference Final"): (1, False, True),
    }
    rules = sorted(tuple(r)[1:] for r in R.bracket_rules(series, conferences).collect())
    assert rules == [("Finals", "Finals", "error", "more than one finals series"), ("West", "First Round", "error", "bracket orders repeated"), ("West", "First Round", "warning", "round not whole")]
    assert R.bracket_rules(series.limit(0), conferences).count() == 0


def test_rules_of_settings_scores_archives_and_finished_series(spark):
    settings = [(1, 0.5, 0.25, 0.25, 2.0, 100.0, 1.0), (2, 0.5, 0.25, 0.0, 2.0, 100.0, 1.0), (3, 1.0, 0.5, 0.25, 2.0, 100.0, 1.0), (4, 0.5, 0.25, 0.25, 6.0, 1.5, 0.0), (5, 0.5, 0.25, 0.25, 2.0, None, None)]
    got = R.settings_rules(spark.createDataFrame(settings, "settings_id int, player_weight double, rating_weight double, elo_weight double, home_advantage double, iterations double, scale double"))
    n, scale, one = "iterations not a positive whole number", "scale not positive", "weights don't add up to one"
    assert sorted((r.settings_id, r.rule) for r in got.collect()) == [(2, one), (3, one), (3, "weights far from one"), (4, "home advantage out of range"), (4, n), (4, scale), (5, n), (5, scale)]

    nan = float("nan")
    scores = [(1, 3.0, 2.0, 1.0, 0.5), (2, 3.001, 2.0, 1.0, 1.0), (3, 3.002, 2.0, 1.0, 1.01), (4, 26.0, 26.0, 0.0, 0.5), (5, 11.0, 0.0, 11.0, 0.5), (6, nan, 1.0, 1.0, None)]
    got = R.score_rules(spark.createDataFrame(scores, "athlete_id int, score double, box double, on_court double, share double"))
    parts, share = "not the sum of its parts", "share out of bounds"
    assert sorted((r.athlete_id, r.rule) for r in got.collect()) == [(3, parts), (3, share), (4, "box value out of bounds"), (4, "score out of bounds"), (5, "on-court value out of bounds"), (6, parts), (6, "score out of bounds"), (6, share)]

    d = lambda n: DAY + dt.timedelta(n)
    records = [(1, 3, 2, 1, 1, d(0), d(1)), (2, 3, 1, 1, 0, d(0), d(1)), (3, 3, 2, 2, 1, d(0), d(1)), (4, 3, 2, 1, 1, d(1), d(1)), (5, 1, 0, 0, 0, None, d(1))]
    got = R.archive_leakage(spark.createDataFrame(records, "id int, number int, included int, wins_a int, wins_b int, snapshot_as_of date, forecast_as_of date"))
    assert sorted(tuple(r) for r in got.collect()) == [(2, "other results included"), (3, "score differs from the results included"), (4, "snapshot not before the forecast")]

    row = lambda i, need=4, winner="a", a=4, b=1, games=5, pattern=5, bubble=False, season=False: (2020, i, need, "a", "b", winner, a, b, games, ["a"] * pattern, bubble, season)
    rows = [row(1), row(2, winner="b"), row(3, winner=None), row(4, b=2), row(5, pattern=4), row(6, bubble=True), row(7, b=4, games=8, pattern=8), row(8, need=3, a=3, b=2), row(9, bubble=True, season=True)]
    got = R.series_anomalies(spark.createDataFrame(rows, "season int, series_id int, wins_required int, team_a string, team_b string, winner string, wins_a int, wins_b int, games int, home_pattern array<string>, bubble boolean, bubble_season boolean"))
    won = "winner without the wins needed"
    assert sorted((r.series_id, r.rule) for r in got.collect()) == [(2, won), (3, won), (4, "wins don't add up to games"), (5, "home pattern of another length"), (6, "bubble flag"), (7, "games out of bounds")]


def test_rules_of_a_projection(spark):
    price = lambda margin: 1 / (1 + math.exp(-margin / 10))
    p = price(4.0 - 3.0 + 1.0)
    clean = {
        "p_home": p, "p_away": 1 - p, "complete": True, "basis": "report", "home_points": 3.0, "home_named": 3.0, "home_least": 1.0, "home_unfiled": False, "home_tired": True,
        "away_points": 1.0, "away_named": 1.0, "away_least": None, "away_unfiled": False, "away_tired": False,
    }
    off = "not from the ratings and absences"
    cases = [
        ({}, True, []),
        ({"p_home": 1.0, "p_away": 0.0}, True, ["chance not between 0 and 1", off]),
        ({"p_home": None}, True, ["chance not between 0 and 1", "chances don't add up to one", off]),
        ({"p_away": 1 - p + 1e-8}, True, ["chances don't add up to one"]),
        ({"p_home": price(5.0), "p_away": 1 - price(5.0), "away_points": -2.0, "away_named": -2.0, "home_points": -3.0, "home_named": -3.0}, True, ["negative absence"]),
        ({"complete": None}, True, ["drivers not complete"]),
        ({"basis": "current", "home_unfiled": True}, True, ["unfiled without a report"]),
        ({"home_unfiled": True}, True, []),
        ({}, None, ["not a game"]),
        ({}, False, ["not due"]),
        ({"home_tired": False}, True, ["rest differs from the schedule"]),
        ({"p_home": p + 2e-6, "p_away": 1 - p - 2e-6}, True, [off]),
        ({"home_named": 3.02}, True, ["home drivers don't add up"]),
        ({"away_named": 1.009, "away_least": -0.1}, True, ["negative away driver"]),
    ]
    schema = "game_id int, p_home double, p_away double, complete boolean, basis string, " + ", ".join(f"{n}_points double, {n}_named double, {n}_least double, {n}_unfiled boolean, {n}_tired boolean" for n in ("home", "away"))
    projections = spark.createDataFrame([(i, *(clean | c).values()) for i, (c, _, _) in enumerate(cases)], schema)
    games = [(i, due, 4.0, True, False) for i, (_, due, _) in enumerate(cases) if due is not None] + [(98, False, 4.0, True, False), (99, True, 4.0, True, False)]
    got = R.projection_rules(projections, spark.createDataFrame(games, "game_id int, due boolean, gap double, home_tired boolean, away_tired boolean"), 10.0)
    want = [(i, rule) for i, (_, _, rules) in enumerate(cases) for rule in rules] + [(99, "no projection")]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
