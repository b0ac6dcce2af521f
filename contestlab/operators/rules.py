"""Rule sets over whole records: rotation observations, sealed forecasts, series; and what was known before a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.operators.audits import broken_rules, clause_counts
from contestlab.operators.temporal import as_of

# The bounds of a rotation and of a sealed forecast.
LEAST_PLAYERS, TEAM_MINUTES, MOST_MINUTES, MOST_GAMES = 6, 240, 48, 10
MINUTES_TOLERANCE, SUM_TOLERANCE = 1e-6, 0.01
SEALS = ("morning", "reissued", "final")


def outside(value: Column, low: float, high: float) -> Column:
    """True unless value lies in [low, high]; null and NaN lie outside."""
    return ~F.coalesce(value.between(low, high), F.lit(False))


def rotation_clauses(observations: DataFrame, players: DataFrame, series: DataFrame, rosters: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The observations with what is known of each, and the twelve clauses that reject one, as conditions over that.

    observations(obs_id, ord, series_id, team_id, season, observed_at, source), obs_id unique; players(obs_id, name,
    minutes, games); series(series_id, season, team_a, team_b, starts), series_id unique; rosters(season, team_id, name).
    Names are compared without case. Squads are aggregated before they meet their observation, so no list is built; a
    team's later observation of a series is the duplicate."""
    lower = F.lower("name").alias("name")
    named = players.select("obs_id", lower, "minutes", "games").join(observations.select("obs_id", "season", "team_id"), "obs_id")
    on = named.join(rosters.select("season", "team_id", lower).distinct().withColumn("_on", F.lit(1)), ["season", "team_id", "name"], "left")
    broken_games = outside(F.col("games"), 0, MOST_GAMES) | (F.col("games") != F.floor("games"))
    squads = on.groupBy("obs_id").agg(
        F.count("*").alias("n"), F.sum("minutes").alias("total"), F.count_distinct("name").alias("names"), F.max(F.col("_on").isNull()).alias("strangers"),
        F.max(outside(F.col("minutes"), 0, MOST_MINUTES)).alias("odd_minutes"), F.max(broken_games).alias("odd_games"),
    )
    again = F.row_number().over(Window.partitionBy("series_id", "team_id").orderBy("ord")) > 1
    told = series.select("series_id", F.col("season").alias("_season"), "team_a", "team_b", "starts", F.lit(True).alias("_known"))
    rows = observations.withColumn("again", again).join(squads, "obs_id", "left").join(told, "series_id", "left")
    known = F.col("_known").isNotNull()
    n = F.coalesce("n", F.lit(0))
    return rows, {
        "second of its team": F.col("again"),
        "unknown series": ~known,
        "other season": known & (F.col("season") != F.col("_season")),
        "team not of the series": known & ~F.col("team_id").isin(F.col("team_a"), F.col("team_b")),
        "not before the start": ~F.coalesce(F.col("observed_at") < F.col("starts"), F.lit(False)),
        "source not secure": ~F.coalesce(F.col("source").startswith("https://"), F.lit(False)),
        "too few players": n < LEAST_PLAYERS,
        "minutes don't add up": F.abs(F.coalesce("total", F.lit(0)) - TEAM_MINUTES) > MINUTES_TOLERANCE,
        "player not on the roster": F.col("strangers"),
        "player named twice": F.col("names") < n,
        "minutes out of bounds": F.col("odd_minutes"),
        "games out of bounds": F.col("odd_games"),
    }


def rotation_rejections(observations: DataFrame, players: DataFrame, series: DataFrame, rosters: DataFrame) -> DataFrame:
    """(place, clause, rejected, alone, any, candidates, largest): how many observed rotations each clause rejects, how
    many it alone rejects, how many any does, and whether it rejects the most (the first of equals; none where nothing
    is rejected)."""
    counts = clause_counts(*rotation_clauses(observations, players, series, rosters))
    # Twelve rows, whatever the input.
    all_clauses = Window.partitionBy(F.lit(0))
    most = F.max(F.struct("rejected", (-F.col("place")).alias("p"))).over(all_clauses)
    placed = counts.select("place", "clause", "rejected", "alone", "any", "candidates")
    return placed.withColumn("most", most).withColumn("largest", (F.col("most.rejected") > 0) & (F.col("most.p") == -F.col("place"))).drop("most")


def seal_rules(ledger: DataFrame, last: Column | None = None) -> DataFrame:
    """(game, version, ord, rule): every rule that an entry of an append-only ledger breaks.

    ledger(ord, game, version, entry, issued, starts, report_at, no_report, p, reference, incomplete, n_waiting, and for
    home and away: <side>_points, <side>_unfiled, <side>_drivers array of (points, status)). An entry is one of SEALS, `missed`
    or `result`; a version holds one seal of a kind for a game and not both seals and misses. last: how long before the
    start a final seal may be made and a reissued one no more (an hour). What came before is known from two windows
    over the game's entries, so a ledger of any length is looked at in one pass per game."""
    last = F.make_dt_interval(hours=F.lit(1)) if last is None else last
    before = (Window.unboundedPreceding, -1)
    versions = Window.partitionBy("game", "version").orderBy("ord").rowsBetween(*before)
    games = Window.partitionBy("game").orderBy("ord").rowsBetween(*before)
    seen = lambda what, w=versions: F.coalesce(F.max(what).over(w), F.lit(False))
    entry = F.col("entry")
    seal, missed, result, reissued = entry.isin(*SEALS), entry == "missed", entry == "result", entry == "reissued"
    rows = ledger.withColumns({
        "_named": seen(entry != "result", games), "_missed": seen(missed), "_sealed": seen(seal), "_final": seen(entry == "final"),
        "_lacked": seen((entry == "morning") & F.col("no_report")),
        "_again": F.lag("ord").over(Window.partitionBy("game", "version", "entry").orderBy("ord")).isNotNull(),
    })
    late = F.col("starts") <= F.col("issued") + last
    no_report = F.col("no_report") | F.col("report_at").isNull()
    rules = {
        "invalid time": F.col("issued").isNull() | (~result & F.col("starts").isNull()),
        "result of an unknown game": result & ~F.col("_named"),
        "second miss": missed & F.col("_again"),
        "missed though sealed": missed & F.col("_sealed"),
        "second seal of its kind": seal & F.col("_again"),
        "sealed after a miss": seal & F.col("_missed"),
        "issued at or after the start": seal & (F.col("issued") >= F.col("starts")),
        "report after the issue": seal & (F.col("report_at") > F.col("issued")),
        "chance out of bounds": seal & outside(F.col("p"), 0, 1),
        "incomplete without a game": seal & F.col("incomplete") & (F.col("n_waiting") == 0),
        "final too early": (entry == "final") & ~late,
        "reissued too late": reissued & late,
        "reissued without need": reissued & ~F.col("_lacked"),
        "reissued after the final": reissued & F.col("_final"),
        "reissued without a report": reissued & no_report,
        "no reference": seal & outside(F.col("reference"), 0, 1),
        "negative absence": seal & ~F.coalesce((F.col("home_points") >= 0) & (F.col("away_points") >= 0), F.lit(False)),
        "report though missing": seal & F.col("no_report") & ((F.col("home_points") != 0) | (F.col("away_points") != 0) | F.col("report_at").isNotNull()),
        "unfiled without a report": seal & (F.col("home_unfiled") | F.col("away_unfiled")) & no_report,
    }
    for side in ("home", "away"):
        drivers = F.col(f"{side}_drivers")
        points = F.transform(drivers, lambda x: x["points"])
        total = F.aggregate(points, F.lit(0.0), lambda a, x: a + x)
        rules |= {
            f"{side} drivers don't add up": seal & (F.abs(total - F.col(f"{side}_points")) > SUM_TOLERANCE),
            f"{side} drivers out of order": seal & ((F.sort_array(points, asc=False) != points) | F.exists(points, lambda x: x < 0)),
            f"{side} driver without status": seal & ~F.col(f"{side}_unfiled") & F.exists(drivers, lambda x: x["status"].isNull()),
        }
    return broken_rules(rows, ["game", "version", "ord"], rules)


def last_qualifying(contests: DataFrame, forecasts: DataFrame) -> DataFrame:
    """(contest_id, told, p): for each contest the last day strictly before it on which both sides have a positive
    chance, and the home side's share of the two; contests without such a day have nulls.

    contests(contest_id, season, day, home_id, away_id); forecasts(season, day, team_id, q), one for a team and day. Days
    are joined once for each pair that meets in the season, not for each contest, and contests then look back as of the
    day before theirs."""
    q = forecasts.where("q > 0")
    pairs = contests.select("season", "home_id", "away_id").distinct()
    side = lambda name: q.select("season", "day", F.col("team_id").alias(f"{name}_id"), F.col("q").alias(f"q_{name}"))
    both = pairs.join(side("home"), ["season", "home_id"]).join(side("away"), ["season", "away_id", "day"])
    known = both.select("season", "home_id", "away_id", "day", F.col("day").alias("told"), (F.col("q_home") / (F.col("q_home") + F.col("q_away"))).alias("p"))
    asked = contests.select("contest_id", "season", "home_id", "away_id", F.date_sub("day", 1).alias("day"))
    return as_of(asked, known, ["season", "home_id", "away_id"], "day", ["told", "p"], "told").select("contest_id", "told", "p")


def values_before(rows: DataFrame, decay: float, weight: float, prior: float) -> DataFrame:
    """(athlete_id, season, day, played, value): each athlete's value as it stood before each day on which they play.

    rows(athlete_id, season, day, played, rated): the amount played, and amount times rating. The current season counts
    up to the day before, earlier seasons by decay to the power of their age, and all is shrunk to the prior with
    `weight`; null where nothing came before. Seasons of one athlete are few, so their sums are carried as a list."""
    days = rows.groupBy("athlete_id", "season", "day").agg(F.sum("played").alias("d"), F.sum("rated").alias("r"))
    before = Window.partitionBy("athlete_id", "season").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    current = days.select("athlete_id", "season", "day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("d", "r")])
    earlier = Window.partitionBy("athlete_id").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    seasons = days.groupBy("athlete_id", "season").agg(F.sum("d").alias("d"), F.sum("r").alias("r"))
    past = seasons.select("athlete_id", "season", F.collect_list(F.struct("season", "d", "r")).over(earlier).alias("past"))
    aged = lambda c: F.aggregate("past", F.lit(0.0), lambda a, x: a + x[c] * F.pow(F.lit(decay), F.col("season") - x["season"]))
    summed = past.select("athlete_id", "season", aged("d").alias("past_d"), aged("r").alias("past_r"))
    met = current.join(summed, ["athlete_id", "season"]).withColumn("played", F.col("d") + F.col("past_d"))
    value = F.when(F.col("played") > 0, (F.col("r") + F.col("past_r") + weight * prior) / (F.col("played") + weight))
    return met.select("athlete_id", "season", "day", "played", value.alias("value"))


# How many series a round of a conference holds, how long a series is, and the bounds of settings.
ROUNDS = {"First Round": 4, "Conference Semifinal": 2, "Conference Final": 1}
FINALS, FINALS_CONFERENCE = "Finals", "Finals"
WINS_REQUIRED = (3, 4)
WEIGHTS, WEIGHT_SLACK, HOME_ADVANTAGE = (0.5, 1.5), 0.15, (0, 5)


def _levelled(rows: DataFrame, keys: list[str], errors: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """broken_rules() of both in one pass, with the level before the rule."""
    level = F.when(F.col("rule").isin(*warnings), "warning").otherwise("error").alias("level")
    return broken_rules(rows, keys, errors | warnings).select(*keys, level, "rule")


def most_games(wins_required: Column) -> Column:
    return wins_required * 2 - 1


def series_rules(series: DataFrame, teams: DataFrame) -> DataFrame:
    """(bracket, series_id, level, rule): what is wrong with each configured series by itself, as errors or warnings.

    series(bracket, series_id, conference, round, bracket_order, team_a, team_b, wins_required, wins_a, wins_b,
    home_pattern, p); teams(team_id, conference), small: joined for either side. Fields are whole numbers or doubles;
    a null number breaks its rule; home_pattern is bounded by a series' length."""
    of = lambda side: teams.select(F.col("team_id").alias(f"team_{side}"), F.lit(True).alias(f"_{side}"), F.col("conference").alias(f"_conference_{side}"))
    rows = series.join(of("a"), "team_a", "left").join(of("b"), "team_b", "left")
    need, a, b = F.col("wins_required"), F.col("wins_a"), F.col("wins_b")
    last = F.col("round") == FINALS
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    whole = lambda x: F.coalesce(x == F.floor(x), F.lit(False))
    errors = {
        "must need three or four wins": ~F.coalesce(need.isin(*WINS_REQUIRED), F.lit(False)),
        "finals outside their conference": last & (F.col("conference") != FINALS_CONFERENCE),
        "finals' conference in another round": ~last & (F.col("conference") == FINALS_CONFERENCE),
        "bracket order not positive": ~(whole(F.col("bracket_order")) & (F.col("bracket_order") > 0)),
        "missing team A": F.col("_a").isNull(),
        "missing team B": F.col("_b").isNull(),
        "home pattern names another team": F.exists("home_pattern", lambda x: (x != F.col("team_a")) & (x != F.col("team_b"))),
        "score not whole": ~(whole(a) & whole(b)),
        "negative score": (a < 0) | (b < 0),
        "score above the wins needed": (a > need) | (b > need),
        "both have the wins needed": (a == need) & (b == need),
        "more games than possible": a + b > most_games(need),
        "finals in one conference": last & known & (F.col("_conference_a") == F.col("_conference_b")),
        "chance out of bounds": known & outside(F.col("p"), 0, 1),
    }
    warnings = {"home pattern of another length": F.size("home_pattern") != most_games(need)}
    return _levelled(rows, ["bracket", "series_id"], errors, warnings)


def bracket_coverage(series: DataFrame, conferences: DataFrame) -> DataFrame:
    """(bracket, conference, round, configured, expected, repeated, complete) for every bracket, conference and round.

    A first round must be whole; later rounds may be empty. repeated: some of its bracket orders are equal. The frame of
    brackets, conferences(conference) and rounds is laid out first, so empty rounds have their row: conferences are few."""
    frame = series.select("bracket").distinct().join(F.broadcast(conferences.select("conference").distinct()))
    rounds = F.explode(F.array(*[F.struct(F.lit(n).alias("round"), F.lit(k).alias("expected")) for n, k in ROUNDS.items()])).alias("r")
    frame = frame.select("bracket", "conference", rounds).select("bracket", "conference", "r.*")
    held = series.groupBy("bracket", "conference", "round").agg(F.count("*").alias("configured"), (F.count("bracket_order") > F.count_distinct("bracket_order")).alias("repeated"))
    met = frame.join(held, ["bracket", "conference", "round"], "left").na.fill({"configured": 0, "repeated": False})
    complete = (F.col("configured") == F.col("expected")) | ((F.col("configured") == 0) & (F.col("round") != next(iter(ROUNDS))))
    return met.select("bracket", "conference", "round", "configured", "expected", "repeated", complete.alias("complete"))


def bracket_rules(series: DataFrame, conferences: DataFrame) -> DataFrame:
    """(bracket, conference, round, level, rule): what is wrong with brackets as wholes."""
    covered = bracket_coverage(series, conferences)
    rounds = _levelled(covered, ["bracket", "conference", "round"], {"bracket orders repeated": F.col("repeated")}, {"round not whole": ~F.col("complete")})
    finals = series.where(F.col("round") == FINALS).groupBy("bracket").agg(F.count("*").alias("n")).where("n > 1")
    many = finals.select("bracket", F.lit(FINALS_CONFERENCE).alias("conference"), F.lit(FINALS).alias("round"), F.lit("error").alias("level"), F.lit("more than one finals series").alias("rule"))
    return rounds.unionByName(many)


def settings_rules(settings: DataFrame) -> DataFrame:
    """(settings_id, level, rule) of settings(settings_id, player_weight, rating_weight, elo_weight, home_advantage,
    iterations, scale); nulls break their rule."""
    total = F.col("player_weight") + F.col("rating_weight") + F.col("elo_weight")
    n = F.col("iterations")
    errors = {
        "weights far from one": outside(total, *WEIGHTS),
        "iterations not a positive whole number": ~F.coalesce((n == F.floor(n)) & (n > 0), F.lit(False)),
        "scale not positive": ~F.coalesce(F.col("scale") > 0, F.lit(False)),
    }
    warnings = {"weights don't add up to one": F.abs(total - 1) > WEIGHT_SLACK, "home advantage out of range": outside(F.col("home_advantage"), *HOME_ADVANTAGE)}
    return _levelled(settings, ["settings_id"], errors, warnings)


def series_anomalies(series: DataFrame) -> DataFrame:
    """(season, series_id, rule) of finished series(season, series_id, wins_required, team_a, team_b, winner, wins_a,
    wins_b, games, home_pattern, bubble, bubble_season)."""
    need, a, b = F.col("wins_required"), F.col("wins_a"), F.col("wins_b")
    won = F.when(F.col("winner") == F.col("team_a"), a).when(F.col("winner") == F.col("team_b"), b)
    return broken_rules(series, ["season", "series_id"], {
        "games out of bounds": ~F.coalesce(F.col("games").between(need, most_games(need)), F.lit(False)),
        "winner without the wins needed": ~F.coalesce(won == need, F.lit(False)),
        "wins don't add up to games": a + b != F.col("games"),
        "home pattern of another length": F.size("home_pattern") != F.col("games"),
        "bubble flag": F.col("bubble") != F.col("bubble_season"),
    })


def archive_leakage(records: DataFrame) -> DataFrame:
    """(id, rule) of records(id, number, included, wins_a, wins_b, snapshot_as_of, forecast_as_of): forecasts that may know
    more or less than the contests before theirs."""
    return broken_rules(records, ["id"], {
        "other results included": F.col("included") != F.col("number") - 1,
        "score differs from the results included": F.col("wins_a") + F.col("wins_b") != F.col("included"),
        "snapshot not before the forecast": F.col("snapshot_as_of") >= F.col("forecast_as_of"),
    })


SCORE_BOUND, ON_COURT_BOUND, PARTS_TOLERANCE = 25, 10, 0.0011  # points per 100 possessions; three decimals of three numbers


def score_rules(scores: DataFrame) -> DataFrame:
    """(athlete_id, rule) of published scores(athlete_id, score, box, on_court, share); nulls and NaN break their rule."""
    off = F.abs(F.col("score") - (F.col("box") + F.col("on_court")))
    return broken_rules(scores, ["athlete_id"], {
        "score out of bounds": outside(F.col("score"), -SCORE_BOUND, SCORE_BOUND),
        "box value out of bounds": outside(F.col("box"), -SCORE_BOUND, SCORE_BOUND),
        "on-court value out of bounds": outside(F.col("on_court"), -ON_COURT_BOUND, ON_COURT_BOUND),
        "not the sum of its parts": outside(off, 0, PARTS_TOLERANCE),
        "share out of bounds": outside(F.col("share"), 0, 1),
    })


CHANCE_TOLERANCE, PRICE_TOLERANCE = 1e-9, 1e-6


def projection_rules(projections: DataFrame, games: DataFrame, scale: float) -> DataFrame:
    """(game_id, rule): projections that don't follow from the ratings, absences and schedule they name, and due games
    without one.

    projections(game_id, p_home, p_away, complete, basis, and for home and away: <side>_points, <side>_named (the sum of the
    drivers' points), <side>_least (of the drivers; null for none), <side>_unfiled, <side>_tired); games(game_id, due, gap,
    and the same <side>_tired), gap the expected margin of healthy sides."""
    told = games.select("game_id", "due", "gap", *[F.col(f"{n}_tired").alias(f"_{n}_tired") for n in ("home", "away")])
    rows = projections.join(told, "game_id", "left")
    p, home, away, gap = (F.col(n) for n in ("p_home", "home_points", "away_points", "gap"))
    known = gap.isNotNull()
    priced = lambda margin: 1.0 / (1.0 + F.exp(-margin / scale))
    inside = lambda x: F.coalesce((x > 0) & (x < 1), F.lit(False))
    rules = {
        "chance not between 0 and 1": ~(inside(p) & inside(F.col("p_away"))),
        "chances don't add up to one": outside(p + F.col("p_away") - 1, -CHANCE_TOLERANCE, CHANCE_TOLERANCE),
        "negative absence": ~F.coalesce((home >= 0) & (away >= 0), F.lit(False)),
        "drivers not complete": ~F.coalesce("complete", F.lit(False)),
        "unfiled without a report": (F.col("basis") == "current") & (F.col("home_unfiled") | F.col("away_unfiled")),
        "not a game": F.col("due").isNull(),
        "not due": ~F.col("due"),
        "rest differs from the schedule": (F.col("home_tired") != F.col("_home_tired")) | (F.col("away_tired") != F.col("_away_tired")),
        "not from the ratings and absences": known & outside(priced(gap - home + away) - p, -PRICE_TOLERANCE, PRICE_TOLERANCE),
        "absences don't lower the chance": known & (((home > 0) & ~(priced(gap - home) < priced(gap))) | ((away > 0) & ~(priced(gap + away) > priced(gap)))),
    }
    for side in ("home", "away"):
        rules[f"{side} drivers don't add up"] = outside(F.col(f"{side}_named") - F.col(f"{side}_points"), -SUM_TOLERANCE, SUM_TOLERANCE)
        rules[f"negative {side} driver"] = F.col(f"{side}_least") < 0
    missing = games.where("due").select("game_id").join(projections.select("game_id"), "game_id", "left_anti")
    return broken_rules(rows, ["game_id"], rules).unionByName(missing.withColumn("rule", F.lit("no projection")))
