"""Fields of outside payloads and small laws of the game, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a payload's status names map to ours; anything else is taken for scheduled.
STATUSES = {"STATUS_FINAL": "final", "STATUS_IN_PROGRESS": "in-progress", "STATUS_HALFTIME": "in-progress", "STATUS_END_PERIOD": "in-progress", "STATUS_POSTPONED": "postponed", "STATUS_CANCELED": "canceled"}
# Positions as numbers from guard to centre.
POSITIONS = {"PG": 1.0, "SG": 2.0, "G": 1.5, "SF": 3.0, "GF": 2.5, "F": 3.5, "PF": 4.0, "FC": 4.5, "C": 5.0}


def named(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def status(name: Column) -> Column:
    return F.coalesce(named(STATUSES, name), F.lit("scheduled"))


def clock_seconds(text: Column) -> Column:
    """'M:SS' or 'S.s' as whole seconds; null for anything else."""
    minutes = F.when(text.rlike(r"^[0-9]{1,2}:[0-9]{2}$"), F.split_part(text, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(text, F.lit(":"), F.lit(2)).try_cast("int"))
    return F.coalesce(minutes, F.when(text.rlike(r"^[0-9]{1,2}(\.[0-9])?$"), F.floor(text.try_cast("double")).cast("int")))


def seconds_left(period: Column, clock: Column, periods: int = 4, length: int = 720) -> Column:
    """Seconds of regulation left; in overtime those of the running one."""
    return F.when(period > periods, clock).otherwise((periods - period) * length + clock)


def made_attempted(text: Column) -> Column:
    """'m-a' as a struct of two numbers; null for anything else or more made than attempted."""
    m, a = (F.split_part(text, F.lit("-"), F.lit(i)).try_cast("int") for i in (1, 2))
    return F.when(text.rlike("^[0-9]+-[0-9]+$") & (m <= a), F.struct(m.alias("made"), a.alias("attempted")))


def round_of(note: Column) -> Column:
    """The round that a note's headline names: 1 to 4, null for none. A conference's semifinals are not the finals."""
    text = F.lower(note)
    return F.when(text.contains("conference finals") | text.contains("conf. finals"), 3).when(text.contains("semifinals"), 2).when(text.contains("first round") | text.contains("1st round"), 1).when(text.contains("finals"), 4)


def conference_of(note: Column) -> Column:
    return F.when(note.rlike(r"(?i)\beast"), "East").when(note.rlike(r"(?i)\bwest"), "West")


def season_label(year: Column) -> Column:
    """2024 as '2023-24'."""
    return F.concat((year - 1).cast("string"), F.lit("-"), F.lpad((year % 100).cast("string"), 2, "0"))


def home_pattern(games: Column, pattern: str = "HHAAHAH") -> Column:
    """Who is at home in each game of a series of so many; inverted for the lesser seed by home_inverse."""
    return F.substring(F.lit(pattern), F.lit(1), games)


def home_inverse(pattern: Column) -> Column:
    return F.translate(pattern, "HA", "AH")


def percent_pair(p: Column) -> Column:
    """A chance and its complement in whole percent that add up to 100, both at least 1."""
    first = F.least(F.lit(99), F.greatest(F.lit(1), F.floor(p * 100 + 0.5).cast("int")))
    return F.struct(first.alias("first"), (100 - first).alias("second"))


def percent_text(p: Column) -> Column:
    return F.when((p > 0) & (p < 0.01), "<1%").when((p > 0.99) & (p < 1), ">99%").otherwise(F.concat(F.floor(p * 100 + 0.5).cast("int").cast("string"), F.lit("%")))


def signed(points: Column) -> Column:
    """Points with a sign and one decimal; a value that rounds to nothing is 'even'."""
    tenth = F.floor(F.abs(points) * 10 + 0.5).cast("long")
    text = F.concat(F.floor(tenth / 10).cast("string"), F.lit("."), (tenth % 10).cast("string"))
    return F.when(tenth == 0, "even").otherwise(F.concat(F.when(points < 0, "-").otherwise("+"), text))


def ordinal(n: Column) -> Column:
    teen = (n % 100 >= 11) & (n % 100 <= 13)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def position_number(text: Column) -> Column:
    """1 (guard) to 5 (centre); the mean of several; null for an unknown one."""
    parts = F.transform(F.split(F.upper(text), "[-/]"), lambda p: named(POSITIONS, F.trim(p)))
    known = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def shrink(gap: Column, scale: float) -> Column:
    """How much of a correction is left at so large a gap of two ratings."""
    return F.exp(-F.abs(gap) / scale)


def challenger(p: Column, seed_gap: Column, a: float, b: float, c: float, floor: float = 1e-6) -> Column:
    """A recalibrated chance: logistic in the chance's log-odds and the seeds' difference."""
    q = F.least(F.lit(1 - floor), F.greatest(F.lit(floor), p))
    return 1.0 / (1.0 + F.exp(-(a + b * F.ln(q / (1 - q)) + c * seed_gap)))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII text, as a long."""
    # The hash's offset and prime.
    step = lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("long")) * 16777619) % 4294967296
    return F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), step)


def local_time(instant: Column, zone: str = "America/New_York") -> Column:
    """The wall clock of a UTC instant (without zone, both)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant)


def utc_instant(wall: Column, zone: str = "America/New_York") -> Column:
    """The UTC instant of a wall clock; of an hour that comes twice, the later one."""
    first = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    later = first + F.expr("INTERVAL 1 HOUR")
    return F.when(local_time(later, zone) == wall, later).otherwise(first)


def is_instant(text: Column) -> Column:
    """Whether a text is a UTC instant with real calendar fields, to the second."""
    read = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$") & (F.coalesce(F.date_format(read, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")) == text)


def absence_class(reason: Column) -> Column:
    """What kind of absence a reason's words tell of."""
    text = F.lower(reason)
    has = lambda *stems: F.exists(F.array(*[F.lit(x) for x in stems]), lambda x: text.contains(x))
    return F.when(has("g league", "two-way", "assignment"), "league").when(has("rest", "load"), "rest").when(has("injur", "sprain", "sore", "strain", "surg"), "injury").when(has("illness", "protocol"), "illness").otherwise("other")


def sentence(text: Column, acronyms: tuple[str, ...] = ("ACL", "MCL", "NBA")) -> Column:
    """Blanks and separators merged, lower case with a capital at the start, known acronyms kept."""
    words = F.split(F.trim(F.regexp_replace(text, r"[\s;_]+", " ")), " ")
    cased = F.transform(words, lambda w, i: F.when(F.upper(w).isin(*acronyms), F.upper(w)).when(i == 0, F.initcap(w)).otherwise(F.lower(w)))
    return F.array_join(cased, " ")


def team_strength(net: Column, elo: Column, players: Column, weights: tuple[float, float, float]) -> Column:
    """Points above average: net rating, Elo as points, and the players' values weighted by available minutes of 240."""
    talent = F.aggregate(F.transform(players, lambda p: p["impact"] * p["minutes"] * p["available"]), F.lit(0.0), lambda a, x: a + x) / 240.0
    return weights[0] * net + weights[1] * (elo - 1500) / 35.0 + weights[2] * talent


def combinations(n: Column, k: int) -> Column:
    """C(n, k) as a long."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1).cast("long"), lambda a, i: F.floor(a * (n - k + i) / i).cast("long"))


def possessions(fga: Column, orb: Column, tov: Column, fta: Column) -> Column:
    return fga - orb + tov + 0.44 * fta


def report_name(at: Column, prefix: str = "report") -> Column:
    """The file name of a report on the quarter of an hour."""
    return F.concat(F.lit(prefix + "_"), F.date_format(at, "yyyy-MM-dd_hh_mma"), F.lit(".pdf"))
