"""Scores, odds and margins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column, digits: int = 6) -> Column:
    """Half up, the same in every engine."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / F.lit(scale)


def clamp(p: Column, floor: float) -> Column:
    """p kept within [floor, 1 - floor]; NaN counts as one half."""
    return F.least(F.lit(1.0 - floor), F.greatest(F.lit(floor), F.nanvl(p, F.lit(0.5))))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column, floor: float = 1e-7) -> Column:
    q = clamp(p, floor)
    return F.avg(-F.when(y == 1, F.ln(q)).otherwise(F.ln(1.0 - q)))


def accuracy(p: Column, y: Column, half: bool = True) -> Column:
    """Share of outcomes on the favoured side; an even forecast earns half if `half`."""
    right = ((p > 0.5) == (y == 1)).cast("double")
    return F.avg(F.when(p == 0.5, F.lit(0.5)).otherwise(right) if half else right)


def implied_probability(moneyline: Column) -> Column:
    """American odds as a probability; null for odds between -100 and 100."""
    m = moneyline.cast("double")
    return F.when(F.abs(m) < 100, F.lit(None)).when(m < 0, -m / (100.0 - m)).otherwise(100.0 / (m + 100.0))


def without_margin(home: Column, away: Column) -> Column:
    """The home side's share of two implied probabilities."""
    return F.try_divide(home, home + away)


def logistic(margin: Column, scale: float) -> Column:
    return 1.0 / (1.0 + F.exp(-margin / scale))


def expected_score(difference: Column) -> Column:
    """The expected score of an Elo difference."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -difference / 400.0))


def game_score(points, fgm, fga, ftm, fta, orb, drb, stl, ast, blk, pf, tov) -> Column:
    """The box score's one-number summary of an appearance."""
    return points + 0.4 * fgm - 0.7 * fga - 0.4 * (fta - ftm) + 0.7 * orb + 0.3 * drb + stl + 0.7 * ast + 0.7 * blk - 0.4 * pf - tov


# The rational approximation of the normal tail by Hart, in West's form.
TAIL_NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_SPLIT, TAIL_SCALE = 7.07106781186547, 2.506628274631


def _horner(z: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * z + F.lit(f)
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, to double precision in the centre."""
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    fraction = z + 1.0 / (z + 2.0 / (z + 3.0 / (z + 4.0 / (z + 0.65))))
    tail = F.when(z > 37, F.lit(0.0)).when(z < TAIL_SPLIT, e * _horner(z, TAIL_NUMERATOR) / _horner(z, TAIL_DENOMINATOR)).otherwise(e / fraction / F.lit(TAIL_SCALE))
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    """The same in SQL."""
    z = f"abs({x})"

    def horner(factors):
        out = f"{factors[0]!r}::DOUBLE"
        for f in factors[1:]:
            out = f"({out} * {z} + {f!r}::DOUBLE)"
        return out

    e = f"exp(-{z} * {z} / 2)"
    tail = (
        f"(CASE WHEN {z} > 37 THEN 0.0::DOUBLE WHEN {z} < {TAIL_SPLIT!r}::DOUBLE THEN {e} * {horner(TAIL_NUMERATOR)} / {horner(TAIL_DENOMINATOR)} "
        f"ELSE {e} / ({z} + 1.0::DOUBLE / ({z} + 2.0::DOUBLE / ({z} + 3.0::DOUBLE / ({z} + 4.0::DOUBLE / ({z} + 0.65::DOUBLE))))) / {TAIL_SCALE!r}::DOUBLE END)"
    )
    return f"(CASE WHEN {x} > 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END)"


def rnd_sql(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * {10.0**digits!r}::DOUBLE + 0.5::DOUBLE) / {10.0**digits!r}::DOUBLE)"


def in_game_probability(lead: Column, seconds_left: Column, pregame_margin: Column, length: float = 2880.0, sd: float = 18.0, floor: float = 0.005) -> Column:
    """The leader's chance when margins move as a Brownian motion towards the pregame margin."""
    f = F.greatest(seconds_left / length, F.lit(1.0 / 48.0))
    return F.least(F.lit(1.0 - floor), F.greatest(F.lit(floor), normal_cdf((lead + pregame_margin * f) / (F.lit(sd) * F.sqrt(f)))))
