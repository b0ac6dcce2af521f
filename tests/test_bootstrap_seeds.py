"""Bootstrap counts against digests by hand, folds, and the tie-break against a recursive version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from contestlab.operators import evaluation as E
from contestlab.operators import seeding as S


def poisson(seed, cluster, draw):
    u = int(hashlib.md5(f"{seed}:{cluster}:{draw // 4}".encode()).hexdigest()[8 * (draw % 4) :][:8], 16) / 2**32
    return sum(u >= p for p in E.POISSON)


def test_draws_equal_the_digests_for_any_number_of_clusters(spark):
    rng = random.Random(1)
    rows = [(i % 150, rng.random(), rng.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "c int, e double, o double")
    got = {r.draw: r.s for r in E.bootstrap_sums(df, "c", {"s": F.col("e")}, draws=30, seed=5).collect()}
    sums = {c: sum(e for k, e, _ in rows if k == c) for c in range(150)}
    assert got == {d: pytest.approx(sum(poisson(5, c, d) * v for c, v in sums.items())) for d in range(30)}
    r = E.ratio_bootstrap(df, "c", "e", "o", draws=200).first()
    assert r.low < r.ratio < r.high and r.low < r.median < r.high
    assert sum(poisson(5, c, d) for c in range(150) for d in range(100)) == pytest.approx(15_000, rel=0.03)


def test_folds_are_even_and_depend_on_the_set_alone(spark):
    df = spark.createDataFrame([(i // 2,) for i in range(2003)], "g long")
    a, b = (dict(E.seeded_folds(x, "g", 7).collect()) for x in (df, df.orderBy(F.desc("g")).repartition(5)))
    sizes = [list(a.values()).count(f) for f in range(7)]
    assert a == b and len(a) == 1002 and max(sizes) - min(sizes) <= 1


def share(w, l):
    return w / (w + l) if w + l else 0.0


def recursive(group, t, beat, leaders):
    """Order of teams of one share of wins: the first step that tells any apart, then each tied rest anew."""
    if len(group) < 2:
        return group
    h2h = lambda x: share(sum(beat.get((x, o), 0) for o in group), sum(beat.get((o, x), 0) for o in group))
    lead = lambda x: float(x in leaders)
    steps = [h2h, lead] if len(group) == 2 else [lead, h2h]
    if len({t[x]["division"] for x in group}) == 1:
        steps.append(lambda x: share(*t[x]["div"]))
    for f in [*steps, lambda x: share(*t[x]["conf"]), lambda x: t[x]["diff"]]:
        if len({f(x) for x in group}) > 1:
            return [y for v in sorted({f(x) for x in group}, reverse=True) for y in recursive([x for x in group if f(x) == v], t, beat, leaders)]
    return sorted(group)


def by_record(group, t, beat, leaders):
    shares = sorted({share(*t[x]["all"]) for x in group}, reverse=True)
    return [y for v in shares for y in recursive([x for x in group if share(*t[x]["all"]) == v], t, beat, leaders)]


@pytest.mark.parametrize("seed", range(3))
def test_seeds_equal_the_recursion(spark, seed):
    rng = random.Random(seed)
    place = {t: ("EW"[t % 2], t % 4 // 2) for t in range(16)}
    games = [(m, *rng.sample(range(16), 2), rng.choice([1, 2, 3])) for m in ("a", "b", "c") for _ in range(rng.choice([14, 30, 60]))]
    rows = [(m, x, y, s, 0) for m, x, y, s in games] + [(m, y, x, 0, s) for m, x, y, s in games]
    got = S.seeds(spark.createDataFrame(rows, "m string, team_id long, opp_id long, scored long, allowed long"), spark.createDataFrame([(t, *p) for t, p in place.items()], "team_id long, conference string, division int"), "m").collect()
    found = {(r.m, r.conference): [x.team_id for x in sorted((x for x in got if (x.m, x.conference) == (r.m, r.conference)), key=lambda x: x.place)] for r in got}
    for (m, c), order in found.items():
        mine = [g for g in games if g[0] == m]
        beat, t = {}, {}
        for _, x, y, _ in mine:
            beat[x, y] = beat.get((x, y), 0) + 1
        for x in {x for g in mine for x in g[1:3]}:
            won, lost = [g for g in mine if g[1] == x], [g for g in mine if g[2] == x]
            count = lambda ok: (sum(ok(g[2]) for g in won), sum(ok(g[1]) for g in lost))
            t[x] = {"division": place[x][1], "all": (len(won), len(lost)), "conf": count(lambda o: place[o][0] == place[x][0]), "div": count(lambda o: place[o] == place[x]), "diff": sum(g[3] for g in won) - sum(g[3] for g in lost)}
        leaders = {by_record([x for x in t if place[x] == p], t, beat, set())[0] for p in {place[x] for x in t}}
        assert order == by_record([x for x in t if place[x][0] == c], t, beat, leaders)


def test_digits_give_the_counts_of_the_numbers_and_draws_use_all_tasks(spark):
    at = [v for p in E.POISSON for v in (int(p * 2**32), int(p * 2**32) + 1)] + [0, 2**32 - 1]
    df = spark.createDataFrame([(v, f"{v:08x}") for v in at], "v long, digits string")
    assert [(r.v, r.n) for r in df.select("v", E.poisson_times(F.col("digits")).alias("n")).collect()] == [(v, sum(v / 2**32 >= p for p in E.POISSON)) for v in at]
    clusters = spark.range(20_000).select(F.col("id").alias("c"), F.lit(1.0).alias("e"))
    used = E.bootstrap_sums(clusters, "c", {"s": F.col("e")}, draws=8)
    assert used._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") > 0  # few bytes, much work: not coalesced into one task
    assert used.count() == 8
