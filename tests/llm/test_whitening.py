"""Whitening against whole-number arithmetic in Python and a dense decomposition."""

import math

import numpy as np
import pytest

from contestlab.llm import whitening


def brute(rows):
    """(id, vector) -> {id: deviation}, n, sums, covariance, from Python's own whole numbers."""
    whole = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    d = len(sums)
    scattered = [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]
    deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in whole]
    return deviation, n, scattered


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n int, component string")


def extra(rows):
    return [(i, v, 0, "clash", 7, "clash") for i, v in rows]


def test_equals_whole_numbers_and_a_dense_decomposition(spark):
    rng = np.random.default_rng(5)
    base = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * 10 ** rng.uniform(0, 2)]) for i in range(300)]
    rows = base + [(300, base[0][1]), (300, base[0][1]), (None, base[1][1])]
    odd = [(900, None), (901, []), (902, [1.0] * 5 + [None]), (903, [1.0] * 5 + [float("nan")]), (904, [1.0] * 5 + [float("inf")]), (905, [1.0] * 5 + [3e38]), (906, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, extra(rows + odd)), components=4).collect()
    deviation, n, scattered = brute(rows)
    assert sorted(((r.vec_id, r.deviation) for r in got), key=repr) == sorted([d for d in deviation for _ in range(4)], key=repr)
    v = np.array([[s / n**3 for s in r] for r in scattered])
    values = np.linalg.eigvalsh(v)[::-1]
    for r in got:
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9) and r.identity_error < 1e-9
    mine = {(r.vec_id, r.component): r.whitened for r in got if r.vec_id is not None and r.vec_id < 300}
    z = np.array([[mine[i, c] for c in range(1, 5)] for i in range(300)])
    assert np.abs(z.T @ z / 300 - np.eye(4)).max() < 1e-9


def test_scatter_is_exact_where_longs_and_doubles_are_not(spark):
    rng = np.random.default_rng(6)
    x = [[int(a) for a in rng.integers(-(2**40), 2**40, 3)] for _ in range(500)]
    fit = spark.createDataFrame([(np.array(r, "<i8").tobytes(),) for r in x], "x binary").repartition(7)
    n, sums, least, most = whitening.sums_and_extremes(fit, 3)
    assert (n, sums) == (500, [sum(c) for c in zip(*x)]) and (least, most) == ([min(c) for c in zip(*x)], [max(c) for c in zip(*x)])
    widest = max(max(n * m - s, s - n * l) for s, l, m in zip(sums, least, most))
    found = whitening.scatter(fit, n, sums, whitening.enough_primes(n * widest**2))
    y = [[n * a - s for a, s in zip(r, sums)] for r in x]
    assert found == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
    assert max(map(abs, found[0])) > 2**63


def test_wide_deviations_are_exact_or_null(spark):
    rows = [(i, [float(c) * s for c in v]) for s in (1.0, 1e9) for i, v in enumerate([(1, 2), (3, 5), (8, 1), (0, 9)])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, extra([(j, v) for j, (_, v) in enumerate(rows)])), 2).collect()}
    for i, d in brute([(j, [float(np.float32(c)) for c in v]) for j, (_, v) in enumerate(rows)])[0]:
        assert got[i] == (d if d < 2**63 else None)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(frame(spark, extra(rows)))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_components_without_variance_have_no_rows(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    got = whitening.whiten(frame(spark, extra(rows))).collect()
    assert len(got) == 20 and {r.component for r in got} == {1}
