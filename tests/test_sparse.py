"""Sparse ridge against a dense solve, and leave-one-out means by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlab.operators import sparse as P


def test_equals_a_dense_solve_with_priors(spark):
    rng = np.random.default_rng(4)
    names = ["level", "home"] + [f"e{i}" for i in range(18)]
    rows, x, y, w = [], [], [], []
    for _ in range(200):
        a, b = rng.choice(18, (2, 3), replace=False)
        v = np.zeros(20)
        v[0], v[1] = 1.0, float(rng.random() < 0.7)
        v[2 + a], v[2 + b] = 1.0, -1.0
        x.append(v)
        y.append(rng.normal() + v[2:] @ np.linspace(-2, 2, 18) + 3 * v[1])
        w.append(rng.uniform(0.5, 4))
        rows.append(([(n, float(c)) for n, c in zip(names, v) if c], float(y[-1]), float(w[-1])))
    priors = rng.normal(size=18)
    penalties = [(n, 7.0, float(p)) for n, p in zip(names[2:], priors)] + [("unseen", 5.0, 1.5)]
    got = {r.c: r.effect for r in P.sparse_ridge(spark.createDataFrame(rows, "terms array<struct<c: string, x: double>>, y double, w double"), spark.createDataFrame(penalties, "c string, penalty double, prior double")).collect()}
    x, w, l = np.array(x), np.diag(w), np.array([0, 0, *[7.0] * 18])
    want = np.linalg.solve(x.T @ w @ x + np.diag(l), x.T @ w @ np.array(y) + l * np.array([0, 0, *priors]))
    assert [got[n] for n in names] == pytest.approx(want.tolist(), abs=1e-6) and got["unseen"] == 1.5


def test_no_rows(spark):
    none = spark.createDataFrame([], "terms array<struct<c: string, x: double>>, y double, w double")
    assert P.sparse_ridge(none, spark.createDataFrame([], "c string, penalty double, prior double")).count() == 0


def test_leave_one_out(spark):
    rows = spark.createDataFrame([("a", 1, 2.0, 1.0), ("a", 1, 4.0, 1.0), ("a", 2, 10.0, 2.0), ("a", 3, 1.0, 4.0), ("b", 1, 5.0, 1.0)], "u string, g int, v double, w double")
    got = {(r.u, r.g): r.left_out for r in P.leave_one_out(rows, ["u"], "g", F.col("v"), F.col("w")).collect()}
    assert got == {("a", 1): pytest.approx(24 / 6), ("a", 2): pytest.approx(10 / 6), ("a", 3): pytest.approx(26 / 4), ("b", 1): None}
