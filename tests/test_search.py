"""Coordinate descent against all combinations, and its one widening."""

import itertools

import pytest
from pyspark.sql import functions as F

from contestlab.operators import search as D


def loss(p):
    return F.col("n") * (F.pow(F.col("x") - p["a"], F.lit(2)) + F.pow(p["b"] - 3.0, F.lit(2)))


def test_least_of_all_combinations_on_a_bowl(spark):
    cells = spark.createDataFrame([(1.0, 2), (2.0, 5), (4.0, 1)], "x double, n int")
    grid = {"a": [0.0, 1.0, 2.0, 3.0], "b": [1.0, 2.0, 3.5, 5.0]}
    best, least = D.coordinate_descent(cells, grid, {"a": 0.0, "b": 5.0}, loss)
    every = {(a, b): sum(n * ((x - a) ** 2 + (b - 3) ** 2) for x, n in ((1, 2), (2, 5), (4, 1))) for a, b in itertools.product(*grid.values())}
    assert (best["a"], best["b"]) == min(every, key=every.get) and least == pytest.approx(min(every.values()))


def test_a_grid_too_narrow_grows_once(spark):
    cells = spark.createDataFrame([(10.0, 1)], "x double, n int")
    best, _ = D.coordinate_descent(cells, {"a": [0.0, 1.0, 3.0], "b": [2.0, 3.0, 4.0]}, {"a": 0.0, "b": 3.0}, loss)
    assert best == {"a": 5.0, "b": 3.0}
    assert D.coordinate_descent(cells.where("false"), {"a": [0.0, 1.0]}, {"a": 0.0, "b": 0.0}, loss) == ({"a": 0.0, "b": 0.0}, 0.0)
