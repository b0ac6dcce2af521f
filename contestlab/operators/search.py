"""Coordinate descent over a table of cells, each coordinate's whole grid in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_GAIN = 1e-7


def coordinate_descent(cells: DataFrame, grid: dict[str, list[float]], start: dict[str, float], loss: Callable[[dict[str, Column]], Column], passes: int = 4) -> tuple[dict[str, float], float]:
    """The parameters of the least total `loss` reached from `start`, and that loss.

    cells are rows already summed to what the loss needs, best written once: a coordinate is one aggregate with a sum for
    each of its values. The best value is taken (of equal ones the first) if it gains more than LEAST_GAIN; passes end
    when none of a pass does. Where the end lies on an edge of a grid, that grid grows once by its last step and
    descent goes on, so that a grid set too narrow shows."""
    best, grid = dict(start), {k: list(v) for k, v in grid.items()}
    total = lambda **p: F.sum(loss({k: F.lit(float(v)) for k, v in (best | p).items()}))
    least = cells.agg(total()).first()[0] or 0.0

    def descend() -> None:
        nonlocal least
        for _ in range(passes):
            gained = False
            for name, values in grid.items():
                found = cells.agg(*[total(**{name: v}) for v in values]).first()
                at = min(range(len(values)), key=lambda i: (found[i] is None, found[i]))
                if found[at] is not None and found[at] < least - LEAST_GAIN:
                    best[name], least, gained = values[at], found[at], True
            if not gained:
                return

    descend()
    edges = [k for k, v in grid.items() if len(v) > 1 and best[k] in (v[0], v[-1])]
    for name in edges:
        v = grid[name]
        grid[name] = [2 * v[0] - v[1], *v] if best[name] == v[0] else [*v, 2 * v[-1] - v[-2]]
    if edges:
        descend()
    return best, least
