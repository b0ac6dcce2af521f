"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (a, b) -> (member, least of its star): every vertex tells its larger (or its smaller) neighbours of the
    least vertex that it knows, itself included."""
    if small:
        both = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("n"))
    else:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("n")))
    least = both.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("v", "m").alias("m"))
    told = both.join(least, "v")
    if small:
        out = told.select(F.col("n").alias("a"), F.col("m").alias("b")).union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    else:
        out = told.where("n > v").select(F.col("n").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rows: int | None = None) -> DataFrame:
    """edges(a, b) of any ordered type -> (v, root) for every vertex of an edge, root the least of its component.

    Loops and repeated edges are allowed. The number of rounds grows as the logarithm of the largest component; each
    round is two joins on vertices, whose hot keys are the roots, and its edges are written before the next round.
    No links or components pass through the driver, only a count and a checksum per round. most_rows: a bound on the
    edges, if one is known.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges", most_rows)
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        # A round makes at most as many edges as it is given, and one per vertex.
        now = materialize(_star(_star(now, small=False), small=True), "edges", 2 * mark[0])
    members = now.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root"))
    return members.union(members.select(F.col("root").alias("v"), "root").distinct())
