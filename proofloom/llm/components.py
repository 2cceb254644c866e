"""Connected components of an edge table by star contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half step: each vertex joins its neighbours (the larger ones, or the smaller ones and itself) to the least."""
    sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = sides.join(least, "a")
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) of every vertex that has an edge (a, b); root is the least vertex of its component, root itself too."""
    now = cut(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        new = cut(_stars(_stars(now, True), False), "edges")
        drop_cut(now)
        now = new
        found = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError("components: not settled")
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
