"""Connected components of an edge list by alternating star contraction, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (u, root): every node of an edge with the smallest node of its component.

    Large-star and small-star steps alternate until the edges are a set of stars. Each step is a minimum per node,
    combined before the shuffle, and an equi-join; lineage is cut by a checkpoint after each round. Nulls: rows with
    one are left out. Empty: no rows. Nodes without an edge are not returned."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    before = _state(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select("u", F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
