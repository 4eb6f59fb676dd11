"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.scratch import materialize


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """For both directions of each edge (u, v): the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step; every edge becomes one edge to a local minimum, so the number of edges never grows."""
    if large:
        both, least = _min_neighbour(edges)
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select("u", "v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) integer edges -> (node, component), component the least node reachable.

    Hubs are never gathered: a node's minimum is a partial aggregate and the join
    that spreads it can be split by the adaptive planner. Each round's edges go to the
    shared folder. Null ends and loops are ignored; an empty input gives an empty result.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    edges = materialize(edges, "edges")
    before = None
    for _ in range(max_rounds):
        edges = materialize(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == tuple(now):
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
