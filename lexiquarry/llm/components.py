"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store


def _closer(pairs: DataFrame, up_to_self: bool) -> DataFrame:
    """One star step: neighbours of a node are tied to the least of them and the node.

    A node's least neighbour is an aggregate with map-side combining, joined
    back to its edges; no task needs all the edges of a node at once.
    """
    if up_to_self:
        near = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        tied = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        return tied.union(own).where("a <> b").distinct()
    near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(id, component): the least id reachable, for every id on an edge (a, b).

    Alternates large-star and small-star steps until the edges are stars
    around their least id. Every round is a written table; rounds grow with
    the logarithm of a component's size. Edges with a null end and loops
    tell nothing and are ignored; no edges give an empty table.
    """
    now = store.table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state:
            break
        state = (seen["n"], seen["h"])
        if not seen["n"]:
            break
        after = store.table(_closer(_closer(now, False), True), "stars")
        store.drop(now)
        now = after
    # A star's centre has no edge to a lesser id; every other node has exactly one.
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
