"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoclass.llm.common import cut, drop


def _state(e: DataFrame) -> tuple:
    """Edge count and an order-free sum of edge hashes (one small row)."""
    r = e.agg(F.count("*").alias("n"),
              F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to u's smallest neighbour (or to u)."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, move to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Nulls and loops are no edges.  The stars are joins and map-side combined
    aggregations, so a hub's rows are split by the skew join; each round is written
    to the shared folder and the round before is deleted.  Stops when a round
    leaves the edges as they were.
    """
    e = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
            .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = _state(e)
    while state[0]:
        new = cut(_small_star(_large_star(e)), "cc", rows=state[0])
        drop(e)
        e, before, state = new, state, _state(new)
        if state == before:
            break
    # the edges are now (node, smallest node of its component)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
