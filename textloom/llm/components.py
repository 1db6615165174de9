"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least label in the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. Edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs -> (node, component): each node that has an edge and the least node it can reach.

    Loops and repeated pairs change nothing; rows with a null end are dropped; no edges give no rows.
    Each round is two aggregations and two joins, and is written to the shared folder; the number of
    rounds grows with the logarithm of the longest path. No neighbourhood is gathered in one row.
    """
    now = written(
        edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
        .filter("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        last, now = now, written(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        dropped(last)  # each round stands on its own table
        if state == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: count and two sums of hashes."""
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))
    ).first()
    return tuple(row)
