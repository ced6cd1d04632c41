"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v): each node hands its neighbours to the least of them.

    The least neighbour is an aggregate with partial sums at the mappers, so that a node of
    many neighbours costs one row per partition; the join back can be split by the planner.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    least = least.select("c", F.least("c", "m").alias("m"))
    met = near.join(least, F.col("u") == F.col("c"))
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.filter("c != m").select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """The components of links (a, b), where a and b are numbers.

    Returns:
        node, component: a row per node of a link; the component is its least node. Links of
        nulls and of a node to itself are ignored. No links give no rows.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u != v")
    edges, before = store(edges.distinct(), "edges"), None
    while True:
        earlier, edges = edges, store(_star(_star(edges, True), False), "edges")
        forget(earlier)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
