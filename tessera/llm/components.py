"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """edges (u, v), of which there are about so many rows. large: hang the larger neighbours of each node below its least one; else the node and its smaller ones."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = C.few(both.join(least, "u"), 2 * rows)
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(C.few(least.select("u", F.col("m").alias("v")), rows))
    return C.few(out.where("u != v").distinct(), rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v): the least node that a path leads to.

    Nodes of hot degree meet only in aggregates with map-side combining and in joins that can be split. Each round's
    edges are checkpointed, so a lost executor costs one round.
    """
    rows = edges.count()
    now = C.checkpoint(C.few(C.few(edges, rows).where("u != v").select("u", "v").distinct(), rows))
    digest = None
    while True:
        now = C.checkpoint(_star(_star(now, True, rows), False, rows))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == digest:
            break
        digest, rows = seen, seen[0]
    nodes = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return C.few(nodes, rows).unionAll(C.few(roots, rows))
