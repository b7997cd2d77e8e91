"""Routes through directed graphs: how many there are between two nodes, and how short the shortest is, by doubling over a semiring.

Walks of up to 2^k steps and walks of just 2^k steps are tables of (routes, depth); one join and one aggregate a round multiply and add their
routes and take the least of their summed depths at once, so a graph takes as many rounds as the logarithm of its longest route. Where a cycle is, routes have
no number: such graphs are found by reachability first and only flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .policy import closure

_COUNT = "decimal(38,0)"


def cyclic_graphs(edges: DataFrame) -> DataFrame:
    """(graph) of graphs in which some node reaches itself. edges: graph, source, target."""
    reached = closure(edges.select(F.col("graph").alias("policy_id"), F.col("source").alias("key"), F.col("target").alias("parent")))
    return reached.where("key = ancestor").select(F.col("policy_id").alias("graph")).distinct()


def route_counts(edges: DataFrame) -> DataFrame:
    """(graph, source, target, routes, depth) of the pairs of nodes of acyclic graphs that a route joins: how many routes, and the steps of the shortest.

    edges (graph, source, target), of which equal ones are routes of their own. Graphs with a cycle are left out: see `cyclic_graphs`.
    """
    known = edges.where("graph is not null and source is not null and target is not null").select("graph", "source", "target")
    sound = written(known.join(cyclic_graphs(known), "graph", "left_anti"))
    steps = written(sound.groupBy("graph", "source", "target").agg(F.count(F.lit(1)).cast(_COUNT).alias("routes"), F.lit(1).cast("bigint").alias("depth")))

    def added(df: DataFrame) -> DataFrame:
        return written(df.groupBy("graph", "source", "target").agg(F.sum("routes").cast(_COUNT).alias("routes"), F.min("depth").alias("depth")))

    def onward(df: DataFrame) -> DataFrame:
        after = steps.select("graph", F.col("source").alias("target"), F.col("target").alias("end"), F.col("routes").alias("more"), F.col("depth").alias("further"))
        return df.join(after, ["graph", "target"]).select("graph", "source", F.col("end").alias("target"), (F.col("routes") * F.col("more")).cast(_COUNT).alias("routes"), (F.col("depth") + F.col("further")).alias("depth"))

    reached = steps
    while not steps.isEmpty():
        reached, steps = added(reached.unionAll(onward(reached))), added(onward(steps))
    return reached


def route_problems(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(graph, problem, item) of graphs that do not lead from a start by one route to one end, with nothing else touching that route.

    edges (graph, place, source, target, relevant), place the position of an edge; asked (graph, start, end, depth, total): where the route should lead, in how many steps, and how many edges there should be.
    """
    v = lambda df, problem, item: df.select("graph", F.lit(problem).alias("problem"), item.cast("string").alias("item"))
    cyclic = cyclic_graphs(edges)
    counts = route_counts(edges)
    ends = edges.select("graph", F.col("target").alias("node")).distinct().join(edges.select("graph", F.col("source").alias("node")).distinct(), ["graph", "node"], "left_anti")
    led = counts.join(asked.select("graph", F.col("start").alias("source")), ["graph", "source"]).join(ends.withColumnRenamed("node", "target"), ["graph", "target"])
    sums = led.groupBy("graph").agg(F.sum("routes").alias("routes"), F.count(F.lit(1)).alias("ends"), F.min("target").alias("reached"), F.min("depth").alias("steps"))
    both = asked.join(cyclic, "graph", "left_anti").join(sums, "graph", "left")
    size = asked.join(edges.groupBy("graph").agg(F.count(F.lit(1)).alias("found"), F.count_if("relevant").alias("on_route"), F.count_distinct("place").alias("places")), "graph", "left").fillna(0, ["found", "on_route", "places"])
    touched = edges.where("relevant").select("graph", F.explode(F.array("source", "target")).alias("node")).distinct()
    meets = edges.where("not relevant").select("graph", "place", F.explode(F.array("source", "target")).alias("node")).join(touched, ["graph", "node"])
    one = F.col("routes") == 1
    parts = [
        v(cyclic, "cycle", F.lit(None)), v(edges.where("source = target"), "loop", F.col("place")), v(both.where("routes is null"), "no route", F.col("start")), v(both.where("routes > 1"), "several routes", F.col("routes")),
        v(both.where(one & ~F.col("reached").eqNullSafe(F.col("end"))), "another end", F.col("reached")), v(both.where(one & (F.col("steps") != F.col("depth"))), "another depth", F.col("steps")),
        v(size.where("found != total"), "number of edges", F.col("found")), v(size.where("on_route != depth"), "number of relevant edges", F.col("on_route")), v(size.where("places != found"), "repeated place", F.col("places")),
        v(meets.select("graph", "place").distinct(), "touches the route", F.col("place")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def positions(edges: DataFrame) -> DataFrame:
    """(graph, edges, depth, first, span): how many edges, how many of them relevant, where the first of these stands and how far they stretch."""
    at: Column = F.when(F.col("relevant"), F.col("place"))
    return edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"), F.count_if("relevant").alias("depth"), F.min(at).alias("first"), (F.max(at) - F.min(at) + 1).alias("span"))
