"""Cycles of many directed graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.operators import closures
from gatehouse.operators.workflows import reached
from gatehouse.sources.scratch import shared_dir


def _trimmed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes without those that lack edges in or out, again and again: these lie on no cycle. As many rounds as the longest way into or out of what stays."""
    left, n = nodes, nodes.count()
    while n:
        own = edges.join(left.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_semi").join(left.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_semi")
        into, out = own.select("graph_id", F.col("target").alias("node_id")), own.select("graph_id", F.col("source").alias("node_id"))
        left = left.join(into, ["graph_id", "node_id"], "left_semi").join(out, ["graph_id", "node_id"], "left_semi").checkpoint()
        before, n = n, left.count()
        if n == before:
            break
    return left


def _small(rows: DataFrame) -> DataFrame:
    """(graph_id, node_id, component, on) of graphs that are a row each (closures.packed), on telling whether the node lies on a cycle; ids and edges are those of known nodes."""
    known = rows.withColumn("ids", F.expr("array_sort(array_distinct(transform(nodes, x -> x.node_id)))")).withColumn("edges", F.expr("filter(edges, e -> array_contains(ids, e.source) and array_contains(ids, e.target))"))
    own = known.withColumn("ways", F.expr(closures.ways("edges")))
    on = "(shiftright(ways[k - 1], k - 1) & 1L) = 1L"
    # ids are in order, so the first that is met both ways is the smallest.
    first = "ids[filter(sequence(1, size(ids)), j -> (shiftright(ways[k - 1], j - 1) & shiftright(ways[j - 1], k - 1) & 1L) = 1L)[0] - 1]"
    return own.select("graph_id", F.expr(f"inline(transform(sequence(1, size(ids)), k -> struct(ids[k - 1] as node_id, if({on}, {first}, ids[k - 1]) as component, {on} as on)))"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, component) of nodes (graph_id, node_id) and edges (graph_id, source, target): component is the smallest node that a node reaches and is reached from. Small graphs are a row each, others run round by round; edges to unknown nodes don't count."""
    rows, nodes, edges = closures.packed(nodes.select("graph_id", "node_id"), edges.select("graph_id", "source", "target"))
    told = _small(rows).drop("on")
    return told if nodes is None else told.unionByName(_large(nodes, edges))


def _large(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """strong_components of graphs of any size.

    Nodes on no cycle are trimmed first, each a component of its own. Of the others each takes the largest node
    that reaches it as its colour; what reaches a colour's own node backwards, within the colour, is its
    component. These go, and the rest starts again. All graphs run at once.
    """
    shared_dir(nodes.sparkSession)
    nodes = nodes.select("graph_id", "node_id").distinct().checkpoint()
    own = edges.select("graph_id", "source", "target").distinct().checkpoint()
    left, found = _trimmed(nodes, own), None
    while not left.isEmpty():
        near = own.join(left.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_semi").join(left.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_semi").checkpoint()
        colours = left.withColumn("colour", F.col("node_id"))
        while True:
            passed = near.join(colours.withColumnRenamed("node_id", "source"), ["graph_id", "source"]).select("graph_id", F.col("target").alias("node_id"), "colour")
            after = colours.unionByName(passed).groupBy("graph_id", "node_id").agg(F.max("colour").alias("colour")).checkpoint()
            changed = after.join(colours, ["graph_id", "node_id", "colour"], "left_anti")
            done = changed.isEmpty()
            colours = after
            if done:
                break
        # Edges within a colour, turned round, as a graph of their own for each colour.
        at = colours.select("graph_id", F.col("node_id").alias("source"), F.col("colour").alias("c"))
        same = near.join(at, ["graph_id", "source"]).join(colours.select("graph_id", F.col("node_id").alias("target"), F.col("colour").alias("c")), ["graph_id", "target", "c"])
        back = same.select(F.struct("graph_id", "c").alias("graph_id"), F.col("target").alias("source"), F.col("source").alias("target"))
        seeds = colours.where("node_id = colour").select(F.struct("graph_id", F.col("colour").alias("c")).alias("graph_id"), "node_id")
        one = reached(seeds, back).select("graph_id.graph_id", "node_id", F.col("graph_id.c").alias("c")).checkpoint()
        found = one if found is None else found.unionByName(one)
        rest = left.join(one.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")
        left = _trimmed(rest.checkpoint(), own)
    if found is None:
        return nodes.withColumn("component", F.col("node_id"))
    named = found.join(found.groupBy("graph_id", "c").agg(F.min("node_id").alias("component")), ["graph_id", "c"]).select("graph_id", "node_id", "component")
    return nodes.join(named, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("component", "node_id").alias("component"))


def on_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, component): the nodes that lie on a cycle, an edge to itself included."""
    rows, nodes, edges = closures.packed(nodes.select("graph_id", "node_id"), edges.select("graph_id", "source", "target"))
    told = _small(rows).where("on").drop("on")
    if nodes is None:
        return told
    parts = _large(nodes, edges)
    several = parts.groupBy("graph_id", "component").agg(F.count("*").alias("n")).where("n > 1").select("graph_id", "component")
    loops = edges.where("source = target").select("graph_id", F.col("source").alias("node_id")).distinct()
    whole = parts.join(several, ["graph_id", "component"], "left_semi")
    return told.unionByName(whole).unionByName(parts.join(loops, ["graph_id", "node_id"], "left_semi").join(several, ["graph_id", "component"], "left_anti")).select("graph_id", "node_id", "component")
