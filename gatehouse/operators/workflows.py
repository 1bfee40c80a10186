"""Checks of workflow graphs, many graphs at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.operators import closures
from gatehouse.sources.scratch import shared_dir


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id): the seeds and all nodes to which edges (graph_id, source, target) lead from them. As many rounds as the longest shortest way; cycles end by themselves."""
    shared_dir(seeds.sparkSession)
    seen = front = seeds.select("graph_id", "node_id").distinct().checkpoint()
    while not front.isEmpty():
        step = front.withColumnRenamed("node_id", "source").join(edges, ["graph_id", "source"]).select("graph_id", F.col("target").alias("node_id")).distinct()
        front = step.join(seen, ["graph_id", "node_id"], "left_anti").checkpoint()
        seen = seen.unionByName(front)
    return seen


def _outcome(facts: DataFrame) -> DataFrame:
    """(graph_id, outcome): the first rule that the counts of facts tell to be broken."""
    rules = [("cycle", F.col("cyclic")), ("starts", F.col("starts") != 1), ("no_answer", F.col("answers") == 0), ("start_open", F.col("open") > 0), ("dead_end", F.col("dead") > 0), ("branches", F.col("branches") > 0), ("dead_branch", F.col("dead_branches") > 0), ("orphans", F.col("orphans") > 0)]
    outcome = F.lit("ok")
    for name, broken in reversed(rules):
        outcome = F.when(broken, name).otherwise(outcome)
    return facts.select("graph_id", outcome.alias("outcome"))


def _small(rows: DataFrame, strict: bool) -> DataFrame:
    """validated of graphs that are a row each (closures.packed)."""
    bit = closures.bit
    masks = rows.withColumn("ways", F.expr(closures.ways("edges"))).withColumn("s", F.expr(f"aggregate(nodes, 0L, (m, x) -> if(x.kind = 'start', m | {bit('x.node_id')}, m))")).withColumn("a", F.expr(f"aggregate(nodes, 0L, (m, x) -> if(x.kind = 'answer', m | {bit('x.node_id')}, m))"))
    found = "aggregate(sequence(1, size(ids)), s, (m, k) -> if((shiftright(s, k - 1) & 1L) = 1L, m | ways[k - 1], m))"
    masks = masks.withColumn("ends", F.expr("aggregate(sequence(1, size(ids)), a, (m, k) -> if((ways[k - 1] & a) <> 0L, m | shiftleft(1L, k - 1), m))"))
    many = lambda rule: F.expr(f"size(filter(nodes, x -> {rule}))")
    dead, branch = f"({bit('e.target')} & ends) = 0L", "e.handle in ('true', 'false')"
    facts = masks.select(
        "graph_id", "nodes", "edges", "ids", "ways",
        many("x.kind = 'start'").alias("starts"),
        many("x.kind = 'answer'").alias("answers"),
        many("x.kind = 'start' and not exists(edges, e -> e.source = x.node_id)").alias("open"),
        many(f"x.kind = 'start' and exists(edges, e -> e.source = x.node_id and {dead})").alias("dead"),
        many(f"x.kind = 'if-else' and size(filter(edges, e -> e.source = x.node_id and {branch})) <> 2").alias("branches"),
        many(f"x.kind = 'if-else' and size(filter(edges, e -> e.source = x.node_id and {branch} and {dead})) > 0").alias("dead_branches"),
        F.expr(closures.let("f", found, f"size(filter(nodes, x -> ({bit('x.node_id')} & f) = 0L))")).alias("orphans"),
    )
    if not strict:
        return _outcome(facts.withColumn("cyclic", F.lit(False)))
    # Edges to unknown nodes make no cycle.
    known = "filter(edges, e -> exists(nodes, x -> x.node_id = e.source) and exists(nodes, x -> x.node_id = e.target))"
    own = closures.let("es", known, f"if(size(es) = size(edges), ways, {closures.ways('es')})")
    cyclic = closures.let("w", own, "exists(sequence(1, size(ids)), k -> (shiftright(w[k - 1], k - 1) & 1L) = 1L)")
    return _outcome(facts.withColumn("cyclic", F.expr(cyclic)))


def validated(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """(graph_id, outcome) of nodes (graph_id, node_id, kind) and edges (graph_id, source, target, handle): the first rule that a graph breaks, else ok.

    In this order: starts (not exactly one start), no_answer, start_open (the start leads nowhere),
    dead_end (from a successor of the start no answer is reached), branches (an if-else node hasn't
    exactly two edges with the handles true and false), dead_branch (from one of these no answer is
    reached), orphans (nodes that the start doesn't reach). With strict, any cycle is refused before all
    else, as cycle. Small graphs are a row each, others are followed round by round; all end up in the same rules.
    """
    rows, nodes, edges = closures.packed(nodes.select("graph_id", "node_id", "kind"), edges.select("graph_id", "source", "target", "handle"))
    told = _small(rows, strict)
    return told if nodes is None else told.unionByName(_large(nodes, edges, strict))


def _large(nodes: DataFrame, edges: DataFrame, strict: bool) -> DataFrame:
    """validated of graphs of any size, round by round."""
    shared_dir(nodes.sparkSession)
    nodes, edges = nodes.checkpoint(), edges.checkpoint()
    plain = edges.select("graph_id", "source", "target")
    back = plain.select("graph_id", F.col("target").alias("source"), F.col("source").alias("target"))
    starts = nodes.where("kind = 'start'").select("graph_id", "node_id")
    ends = reached(nodes.where("kind = 'answer'"), back).select("graph_id", F.col("node_id").alias("target"), F.lit(True).alias("ends"))
    found = reached(starts, plain).withColumn("found", F.lit(True))
    out = edges.join(ends, ["graph_id", "target"], "left").groupBy("graph_id", F.col("source").alias("node_id")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ends").isNull()).alias("dead"),
        F.count_if(F.col("handle").isin("true", "false")).alias("branches"),
        F.count_if(F.col("handle").isin("true", "false") & F.col("ends").isNull()).alias("dead_branches"),
    )
    told = nodes.join(out, ["graph_id", "node_id"], "left").join(found, ["graph_id", "node_id"], "left")
    start, choice = F.col("kind") == "start", F.col("kind") == "if-else"
    facts = told.groupBy("graph_id").agg(
        F.count_if(start).alias("starts"),
        F.count_if(F.col("kind") == "answer").alias("answers"),
        F.count_if(start & F.col("n").isNull()).alias("open"),
        F.count_if(start & (F.col("dead") > 0)).alias("dead"),
        F.count_if(choice & (F.coalesce("branches", F.lit(0)) != 2)).alias("branches"),
        F.count_if(choice & (F.col("dead_branches") > 0)).alias("dead_branches"),
        F.count_if(F.col("found").isNull()).alias("orphans"),
    )
    told = _outcome(facts.withColumn("cyclic", F.lit(False)))
    if not strict:
        return told
    from gatehouse.operators import graphs  # it builds on this module

    cyclic = graphs.on_cycles(nodes, edges).select("graph_id").distinct().withColumn("cyclic", F.lit(True))
    return told.join(cyclic, "graph_id", "left").select("graph_id", F.when(F.col("cyclic"), "cycle").otherwise(F.col("outcome")).alias("outcome"))
