"""Ways within many small graphs at once: a graph a row, what a node reaches as the bits of a long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.sources.scratch import written

#: Nodes, ends of edges included, and edges of a graph up to which it is a row; larger ones are followed edge by edge, round by round.
NODES, EDGES = 63, 1024


def bit(node: str) -> str:
    """The bit of a node, by its place among ids."""
    return f"shiftleft(1L, cast(array_position(ids, {node}) as int) - 1)"


def let(name: str, value: str, body: str) -> str:
    """body with a value that is made once a row: Spark puts a column that is named once where it is named, within a lambda again and again."""
    return f"transform(array({value}), {name} -> {body})[0]"


def ways(edges: str) -> str:
    """For each of ids the bits of those to which one or more of edges (an array of structs with source and target, all of them among ids) lead: near ones first, then through each node in turn."""
    near = f"transform(ids, v -> aggregate(es, 0L, (m, e) -> if(e.source = v, m | {bit('e.target')}, m)))"
    return let("es", edges, f"aggregate(sequence(1, size(ids)), {near}, (r, k) -> transform(r, x -> if((shiftright(x, k - 1) & 1L) = 1L, x | r[k - 1], x)))")


def packed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """A row (graph_id, nodes, edges, ids) for each graph that is small, and nodes and edges of the others, None where there are none.

    nodes and edges are arrays of the other columns of their rows, ids the nodes and ends of edges in
    their order. Graphs with a null for a node count as large: a null has no bit.
    """
    of = lambda df, *nodes: df.groupBy("graph_id").agg(F.count("*").alias("n"), F.count_if(F.greatest(*[F.col(c).isNull() for c in (*nodes, nodes[0])])).alias("nulls"))
    wide = of(nodes, "node_id").where(f"n > {NODES} or nulls > 0").select("graph_id").unionByName(of(edges, "source", "target").where(f"n > {EDGES} or nulls > 0").select("graph_id")).distinct()
    wide = written(wide, "wide")
    some = not wide.isEmpty()
    met = lambda x, kind: x.join(wide.select(F.col("graph_id").alias("wide")), F.col("graph_id").eqNullSafe(F.col("wide")), kind)
    n, e = (met(x, "left_anti") if some else x for x in (nodes, edges))
    fields = lambda df: F.struct(*[c for c in df.columns if c != "graph_id"])
    rows = n.groupBy("graph_id").agg(F.collect_list(fields(nodes)).alias("nodes")).hint("merge").join(e.groupBy("graph_id").agg(F.collect_list(fields(edges)).alias("edges")).hint("merge"), "graph_id", "left")
    rows = rows.withColumn("edges", F.coalesce("edges", F.array().cast(dict(rows.dtypes)["edges"])))
    ids = F.expr("array_sort(array_distinct(concat(transform(nodes, x -> x.node_id), transform(edges, e -> e.source), transform(edges, e -> e.target))))")
    rows = written(rows.withColumn("ids", ids), "graphs")
    over = rows.where(F.size("ids") > NODES).select("graph_id")
    if not over.isEmpty():
        rows, wide, some = rows.where(F.size("ids") <= NODES), wide.unionByName(over), True
    return rows, *((met(x, "left_semi") if some else None) for x in (nodes, edges))
