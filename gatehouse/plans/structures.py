"""Queries over trees, indexes, sketches, parts and graphs that are built for them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gatehouse.operators import changes, graphs, hierarchy, retrieval, sketches, workflows
from gatehouse.plans.desk import workflow_graphs
from gatehouse.plans.desk import NODES as _NODES
from gatehouse.plans.register import query
from gatehouse.sources import parts
from gatehouse.sources import tables as T
from gatehouse.sources.scratch import shared_dir
from gatehouse.sources.tables import sql


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_TREE = """t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 1000 = 97 THEN p_partkey + 1 WHEN p_partkey % 1000 = 489 THEN -p_partkey WHEN p_partkey % 300 = 1 THEN nullif(p_partkey // 300, 0) ELSE p_partkey - 1 END AS parent_id FROM part),
  r AS (SELECT id, 0 AS depth, [id] AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, r.depth + 1, list_append(r.path, t.id) FROM r JOIN t ON t.parent_id = r.id),
  m AS (SELECT id FROM t WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM t) UNION ALL SELECT t.id FROM m JOIN t ON t.parent_id = m.id),
  s AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(path) AS a FROM r) GROUP BY a),
  o AS (SELECT id, depth, row_number() OVER (ORDER BY path) - 1 AS pre FROM r)"""


def _tree(spark, sf):
    """Parts as a tree: chains of up to 300, hung into each other, of which some end in a cycle of two or below a part that doesn't exist."""
    k = F.col("p_partkey")
    parent = F.when(k % 1000 == 97, k + 1).when(k % 1000 == 489, -k).when(k % 300 == 1, F.nullif(F.floor(k / 300).cast("long"), F.lit(0).cast("long"))).otherwise(k - 1)
    return T.table(spark, sf, "part").select(k.cast("long").alias("id"), parent.cast("long").alias("parent_id"))


@query(f"WITH RECURSIVE {_TREE} SELECT t.id, CASE WHEN o.id IS NOT NULL THEN 'ok' WHEN m.id IS NOT NULL THEN 'missing' ELSE 'cycle' END AS outcome, o.depth::BIGINT AS depth, (2 * o.pre - o.depth)::BIGINT AS enter, (2 * o.pre - o.depth + 2 * s.n - 1)::BIGINT AS leave FROM t LEFT JOIN o ON o.id = t.id LEFT JOIN s ON s.id = t.id LEFT JOIN m ON m.id = t.id")
def tree_intervals(spark, sf):
    """Where a walk enters and leaves each part of a deep tree; cycles and missing parents are told apart."""
    return hierarchy.intervals(_tree(spark, sf))


@query(f"WITH RECURSIVE {_TREE} SELECT id, '/' || array_to_string(path, '/') || '/' AS path FROM r")
def tree_paths(spark, sf):
    """Paths of more than a hundred levels."""
    return hierarchy.paths(_tree(spark, sf)).select("id", "path")


@query(f"WITH RECURSIVE {_TREE} SELECT r.id, a.id AS above FROM r JOIN (SELECT id FROM r WHERE id % 50 = 0) a ON list_contains(r.path, a.id)")
def tree_subtrees(spark, sf):
    """Every part below each fiftieth one, by ranges of places: asked nodes and all others meet in bins of places, an asked one in each bin that it covers."""
    places = hierarchy.intervals(_tree(spark, sf)).where("outcome = 'ok'")
    return hierarchy.below(places, places.where("id % 50 = 0"))


# Indexes


@query("""WITH d AS (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS ws FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM d),
  c AS (SELECT doc_id, n, term, count(*) AS c FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY doc_id, n, term), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
  q AS (SELECT DISTINCT item_id AS query_id, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM benchmark WHERE text IS NOT NULL),
  r AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM q JOIN c USING (term) JOIN f USING (term), s GROUP BY query_id, doc_id)
  SELECT query_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def corpus_retrieve_indexed(spark, sf):
    """The ten best documents for each text of the benchmark, from an inverted index with bounds by block."""
    own = retrieval.index(T.table(spark, sf, "documents"), _path(spark, "index"))
    return retrieval.search(own, T.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


_TERMS = "CASE c_custkey % 40 WHEN 0 THEN right(c_name, 4) WHEN 10 THEN 'R.' || right(c_name, 5) WHEN 20 THEN right(c_name, 2) || '_%@' ELSE '0' || right(c_name, 1) END"


@query(sql(f"SELECT t.term_id, u.id FROM (SELECT c_custkey AS term_id, {_TERMS} AS term FROM customer WHERE c_custkey % 10 = 0) t JOIN users u ON lower(u.name || ' ' || u.email) LIKE '%' || lower(t.term) || '%'"))
def directory_contains(spark, sf):
    """Who holds each of many terms in name or email: ends of names, other letters' cases, wildcards, and terms too short for the index."""
    name, kind = F.col("c_name"), F.col("c_custkey") % 40
    term = F.when(kind == 0, F.right(name, F.lit(4))).when(kind == 10, F.concat(F.lit("R."), F.right(name, F.lit(5)))).when(kind == 20, F.concat(F.right(name, F.lit(2)), F.lit("_%@"))).otherwise(F.concat(F.lit("0"), F.right(name, F.lit(1))))
    asked = T.table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("term_id"), term.alias("term"))
    texts = T.users(spark, sf).select("id", F.concat("name", F.lit(" "), "email").alias("text"))
    return retrieval.containing(texts, retrieval.contains_index(texts, _path(spark, "grams")), asked)


# Statistics that merge


_RANKS = {"p50": 0.5, "p95": 0.95}


@query(sql("SELECT action, count(latency) AS n, true AS p50, true AS p95 FROM audit WHERE latency IS NOT NULL GROUP BY action"))
def stats_latency_sketched(spark, sf):
    """Percentiles from daily sketches merged, and whether each one's true rank is within one in a hundred of its own."""
    audit = T.audit(spark, sf).select("action", "latency", "created_at")
    told = sketches.merged_quantiles(sketches.daily_quantiles(audit, ["action"], "created_at", "latency"), ["action"], _RANKS)
    return sketches.within(audit, ["action"], "latency", told, _RANKS)


@query(sql("SELECT d.day, (SELECT count(DISTINCT user_id) FROM audit a WHERE a.created_at::DATE BETWEEN d.day - 6 AND d.day) AS week, (SELECT count(DISTINCT user_id) FROM audit a WHERE a.created_at::DATE BETWEEN d.day - 29 AND d.day) AS month FROM (SELECT DISTINCT created_at::DATE AS day FROM audit) d"))
def stats_active_users_rolling(spark, sf):
    """Users of the last 7 and 30 days, exactly, from daily bitmaps."""
    path = _path(spark, "users")
    sketches.daily_users(T.audit(spark, sf), "created_at", "user_id").write.parquet(path)
    daily = spark.read.parquet(path)
    return sketches.rolling_users(daily, 7).withColumnRenamed("n", "week").join(sketches.rolling_users(daily, 30).withColumnRenamed("n", "month"), "day")


# Changes of parts


@query(sql("""SELECT id, name, CASE WHEN id % 500 = 7 THEN NULL WHEN id % 500 = 9 THEN 102 ELSE dept_id END AS dept_id, CASE WHEN id % 500 = 9 THEN 0 ELSE status END AS status FROM users WHERE id % 500 <> 11
  UNION ALL SELECT id + 1000000, name, dept_id, status FROM users WHERE id % 500 = 13"""))
def users_changed_in_parts(spark, sf):
    """Patches (two of one user, the later counts), removals and new rows, each of which rewrites only the parts that it touches."""
    path = _path(spark, "users")
    users = T.users(spark, sf).select("id", "name", "dept_id", "status")
    parts.create(users, path, "id")
    fields = F.when(F.col("id") % 500 == 7, F.array(F.lit("dept_id"))).otherwise(F.array(F.lit("dept_id"), F.lit("status")))
    patch = users.where("id % 500 in (7, 9)").select("id", fields.alias("fields"), F.explode(F.array(F.lit(1), F.lit(2))).alias("at"))
    patch = patch.withColumn("dept_id", F.when(F.col("id") % 500 == 9, F.col("at") + 100).cast("long")).withColumn("status", F.lit(0))
    parts.change(spark, path, "id", patch, lambda old: changes.patched(old, patch, "id", "at"))
    gone = users.where("id % 500 = 11").select("id")
    parts.change(spark, path, "id", gone, lambda old: old.join(gone, "id", "left_anti"))
    new = users.where("id % 500 = 13").withColumn("id", F.col("id") + 1_000_000)
    parts.change(spark, path, "id", new, lambda old: old.join(new.select("id"), "id", "left_anti").unionByName(new))
    return parts.table(spark, path).select(*users.columns)


# Cycles


_REACH = f"""{_NODES}, e AS (SELECT DISTINCT graph_id, source, target FROM edges),
  reach AS (SELECT graph_id, source AS a, target AS b FROM e UNION SELECT r.graph_id, r.a, e.target FROM reach r JOIN e ON e.graph_id = r.graph_id AND e.source = r.b)"""


@query(f"WITH RECURSIVE {_REACH} SELECT x.graph_id, x.a AS node_id, (SELECT min(y.b) FROM reach y JOIN reach z ON z.graph_id = y.graph_id AND z.a = y.b AND z.b = y.a WHERE y.graph_id = x.graph_id AND y.a = x.a) AS component FROM reach x WHERE x.a = x.b")
def workflow_cycles(spark, sf):
    """The nodes of all workflow graphs that lie on a cycle, with the smallest node of theirs."""
    nodes, edges = workflow_graphs(spark, sf)
    return graphs.on_cycles(nodes, edges).withColumn("component", F.col("component").cast("long"))


@query(f"WITH RECURSIVE {_REACH} SELECT graph_id, bool_or(a = b) AS cyclic FROM (SELECT n.graph_id, r.a, r.b FROM nodes n LEFT JOIN reach r ON r.graph_id = n.graph_id) GROUP BY graph_id HAVING bool_or(a = b)")
def workflows_refused_for_cycles(spark, sf):
    """The stricter rule that any cycle is refused."""
    nodes, edges = workflow_graphs(spark, sf)
    return workflows.validated(nodes, edges, strict=True).where("outcome = 'cycle'").select("graph_id", F.lit(True).alias("cyclic"))
