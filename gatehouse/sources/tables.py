"""Tables by name, and the portal's tables as views over the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the roles made of market segments in the order of their ids, from 0, and the administrators' role, which follows.
ROLE_CODES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]
ADMIN_ROLE = "PLATFORM_ADMIN"
#: Ids of departments made from nations start here; regions are their parents, from 1.
DEPT_BASE = 100
#: Every so manieth user is an administrator.
ADMIN_EVERY = 97


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, email, dept_id, status, role_id)."""
    role = F.expr("array_position(array(" + ", ".join(f"'{r}'" for r in ROLE_CODES) + "), c_mktsegment) - 1")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@company.com")).alias("email"),
        (F.col("c_nationkey") + DEPT_BASE).cast("long").alias("dept_id"),
        F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).alias("status"),
        role.cast("long").alias("role_id"),
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, code): the segments that customers have, and the administrators' role."""
    place = F.array_position(F.array(*[F.lit(c) for c in ROLE_CODES]), F.col("c_mktsegment")) - 1
    own = table(spark, sf_dir, "customer").select(place.cast("long").alias("id"), F.col("c_mktsegment").alias("code")).distinct()
    return own.unionByName(spark.createDataFrame([(len(ROLE_CODES), ADMIN_ROLE)], "id long, code string"))


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, role_id): the segment's role, for every third user the next one too, and the administrators'."""
    own = users(spark, sf_dir).select(F.col("id").alias("user_id"), "role_id")
    more = own.where("user_id % 3 = 0").select("user_id", ((F.col("role_id") + 1) % len(ROLE_CODES)).alias("role_id"))
    admins = own.where(F.col("user_id") % ADMIN_EVERY == 0).select("user_id", F.lit(len(ROLE_CODES)).cast("long").alias("role_id"))
    return own.unionByName(more).unionByName(admins)


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, parent_id): regions are roots, nations their children."""
    roots = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"))
    below = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + DEPT_BASE).cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"))
    return roots.unionByName(below)


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, status): assistants, and knowledge bases likewise."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") >= 0, 1).otherwise(0).alias("status"))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource_id, principal_type, principal_id), each once."""
    closed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    to_users = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(closed, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("resource_id"), F.lit("user").alias("principal_type"), F.col("o_custkey").alias("principal_id")).distinct()
    supplier = table(spark, sf_dir, "supplier")
    to_depts = supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("resource_id"), F.lit("dept").alias("principal_type"), (F.col("s_nationkey") + DEPT_BASE).cast("long").alias("principal_id"))
    to_roles = supplier.where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("resource_id"), F.lit("role").alias("principal_type"), (F.col("s_suppkey") % len(ROLE_CODES)).alias("principal_id"))
    return to_users.unionByName(to_depts).unionByName(to_roles)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conversation_id, seq, role, content)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, app_id, last_seq, deleted): one row a conversation; every eleventh is soft-deleted."""
    own = messages(spark, sf_dir).groupBy("conversation_id").agg(F.max("seq").alias("last_seq"))
    return own.select(F.col("conversation_id").alias("id"), (F.col("conversation_id") % 150).alias("user_id"), (F.col("conversation_id") % 10).alias("app_id"), "last_seq", (F.col("conversation_id") % 11 == 10).alias("deleted"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, action, tokens, latency, detail, created_at)."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("latency"), F.col("props").alias("detail"), F.col("ts").alias("created_at"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames_of the table of events."""
    return frames_of(table(spark, sf_dir, "events")).drop("ts")


def frames_of(events: DataFrame) -> DataFrame:
    """(stream_id, seq, event, data, ts): raw frames of one stream a user; one in five has an event line, errors hold no JSON or a message, some answers are numbers, booleans or null, some thoughts lie within data or are numbers, some ends tell no usage."""
    k = F.get_json_object("props", "$.k")
    n = F.col("event_id").cast("string")
    odd = F.when(F.col("event_id") % 13 == 0, n).when(F.col("event_id") % 13 == 1, "true").when(F.col("event_id") % 13 == 2, "null")
    body = (
        F.when((F.col("event_type") == "view") & odd.isNotNull(), F.concat(F.lit('{"event":"message","answer":'), odd, F.lit("}")))
        .when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), F.concat(F.lit('{"message":"e'), n, F.lit('"}')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"event":"message","answer":"a'), n, F.lit('"}')))
        .when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), F.concat(F.lit('{"event":"agent_thought","thought":7,"data":{"thought":"d'), n, F.lit('"}}')))
        .when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 1), F.concat(F.lit('{"event":"agent_thought","reasoning":"","thought":'), n, F.lit("}")))
        .when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0), F.concat(F.lit('{"event":"message_end","conversation_id":"d'), n, F.lit('"}')))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"event":"agent_thought","thought":"t'), n, F.lit('"}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"event":"message","answer":"s'), n, F.lit('","reasoning_content":"r'), n, F.lit('"}')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"event":"message_end","conversation_id":"c'), F.col("user_id").cast("string"), F.lit('","metadata":{"usage":{"total_tokens":'), k, F.lit("}}}")))
        .otherwise(F.lit("upstream exploded"))
    )
    line = F.when((F.col("event_id") % 5 == 0) & (F.col("event_type") == "view"), F.lit("message")).when(F.col("event_type") == "error", F.lit("error"))
    return events.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), line.alias("event"), body.alias("data"), "ts")


#: The same views in DuckDB's SQL.
VIEWS = f"""
users AS (SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '.')) || '@company.com' AS email, (c_nationkey + {DEPT_BASE})::BIGINT AS dept_id,
  CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS status, (list_position({ROLE_CODES}, c_mktsegment) - 1)::BIGINT AS role_id FROM customer),
roles AS (SELECT DISTINCT (list_position({ROLE_CODES}, c_mktsegment) - 1)::BIGINT AS id, c_mktsegment AS code FROM customer UNION ALL SELECT {len(ROLE_CODES)}, '{ADMIN_ROLE}'),
user_roles AS (SELECT id AS user_id, role_id FROM users UNION ALL SELECT id, (role_id + 1) % {len(ROLE_CODES)} FROM users WHERE id % 3 = 0 UNION ALL SELECT id, {len(ROLE_CODES)} FROM users WHERE id % {ADMIN_EVERY} = 0),
departments AS (SELECT (r_regionkey + 1)::BIGINT AS id, r_name AS name, NULL::BIGINT AS parent_id, '/' || (r_regionkey + 1) || '/' AS path FROM region
  UNION ALL SELECT (n_nationkey + {DEPT_BASE})::BIGINT, n_name, (n_regionkey + 1)::BIGINT, '/' || (n_regionkey + 1) || '/' || (n_nationkey + {DEPT_BASE}) || '/' FROM nation),
resources AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END AS status FROM supplier),
grants AS (SELECT DISTINCT l_suppkey AS resource_id, 'user' AS principal_type, o_custkey AS principal_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'
  UNION ALL SELECT s_suppkey, 'dept', (s_nationkey + {DEPT_BASE})::BIGINT FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT s_suppkey, 'role', s_suppkey % {len(ROLE_CODES)} FROM supplier WHERE s_suppkey % 7 = 0),
messages AS (SELECT conv_id AS conversation_id, turn AS seq, role, text AS content FROM conversations),
talks AS (SELECT conversation_id AS id, conversation_id % 150 AS user_id, conversation_id % 10 AS app_id, max(seq) AS last_seq, conversation_id % 11 = 10 AS deleted FROM messages GROUP BY conversation_id),
audit AS (SELECT event_id AS id, user_id, event_type AS action, (props->>'$.k')::BIGINT AS tokens, value AS latency, props AS detail, ts AS created_at FROM events),
frames AS (SELECT user_id AS stream_id, event_id AS seq, CASE WHEN event_id % 5 = 0 AND event_type = 'view' THEN 'message' WHEN event_type = 'error' THEN 'error' END AS event,
  CASE CASE WHEN event_type = 'click' AND event_id % 3 < 2 THEN 'click' || event_id % 3 WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'bare' WHEN event_type = 'view' AND event_id % 13 < 3 THEN 'odd' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'told' ELSE event_type END WHEN 'click0' THEN '{{"event":"agent_thought","thought":7,"data":{{"thought":"d' || event_id || '"}}}}'
  WHEN 'click1' THEN '{{"event":"agent_thought","reasoning":"","thought":' || event_id || '}}' WHEN 'odd' THEN '{{"event":"message","answer":' || [event_id::VARCHAR, 'true', 'null'][event_id % 13 + 1] || '}}' WHEN 'told' THEN '{{"message":"e' || event_id || '"}}' WHEN 'bare' THEN '{{"event":"message_end","conversation_id":"d' || event_id || '"}}' WHEN 'view' THEN '{{"event":"message","answer":"a' || event_id || '"}}' WHEN 'click' THEN '{{"event":"agent_thought","thought":"t' || event_id || '"}}'
  WHEN 'signup' THEN '{{"event":"message","answer":"s' || event_id || '","reasoning_content":"r' || event_id || '"}}'
  WHEN 'purchase' THEN '{{"event":"message_end","conversation_id":"c' || user_id || '","metadata":{{"usage":{{"total_tokens":' || (props->>'$.k') || '}}}}}}' ELSE 'upstream exploded' END AS data FROM events),
principals AS (SELECT id AS user_id, 'user' AS principal_type, id AS principal_id FROM users WHERE status = 1 UNION ALL SELECT id, 'dept', dept_id FROM users WHERE status = 1
  UNION ALL SELECT x.user_id, 'role', x.role_id FROM user_roles x JOIN users u ON u.id = x.user_id WHERE u.status = 1),
admins AS (SELECT DISTINCT x.user_id FROM user_roles x JOIN roles r ON r.id = x.role_id WHERE r.code = '{ADMIN_ROLE}'),
visible AS (SELECT u.id AS user_id, r.id AS resource_id FROM users u JOIN admins a ON a.user_id = u.id, resources r WHERE u.status = 1 AND r.status = 1
  UNION SELECT p.user_id, g.resource_id FROM principals p JOIN grants g USING (principal_type, principal_id) JOIN resources r ON r.id = g.resource_id AND r.status = 1)
"""


def sql(body: str) -> str:
    """A DuckDB query over the views."""
    return f"WITH {VIEWS} {body}"
