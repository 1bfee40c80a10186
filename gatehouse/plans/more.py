"""Query shapes beyond the portal's own: sessions, windows, rollups, as-of and interval joins, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatehouse.plans.register import query
from gatehouse.sources import tables as T


@query("""SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s""")
def ext_sessions(spark, sf):
    events = T.table(spark, sf, "events").select("user_id", "ts")
    own = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n"))
    return own.select("user_id", "start", "stop", "n")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY day, event_type")
def ext_tumbling(spark, sf):
    own = T.table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return own.select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations")
def ext_turn_rank(spark, sf):
    by = Window.partitionBy("conv_id")
    rows = T.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))).withColumn("before", F.coalesce(F.lag("role").over(by.orderBy("turn")), F.lit("")))


@query("SELECT event_id, user_id, sum((props->>'$.k')::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events")
def ext_running_tokens(spark, sf):
    along = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return T.table(spark, sf, "events").select("event_id", "user_id", F.sum(F.get_json_object("props", "$.k").cast("long")).over(along).alias("running"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::DECIMAL(18,2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup_usage(spark, sf):
    return T.table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("decimal(18,2)").alias("quantity"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(spark, sf):
    return T.table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT p.event_id, (SELECT max(v.event_id) FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND (v.ts < p.ts OR (v.ts = p.ts AND v.event_id < p.event_id))
  AND v.ts = (SELECT max(w.ts) FROM events w WHERE w.user_id = p.user_id AND w.event_type = 'view' AND (w.ts < p.ts OR (w.ts = p.ts AND w.event_id < p.event_id)))) AS last_view FROM events p WHERE p.event_type = 'purchase'""")
def ext_asof(spark, sf):
    """Each purchase with its user's last view before it: one shuffle and a window, no range join."""
    along = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = T.table(spark, sf, "events").where("event_type in ('view', 'purchase')")
    seen = rows.withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(along))
    return seen.where("event_type = 'purchase'").select("event_id", "last_view")


@query("SELECT e.event_id, p.event_id AS purchase_id FROM events e JOIN events p ON e.user_id = p.user_id AND p.event_type = 'purchase' AND e.event_type = 'error' AND e.ts >= p.ts AND e.ts <= p.ts + INTERVAL 6 HOUR")
def ext_interval_join(spark, sf):
    """Errors within six hours after a purchase, by equal user and six-hour bin or the one before."""
    hours = 6
    events = T.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    bin_ = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (3600 * hours))
    left = events.where("event_type = 'error'").select("event_id", "user_id", F.col("ts").alias("at"), bin_.alias("bin"))
    right = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("from"), F.explode(F.array(bin_, bin_ + 1)).alias("bin"))
    return left.join(right, ["user_id", "bin"]).where(F.col("at").between(F.col("from"), F.col("from") + F.expr(f"interval {hours} hours"))).select("event_id", "purchase_id")


@query("(SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup') EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90")
def ext_set_ops(spark, sf):
    of = lambda c: T.table(spark, sf, "events").where(c).select("user_id")
    return of("event_type = 'purchase'").intersect(of("event_type = 'signup'")).subtract(of("event_type = 'error' and value > 90"))
