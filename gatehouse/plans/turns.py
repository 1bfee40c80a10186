"""Queries over event streams, in batch and as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatehouse.functions import scalars
from gatehouse.operators import turns
from gatehouse.plans.register import query
from gatehouse.sources import tables as T
from gatehouse.sources.tables import sql
from gatehouse.streaming import stateful

def _text(path: str) -> str:
    return f"CASE WHEN json_type(j, '{path}') = 'VARCHAR' THEN nullif(j->>'{path}', '') END"


_TOP = f"coalesce({_text('$.reasoning_content')}, {_text('$.reasoning')}, {_text('$.thought')})"
_NAMED = f"""(SELECT *, coalesce(event, j->>'$.event') AS name, coalesce(CASE WHEN coalesce(event, j->>'$.event') = 'agent_thought' THEN coalesce({_text('$.data.reasoning_content')}, {_text('$.data.reasoning')}, {_text('$.data.thought')}) END, {_TOP}) AS reasoning
  FROM (SELECT *, CASE WHEN json_valid(data) THEN data::JSON END AS j FROM frames))"""
_EVENTS = f"""(SELECT stream_id, seq, 0 AS sub_seq, 'reasoning' AS event, '{{"content":"' || reasoning || '"}}' AS data FROM {_NAMED} WHERE name IN ('message', 'agent_thought') AND reasoning IS NOT NULL
  UNION ALL SELECT stream_id, seq, 1, coalesce(name, 'message'), data FROM {_NAMED} WHERE name IS DISTINCT FROM 'agent_thought')"""


@query(sql(f"SELECT * FROM {_EVENTS}"))
def event_translate(spark, sf):
    return turns.translate_chat(T.frames(spark, sf))


ANSWER = "CASE json_type(data, '$.answer') WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN upper(left(data->>'$.answer', 1)) || substr(data->>'$.answer', 2) ELSE data->>'$.answer' END"
FOLD = f"""SELECT * FROM (SELECT stream_id, coalesce(string_agg(CASE WHEN event = 'message' THEN {ANSWER} END, '' ORDER BY seq, sub_seq), '') AS content,
  coalesce(string_agg(CASE WHEN event = 'reasoning' THEN data->>'$.content' END, '' ORDER BY seq, sub_seq), '') AS reasoning,
  arg_max((data->>'$.metadata.usage.total_tokens')::BIGINT, seq) FILTER (WHERE event = 'message_end' AND json_type(data, '$.metadata.usage') = 'OBJECT') AS total_tokens,
  arg_max(data->>'$.conversation_id', seq) FILTER (WHERE event <> 'reasoning' AND coalesce(data->>'$.conversation_id', '') <> '') AS upstream_id, max(CASE WHEN event = 'error' THEN 1 ELSE 0 END) AS failed
  FROM (SELECT * REPLACE (CASE WHEN json_valid(data) THEN data END AS data) FROM {_EVENTS}) GROUP BY stream_id) WHERE content <> ''"""


@query(sql(FOLD))
def event_fold_turns(spark, sf):
    return turns.folded(turns.translated(T.frames(spark, sf)))


@query(sql(FOLD))
def event_fold_turns_streamed(spark, sf):
    """The same fold with state kept between micro-batches."""
    return stateful.fold_events(spark, sf)


@query(sql(f"SELECT stream_id, seq, reasoning FROM {_NAMED} WHERE reasoning IS NOT NULL"))
def reasoning_extract(spark, sf):
    found = turns.read(T.frames(spark, sf)).select("stream_id", "seq", F.col("said.thought").alias("reasoning"))
    return found.where("reasoning is not null")


@query(sql("SELECT stream_id, seq, coalesce((CASE WHEN json_valid(data) THEN data->>'$.metadata.usage.total_tokens' END)::BIGINT, 0) AS total FROM frames"))
def usage_normalise(spark, sf):
    return T.frames(spark, sf).select("stream_id", "seq", turns.usage_total(F.col("data")).alias("total"))


@query(sql("SELECT stream_id, seq, coalesce(event, '') AS event, data FROM frames"))
def frame_split(spark, sf):
    """Frames written as lines and put together again."""
    frames = T.frames(spark, sf)
    lines = F.array(F.when(F.col("event").isNotNull(), F.concat(F.lit("event: "), F.col("event"), F.lit("\r"))), F.concat(F.lit("data: "), F.col("data")), F.lit(""))
    raw = frames.select("stream_id", "seq", F.posexplode(lines).alias("k", "line")).where("line is not null")
    split = turns.split_frames(raw.select("stream_id", (F.col("seq") * 3 + F.col("k")).alias("seq"), "line"))
    return split.select("stream_id", F.floor(F.col("seq") / 3).alias("seq"), F.coalesce("event", F.lit("")).alias("event"), "data")


@query(sql("""SELECT stream_id, seq, event, data FROM (SELECT id AS seq, user_id AS stream_id, CASE WHEN action = 'view' THEN 'message' WHEN action = 'purchase' OR (action = 'error' AND id % 3 > 0) THEN 'message_end' WHEN action = 'error' THEN 'error' END AS event,
  CASE WHEN action = 'view' THEN '{"answer":"x' || id || '"}' WHEN action = 'purchase' THEN '{"metadata":{"usage":{"total":' || tokens || '}}}' WHEN id % 3 > 0 THEN '{"metadata":{"usage":{"total":0}}}' ELSE '{"message":"上游工作流执行失败: see [url] now"}' END AS data FROM audit) WHERE event IS NOT NULL"""))
def workflow_translate(spark, sf):
    """Chunks, runs that succeeded, failed, were stopped, and that end without a status or data."""
    n, action = F.col("id").cast("string"), F.col("action")
    data = (
        F.when(action == "view", F.concat(F.lit('{"event":"text_chunk","data":{"text":"x'), n, F.lit('"}}')))
        .when(action == "purchase", F.concat(F.lit('{"event":"workflow_finished","data":{"status":"succeeded","total_tokens":'), F.col("tokens").cast("string"), F.lit("}}")))
        .when((action == "error") & (F.col("id") % 3 == 1), F.lit('{"event":"workflow_finished","data":{"status":"stopped"}}'))
        .when((action == "error") & (F.col("id") % 3 == 2), F.lit('{"event":"workflow_finished"}'))
        .when(action == "error", F.lit('{"event":"workflow_finished","data":{"status":"failed","error":"see https://a.b/c?d now"}}'))
        .when(action == "signup", F.lit("no JSON"))
        .otherwise(F.lit('{"event":"node_started"}'))
    )
    frames = T.audit(spark, sf).select(F.col("user_id").alias("stream_id"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("event"), data.alias("data"))
    return turns.translate_workflow(frames, scalars.redacted)


_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = f"'^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'"


@query(rf"""SELECT doc_id, regexp_replace(coalesce(nullif(left(CASE WHEN joined = '' THEN x ELSE joined END, 200), ''), 'workflow failed'), {_STRIP}) AS reason FROM (
  SELECT doc_id, x, array_to_string(list_filter(list_transform(list_filter(string_split_regex(x, '\r\n|\r|\n'), lambda s: length(s) <= 120), lambda s: regexp_replace(s, {_STRIP})), lambda s: s <> ''), ' ') AS joined FROM (
  SELECT doc_id, regexp_replace(regexp_replace(text, 'https?://[^{_SPACE}]+', '[url]', 'g'), {_STRIP}) AS x FROM documents))""")
def error_redact(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", scalars.redacted(F.col("text")).alias("reason"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY day, event_type")
def stream_tumbling_counts(spark, sf):
    return stateful.tumbling(spark, sf)


@query("SELECT s AS day, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS s, event_type FROM events) GROUP BY day, event_type")
def stream_sliding_counts(spark, sf):
    return stateful.sliding(spark, sf)


@query("SELECT a.user_id, a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_click_purchases(spark, sf):
    return stateful.joined(spark, sf)


@query(sql(f"""SELECT stream_id, min(ts) AS started, coalesce(string_agg(CASE WHEN event = 'message' THEN {ANSWER} END, '' ORDER BY seq, sub_seq), '') AS content, coalesce(string_agg(CASE WHEN event = 'reasoning' THEN data->>'$.content' END, '' ORDER BY seq, sub_seq), '') AS reasoning,
  arg_max((data->>'$.metadata.usage.total_tokens')::BIGINT, seq) FILTER (WHERE event = 'message_end' AND json_type(data, '$.metadata.usage') = 'OBJECT') AS total_tokens,
  arg_max(data->>'$.conversation_id', seq) FILTER (WHERE event <> 'reasoning' AND coalesce(data->>'$.conversation_id', '') <> '') AS upstream_id, max(CASE WHEN event = 'error' THEN 1 ELSE 0 END) AS failed,
  CASE WHEN bool_or(event = 'error') THEN 'error' WHEN bool_or(event = 'message_end') THEN 'done' ELSE 'aborted' END AS status
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY seq, sub_seq ROWS UNBOUNDED PRECEDING) AS turn FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY seq, sub_seq) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh
    FROM (SELECT f.* REPLACE (CASE WHEN json_valid(f.data) THEN f.data END AS data), e.ts FROM {_EVENTS} f JOIN events e ON e.event_id = f.seq))) GROUP BY stream_id, turn"""))
def turns_closed_streamed(spark, sf):
    """Turns closed by the watermark after twelve hours of silence: error, done, or aborted with what came until then."""
    return stateful.turns_closed(spark, sf)


@query(sql("SELECT stream_id, (row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1)::BIGINT AS n, coalesce(event, '') AS event, data || ' ü你😀' AS data FROM frames"))
def chunks_to_frames_streamed(spark, sf):
    return stateful.frames_of_bytes(spark, sf)


@query(sql("SELECT stream_id, seq, coalesce(event, '') AS event, data FROM frames"))
def frames_captured(spark, sf):
    return stateful.captured(spark, sf)


@query(sql("""SELECT id, user_id, outcome, tokens_left FROM (WITH RECURSIVE a AS (SELECT id, user_id, epoch_ms(created_at) AS ms, 15 * (tokens % 6) + 1 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS n FROM audit),
  d AS (SELECT id, user_id, n, ms, 'allow' AS outcome, ms + cost * 1200000 AS full_at FROM a WHERE n = 1
    UNION ALL SELECT a.id, a.user_id, a.n, a.ms, CASE WHEN greatest(d.full_at, a.ms) + a.cost * 1200000 - a.ms <= 120000000 THEN 'allow' ELSE 'deny' END, CASE WHEN greatest(d.full_at, a.ms) + a.cost * 1200000 - a.ms <= 120000000 THEN greatest(d.full_at, a.ms) + a.cost * 1200000 ELSE d.full_at END FROM d JOIN a ON a.user_id = d.user_id AND a.n = d.n + 1)
  SELECT id, user_id, outcome, greatest(0, 100 - (greatest(0, full_at - ms) + 1199999) // 1200000)::BIGINT AS tokens_left FROM d)"""))
def rate_limit_decisions(spark, sf):
    """Allow or deny, request by request."""
    return stateful.limited(spark, sf)


@query(sql("SELECT id, action FROM audit WHERE id % 7 > 0 UNION ALL SELECT min(id) + 10000000, arg_min(action, id) FROM audit WHERE id % 7 = 0 GROUP BY user_id"))
def audit_backfilled_streamed(spark, sf):
    return stateful.backfilled(spark, sf)


@query("""SELECT day, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, event_id, (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events WHERE event_id % 50 > 0) AS mark FROM events)
  WHERE event_id % 50 > 0 OR day + INTERVAL 1 DAY > mark GROUP BY day, event_type""")
def stream_late_counts(spark, sf):
    return stateful.with_late_rows(spark, sf)
