"""Server-sent events to canonical events to one transcript row a turn, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.operators.names import unused

#: Events of workflow runs that say nothing to a reader.
SILENT = ("ping", "workflow_started", "node_started", "node_finished")
#: Fixed value: what stands before a failed run's reason.
FAILED = "上游工作流执行失败: "


def split_frames(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, event, data) of raw lines (stream_id, seq, line): a blank line ends a frame, the last event line counts, data lines are joined by newlines, a frame left open at the end counts."""
    along = Window.partitionBy("stream_id").orderBy("seq")
    line = F.regexp_replace("line", "\r$", "")
    number = F.coalesce(F.sum((F.col("own") == "").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = lines.select("stream_id", "seq", line.alias("own")).withColumn("frame", number).where("own <> ''")
    event = F.when(F.col("own").startswith("event:"), F.struct("seq", F.trim(F.expr("substring(own, 7)")).alias("x")))
    data = F.when(F.col("own").startswith("data:"), F.struct("seq", F.expr("ltrim(substring(own, 6))").alias("x")))
    frames = own.groupBy("stream_id", "frame").agg(F.min("seq").alias("seq"), F.max(event).getField("x").alias("event"), F.array_sort(F.collect_list(data)).alias("data"))
    return frames.where((F.size("data") > 0) | F.col("event").isNotNull()).select("stream_id", "seq", "event", F.array_join("data.x", "\n").alias("data"))


def text_at(v: Column, path: str) -> Column:
    """A non-empty string at a path of a variant, else null; numbers and the like are no strings."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.nullif(F.try_variant_get(at, "$", "string"), F.lit("")))


def text_of(data: Column, path: str) -> Column:
    """text_at of JSON text."""
    return text_at(F.try_parse_json(data), path)


def answer_at(v: Column, shown: bool = False) -> Column:
    """The answer of a message as the portal keeps it, null where it is empty: a string as it is, a number as it is written, None, True and False; objects and lists as JSON. shown: as a reader's page shows it, nothing for null, and true and false."""
    at = F.try_variant_get(v, "$.answer", "variant")
    kind, text = F.schema_of_variant(at), F.try_variant_get(at, "$", "string")
    if shown:
        return F.when(kind == "VOID", None).otherwise(F.nullif(text, F.lit("")))
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(F.nullif(text, F.lit("")))


def answer_of(data: Column, shown: bool = False) -> Column:
    """answer_at of JSON text."""
    return answer_at(F.try_parse_json(data), shown)


def reasoning_at(v: Column, within: tuple[str, ...] = ("$",)) -> Column:
    """The first non-empty text of the fields in which models leave their reasoning, in each of some objects."""
    fields = F.array(*[F.try_variant_get(v, f"{w}.{k}", "variant") for w in within for k in ("reasoning_content", "reasoning", "thought")])
    texts = F.transform(fields, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return F.get(F.filter(texts, lambda x: x != ""), 0)


def usage_at(v: Column, at: str = "$.metadata.usage") -> Column:
    """total, else total_tokens, else 0; what isn't a number counts as 0."""
    number = lambda k: F.try_variant_get(v, f"{at}.{k}", "string").try_cast("long")
    return F.coalesce(number("total"), number("total_tokens"), F.lit(0).cast("long"))


def usage_total(data: Column, at: str = "$.metadata.usage") -> Column:
    """usage_at of JSON text."""
    return usage_at(F.try_parse_json(data), at)


def is_object(data: Column) -> Column:
    """Whether text is a JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(data)).startswith("OBJECT"), F.lit(False))


def name_at(event: Column, v: Column) -> Column:
    """The event line's name, else the name within the data."""
    return F.coalesce(F.nullif(event, F.lit("")), F.try_variant_get(v, "$.event", "string"))


def name_of(event: Column, data: Column) -> Column:
    """name_at of JSON text."""
    return name_at(event, F.try_parse_json(data))


def thought_at(name: Column, v: Column) -> Column:
    """The reasoning of a frame; a thought's may lie in an object of its own."""
    return F.when(name == "agent_thought", reasoning_at(v, ("$.data", "$"))).otherwise(reasoning_at(v))


def read(frames: DataFrame, named: str = "said") -> DataFrame:
    """frames with said: name, answer, thought, usage and upstream of each, read from data parsed once."""
    v = unused(frames, "parsed")
    held = frames.withColumn(v, F.try_parse_json("data"))
    name = unused(held, "name_read")
    held = held.withColumn(name, name_at(F.col("event"), F.col(v)))
    at, v = F.col(name), F.col(v)
    told = F.schema_of_variant(F.try_variant_get(v, "$.metadata.usage", "variant")).startswith("OBJECT")
    said = F.struct(
        at.alias("name"),
        F.when(at == "message", answer_at(v)).alias("answer"),
        thought_at(at, v).alias("thought"),
        F.when((at == "message_end") & told, usage_at(v)).alias("usage"),
        F.when(at.isNull() | (at != "reasoning"), F.nullif(F.try_variant_get(v, "$.conversation_id", "string"), F.lit(""))).alias("upstream"),
    )
    return held.select(*frames.columns, said.alias(named))


def translated(frames: DataFrame, named: str = "said") -> DataFrame:
    """translate_chat's rows, with said of the frame (read); an event made of a frame's reasoning holds that alone, the frame itself all else."""
    said = F.col(named)
    frames_read = read(frames, named)
    thought = F.struct(F.lit(0).alias("sub_seq"), F.lit("reasoning").alias("event"), F.to_json(F.struct(said["thought"].alias("content"))).alias("data"))
    itself = F.struct(F.lit(1).alias("sub_seq"), F.coalesce(said["name"], F.lit("message")).alias("event"), F.col("data"))
    has = said["thought"].isNotNull()
    none = F.expr("filter(array(named_struct('sub_seq', 0, 'event', '', 'data', '')), x -> false)")
    out = F.when(said["name"] == "agent_thought", F.when(has, F.array(thought)).otherwise(none)).when((said["name"] == "message") & has, F.array(thought, itself)).otherwise(F.array(itself))
    others = [c for c in frames.columns if c not in ("stream_id", "seq", "event", "data")]
    x = unused(frames_read, "x")
    each = frames_read.select("stream_id", "seq", *others, named, F.explode(out).alias(x))
    first = F.col(f"{x}.sub_seq") == 0
    kept = F.struct(*[F.when(first if k == "thought" else ~first, said[k]).alias(k) for k in ("answer", "thought", "usage", "upstream")])
    return each.select("stream_id", "seq", f"{x}.sub_seq", f"{x}.event", f"{x}.data", *others, kept.alias(named))


def translate_chat(frames: DataFrame) -> DataFrame:
    """(stream_id, seq, sub_seq, event, data) of chat frames, and their other columns.

    Reasoning comes as an event of its own before the message that carries it; thoughts, which may lie
    in an object of their own, become reasoning, empty ones vanish; all else passes as it is.
    """
    named = unused(frames, "said")
    return translated(frames, named).drop(named)


def translate_workflow(frames: DataFrame, redact) -> DataFrame:
    """(stream_id, seq, event, data) of workflow frames: text chunks are messages, a finished run is message_end with its total or, where it failed, an error with the redacted reason; all else goes, what isn't a JSON object too."""
    named = frames.withColumn("name", name_of(F.col("event"), F.col("data"))).where(~F.col("name").isin(*SILENT) & is_object(F.col("data")))
    chunk = F.nullif(F.get_json_object("data", "$.data.text"), F.lit(""))
    ok = F.coalesce(F.get_json_object("data", "$.data.status"), F.lit("")) != "failed"
    total = F.coalesce(F.get_json_object("data", "$.data.total_tokens").try_cast("long"), F.lit(0).cast("long"))
    event = F.when((F.col("name") == "text_chunk") & chunk.isNotNull(), "message").when((F.col("name") == "workflow_finished") & ok, "message_end").when(F.col("name") == "workflow_finished", "error")
    data = F.when(event == "message", F.to_json(F.struct(chunk.alias("answer")))).when(event == "message_end", F.to_json(F.struct(F.struct(F.struct(total.alias("total")).alias("usage")).alias("metadata")))).otherwise(F.to_json(F.struct(F.concat(F.lit(FAILED), redact(F.coalesce(F.get_json_object("data", "$.data.error"), F.lit("")))).alias("message"))))
    return named.select("stream_id", "seq", event.alias("event"), data.alias("data")).where("event is not null")


def usage_of(event: Column, data: Column) -> Column:
    """The total of a message_end that tells its usage."""
    told = F.schema_of_variant(F.try_variant_get(F.try_parse_json(data), "$.metadata.usage", "variant")).startswith("OBJECT")
    return F.when((event == "message_end") & told, usage_total(data))


def upstream_of(event: Column, data: Column) -> Column:
    """The conversation id of any event but reasoning, which is ours."""
    return F.when(event != "reasoning", F.nullif(F.get_json_object(data, "$.conversation_id"), F.lit("")))


def fold(events: DataFrame) -> DataFrame:
    """One row a stream: answers and reasoning joined in order, the last usage there is, the last conversation id, and whether an error came. Streams without an answer give no row."""
    v = unused(events, "parsed")
    held = events.withColumn(v, F.try_parse_json("data"))
    event, told = F.col("event"), F.schema_of_variant(F.try_variant_get(F.col(v), "$.metadata.usage", "variant")).startswith("OBJECT")
    said = F.struct(
        F.when(event == "message", answer_at(F.col(v))).alias("answer"),
        F.when(event == "reasoning", text_at(F.col(v), "$.content")).alias("thought"),
        F.when((event == "message_end") & told, usage_at(F.col(v))).alias("usage"),
        F.when(event != "reasoning", F.nullif(F.try_variant_get(F.col(v), "$.conversation_id", "string"), F.lit(""))).alias("upstream"),
    )
    return folded(held.select("stream_id", "seq", "sub_seq", "event", said.alias("said")))


def folded(events: DataFrame, named: str = "said") -> DataFrame:
    """fold of events that were read already (translated)."""
    at, said = F.struct("seq", "sub_seq"), F.col(named)
    ordered = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("seq", "sub_seq", c.alias("x"))))).getField("x"), "")
    rows = events.groupBy("stream_id").agg(
        ordered(said["answer"]).alias("content"),
        ordered(said["thought"]).alias("reasoning"),
        F.max_by(said["usage"], F.when(said["usage"].isNotNull(), at)).alias("total_tokens"),
        F.max_by(said["upstream"], F.when(said["upstream"].isNotNull(), at)).alias("upstream_id"),
        F.max((F.col("event") == "error").cast("int")).alias("failed"),
    )
    return rows.where("content <> ''")


def closing(reason: Column) -> Column:
    """What the error that ends a stream says, null where the reason is none."""
    return F.when(reason.startswith("http_"), F.concat(F.lit("Upstream error: "), F.expr("substring(reason, 6)"))).when(reason == "timeout", "Upstream timeout").when(reason == "proxy_error", "Proxy error")


def closed(streams: DataFrame) -> DataFrame:
    """The events that end each stream (stream_id, reason): an error where the reason is one, and agent_done, but nothing after a reader's abort."""
    reason = F.col("reason")
    text = closing(reason)
    failed = F.struct(F.lit(0).alias("sub_seq"), F.lit("error").alias("event"), F.to_json(F.struct(text.alias("message"))).alias("data"))
    done = F.struct(F.lit(1).alias("sub_seq"), F.lit("agent_done").alias("event"), F.to_json(F.struct(F.col("stream_id").cast("string").alias("conversation_id"))).alias("data"))
    rows = streams.where("reason <> 'client_abort'").select("stream_id", F.explode(F.when(text.isNotNull(), F.array(failed, done)).otherwise(F.array(done))).alias("x"))
    return rows.select("stream_id", "x.sub_seq", "x.event", "x.data")


def sse(event: Column, data: Column) -> Column:
    """An event as the text that a browser's event source reads."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.coalesce(data, F.lit("{}")), F.lit("\n\n"))


def lines_of_chunks(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, line) of chunks of text (stream_id, seq, chunk) that may end within a line; carriage returns at line ends go, seq numbers a stream's lines from 0. A stream is one turn, so its text is one row's."""
    whole = chunks.groupBy("stream_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).getField("chunk"), "").alias("text"))
    lines = whole.select("stream_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return lines.select("stream_id", F.col("seq").cast("long").alias("seq"), F.regexp_replace("line", "\r$", "").alias("line"))


def dispatched(frames: DataFrame, known: tuple[str, ...] = ("message", "reasoning", "message_end", "error", "agent_done")) -> DataFrame:
    """(stream_id, seq, event, data) as a reader's page takes frames: without a name they are messages, unknown names are ignored, and data that isn't JSON is {}."""
    event = F.coalesce(F.nullif("event", F.lit("")), F.lit("message"))
    data = F.when(F.try_parse_json("data").isNotNull(), F.col("data")).otherwise("{}")
    return frames.select("stream_id", "seq", event.alias("event"), data.alias("data")).where(F.col("event").isin(*known))


#: What a reader's page shows for an error that says nothing, and for a connection that breaks.
NO_REASON, BROKEN = "回答生成失败，请重试", "连接中断，请重试"


def states(events: DataFrame, closes: DataFrame) -> DataFrame:
    """(stream_id, status, content) as a reader's page has each stream at its end (closes: stream_id, reason).

    The last error's message takes the place of what came before it, and answers after it follow it.
    An error stays one though agent_done follows; how the stream ended may add an error (closed) or, for
    connection_lost, the page's own. A reader's abort is done, with what stands there, an error's message too.
    """
    v, at = unused(events, "parsed"), F.struct("seq", "sub_seq")
    held = events.withColumn(v, F.try_parse_json("data"))
    said = held.select("stream_id", "seq", "sub_seq", F.when(F.col("event") == "message", answer_at(F.col(v), True)).alias("answer"), F.when(F.col("event") == "error", F.coalesce(F.nullif(F.try_variant_get(F.col(v), "$.message", "string"), F.lit("")), F.lit(NO_REASON))).alias("wrong"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("answer").isNotNull(), F.struct("seq", "sub_seq", F.col("answer").alias("x")))))
    last = F.max(F.when(F.col("wrong").isNotNull(), F.struct("seq", "sub_seq", "wrong")))
    rows = said.groupBy("stream_id").agg(pieces.alias("pieces"), last.alias("last"))
    after = F.when(F.col("last").isNull(), F.col("pieces")).otherwise(F.filter("pieces", lambda p: F.struct(p["seq"], p["sub_seq"]) > F.struct(F.col("last.seq"), F.col("last.sub_seq"))))
    shown = rows.select("stream_id", F.col("last").isNotNull().alias("failed"), F.concat(F.coalesce("last.wrong", F.lit("")), F.array_join(after.getField("x"), "")).alias("text"))
    reason = F.col("reason")
    end = F.coalesce(closing(reason), F.when(reason == "connection_lost", BROKEN))
    status = F.when(end.isNotNull(), "error").when((reason != "client_abort") & F.col("failed"), "error").otherwise("done")
    return closes.join(shown, "stream_id", "left").select("stream_id", status.alias("status"), F.coalesce(end, "text", F.lit("")).alias("content"))
