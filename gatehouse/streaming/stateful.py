"""Structured Streaming over the given tables: input in parts that arrive one after the other, results by micro-batch, and what is made of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatehouse.operators import turns
from gatehouse.sources import captures
from gatehouse.sources import tables as T
from gatehouse.sources.scratch import shared_dir, written
from gatehouse.streaming import machines, sinks


def folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ranges(rows: DataFrame, order: str, parts: int) -> list[DataFrame]:
    """rows in so many parts by ranges of order, of about equal size; null comes first."""
    cuts = rows.agg(F.percentile_approx(order, [(k + 1) / parts for k in range(parts - 1)], 10_000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        own = rows
        if low is not None:
            own = own.where(F.col(order) > F.lit(low))
        if high is not None:
            own = own.where(F.col(order).isNull() | (F.col(order) <= F.lit(high)) if low is None else F.col(order) <= F.lit(high))
        out.append(own)
    return out


def arrived(spark: SparkSession, parts: list[DataFrame], path: str, files: int = 2) -> None:
    """Adds parts to the files in path, one after the other, so that a stream reads them in this order."""
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)


def split(spark: SparkSession, rows: DataFrame, order: str, parts: int) -> str:
    """A folder with rows in parts by ranges of order: a stream's input where a table is one file."""
    path = folder(spark, "stream")
    arrived(spark, ranges(rows, order, parts), path)
    return path


def streamed(spark: SparkSession, path: str, files_a_batch: int = 2) -> DataFrame:
    """A folder's Parquet files as a stream, in the order in which they were written, so many a micro-batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run(stream: DataFrame, mode: str, path: str | None = None, polled: bool = False) -> DataFrame:
    """All rows that a stream sends until its input is used up, with batch, the micro-batch that sent them; they are written to the shared folder, a batch that runs again in its own place.

    With path, what an earlier run there has read isn't read again, and its rows are among the results.
    polled: for sources that can't tell beforehand where a run is to end (those written in Python): they
    are asked until there is nothing new, and timers have fired.
    """
    spark = stream.sparkSession
    path = path or folder(spark, "sent")

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/n{n}")

    with machines.typed_state(spark):
        when = {"processingTime": "0 seconds"} if polled else {"availableNow": True}
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(**when).foreachBatch(write).start()
    try:
        query.processAllAvailable() if polled else query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{path}/*")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key that the last micro-batch sent."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")


def beat(rows: DataFrame, key: str, order: str, at: str, after: str) -> DataFrame:
    """One row of rows' columns, the first one of the key -1 and a time so long after the last: it moves the watermark past all others."""
    kind = dict(rows.dtypes)
    last = rows.agg(F.max(at).alias(at)).select((F.col(at) + F.expr(f"interval {after}")).alias(at), F.lit(-1).cast(kind[key]).alias(key), F.lit(0).cast(kind[order]).alias(order))
    return rows.limit(0).unionByName(last, allowMissingColumns=True).where(F.col(at).isNotNull())


def _turns(spark: SparkSession, sf_dir: str, silence: str, after: str) -> DataFrame:
    """Turns of all frames made of events, in several micro-batches and closed by the watermark. Events come in the order of their time, whatever their ids, so none is late."""
    events = T.table(spark, sf_dir, "events")
    path = folder(spark, "stream")
    *first, last = ranges(events, "ts", 3)
    arrived(spark, [*first, last.unionByName(beat(events, "user_id", "event_id", "ts", after))], path)
    frames = T.frames_of(streamed(spark, path)).withColumn("at", F.col("ts"))
    return run(machines.fold_turns(turns.translate_chat(frames), late="10 minutes", silence=silence), "append").where("stream_id >= 0").drop("batch")


def fold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames folded by stream: one turn each, as none is silent for 40 days."""
    return _turns(spark, sf_dir, "40 days", "50 days").where("content <> ''").drop("status", "started")


def turns_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames as turns that end with twelve hours of silence."""
    return _turns(spark, sf_dir, "12 hours", "2 days").withColumn("started", F.col("started").cast("timestamp_ntz"))


def _pieces(text: F.Column) -> F.Column:
    """Bytes of text in pieces of 1, 2, … 7, 1, 2, … bytes."""
    raw = F.encode(text, "utf-8")
    n = F.octet_length(raw)
    places = F.sequence(F.lit(0), 7 * F.floor(n / 28).cast("int") + 6)
    start = lambda j: 28 * F.floor(j / 7).cast("int") + (j % 7 * (j % 7 + 1) / 2).cast("int")
    return F.transform(F.filter(places, lambda j: start(j) < n), lambda j: F.substring(raw, start(j) + 1, j % 7 + 1))


def _frame_text(before: str, after: str) -> F.Column:
    event = F.when(F.col("event").isNotNull(), F.concat(F.lit("event: "), F.col("event"), F.lit("\r\n"))).otherwise("")
    return F.concat(F.lit(before), event, F.lit("data: "), F.col("data"), F.lit(after))


def frames_of_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames out of logs of chunks of 1 to 7 bytes, which cut code points, lines and frames anywhere.

    Blank lines stand before frames, so each stream's last one is unfinished until the stream is
    silent. The logs come in two parts by time, so none is late, whatever its id; between them the stream stops and starts again from its checkpoint.
    """
    frames = T.frames_of(T.table(spark, sf_dir, "events")).withColumn("data", F.concat("data", F.lit(" ü你😀")))
    cut = frames.select("stream_id", "seq", F.col("ts").alias("at"), _pieces(_frame_text("\n\r\n", "")).alias("pieces"))
    before = F.coalesce(F.sum(F.size("pieces")).over(Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = written(cut.withColumn("before", before), "pieces")
    logs, sent = folder(spark, "log"), folder(spark, "sent")
    numbered = lambda df: df.select("stream_id", "at", "before", F.posexplode("pieces").alias("k", "chunk")).select("stream_id", (F.col("before") + F.col("k")).alias("seq"), "at", "chunk")
    first, last = ranges(held, "at", 2)
    end = beat(held.select("stream_id", F.col("before").alias("seq"), "at"), "stream_id", "seq", "at", "50 days").withColumn("chunk", F.lit(b""))
    for part in (numbered(first), numbered(last).unionByName(end)):
        captures.capture(part, logs)
        out = run(machines.split_frames(captures.chunks_of(captures.stream_lines(spark, logs)), silence="40 days"), "append", sent, polled=True)
    return out.where("stream_id >= 0").select("stream_id", "n", F.coalesce("event", F.lit("")).alias("event"), "data")


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, one a chunk, written to logs in two parts and read by a stream that is started again for the second: none is lost, none comes twice."""
    frames = T.frames_of(T.table(spark, sf_dir, "events"))
    chunks = frames.select("stream_id", "seq", F.col("ts").alias("at"), F.encode(_frame_text("", "\n\n"), "utf-8").alias("chunk"))
    logs, sent = folder(spark, "log"), folder(spark, "sent")
    for part in ranges(chunks, "seq", 2):
        captures.capture(part, logs)
        out = run(captures.chunks_of(captures.stream_lines(spark, logs, split=4 << 20)), "append", sent, polled=True)
    lines = F.split(F.decode("chunk", "utf-8"), "\r?\n")
    told = lambda k: F.get(F.filter(lines, lambda x: x.startswith(k)), 0)
    return out.select("stream_id", "seq", F.coalesce(F.substring(told("event: "), 8, 1 << 30), F.lit("")).alias("event"), F.substring(told("data: "), 7, 1 << 30).alias("data"))


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each audit row as a request of up to 76 tokens against its user's bucket of 100, which gets three an hour. Requests come in the order of their time, whatever their ids, so none is late."""
    asked = T.audit(spark, sf_dir).select("id", "user_id", F.col("created_at").alias("at"), (15 * (F.col("tokens") % 6) + 1).alias("cost"))
    stream = streamed(spark, split(spark, asked, "at", 3))
    return run(machines.limited(stream, 100, "20 minutes"), "append").drop("batch")


def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late audit rows put into the table as a stream brings them, some of them twice: replays are dropped within the watermark, and the sink takes a key's first row only."""
    rows = T.audit(spark, sf_dir).select("id", "user_id", "action", F.col("created_at").cast("timestamp").alias("at"))
    held = rows.where("id % 7 > 0").select("id", "action", F.concat(F.lit("e"), F.col("id").cast("string")).alias("key"))
    late = rows.where("id % 7 = 0").select((F.col("id") + 10_000_000).alias("id"), "action", "at", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"))
    known = rows.where("id % 7 = 1").select((F.col("id") + 20_000_000).alias("id"), "action", "at", F.concat(F.lit("e"), F.col("id").cast("string")).alias("key"))
    again = late.where("id % 2 = 0")
    path = split(spark, late.unionByName(known).unionByName(again), "at", 3)
    stream = streamed(spark, path).withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["id"])
    target = folder(spark, "audit")
    sinks.written_once(stream.drop("at"), held, target, "key", "id")
    return sinks.with_held(spark, held, target).select("id", "action")


def _counted(events: DataFrame, width: str, slide: str | None, late: str = "1 hour") -> DataFrame:
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = own.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("day"), "event_type", "n")


def _by_day(rows: DataFrame) -> DataFrame:
    return latest(rows, ["day", "event_type"]).withColumn("day", F.col("day").cast("timestamp_ntz"))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and type, counted as a stream: each micro-batch sends the windows it changes, the last row of a window counts; windows that the watermark has passed are forgotten."""
    return _by_day(run(_counted(streamed(spark, split(spark, T.table(spark, sf_dir, "events"), "ts", 3)), "1 day", None), "update"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for windows of two days that begin every day."""
    return _by_day(run(_counted(streamed(spark, split(spark, T.table(spark, sf_dir, "events"), "ts", 3)), "2 days", "1 day"), "update"))


def with_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts a day where every fiftieth event comes after all others: those of days that the watermark, a day behind the last event, has passed are left out, the others still count."""
    events, path, sent = T.table(spark, sf_dir, "events"), folder(spark, "stream"), folder(spark, "sent")
    for part in (events.where("event_id % 50 > 0"), events.where("event_id % 50 = 0")):
        arrived(spark, ranges(part, "ts", 2), path)
        rows = run(_counted(streamed(spark, path), "1 day", None, "1 day"), "update", sent)
    return _by_day(rows)


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams, clicks and purchases, joined by user and within six hours; both watermarks and the time bound let Spark forget what can't match any more."""
    path = split(spark, T.table(spark, sf_dir, "events"), "ts", 3)
    ts = F.col("ts").cast("timestamp")
    one = streamed(spark, path).where("event_type = 'click'").select(F.col("user_id"), F.col("event_id").alias("click_id"), ts.alias("clicked")).withWatermark("clicked", "1 hour")
    two = streamed(spark, path).where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("event_id").alias("purchase_id"), ts.alias("bought")).withWatermark("bought", "1 hour")
    met = one.join(two, F.expr("user_id = buyer and bought >= clicked and bought <= clicked + interval 6 hours"))
    return run(met.select("user_id", "click_id", "purchase_id"), "append").drop("batch")
