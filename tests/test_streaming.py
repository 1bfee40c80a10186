"""State across micro-batches, late data, and files as sources."""

import datetime
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from gatehouse.operators import changes, limits, turns
from gatehouse.plans.registry import ORACLE_SQL, QUERIES
from gatehouse.sources import captures, files, scratch
from gatehouse.streaming import machines, sinks, stateful

EVENT = "stream_id long, seq long, sub_seq int, event string, data string, at timestamp"
START = datetime.datetime(2024, 1, 1)


def put(spark, folder, batches):
    """One file a batch, in the order of their times."""
    for k, rows in enumerate(batches):
        held = [(s, q, b, e, d, START + datetime.timedelta(minutes=m)) for s, q, b, e, d, m in rows]
        part = f"{folder}/.{k}"
        spark.createDataFrame(held, EVENT).coalesce(1).write.parquet(part)
        name = next(n for n in os.listdir(part) if n.startswith("part"))
        os.rename(f"{part}/{name}", f"{folder}/{k}.parquet")
        os.utime(f"{folder}/{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))


def said(x):
    return '{"answer":"%s"}' % x


BATCHES = [
    [(1, 2, 1, "message", said("b"), 1), (2, 1, 1, "message", said("part"), 1), (3, 1, 1, "message", said("x"), 1)],
    [(1, 1, 1, "message", said("a"), 2), (1, 1, 0, "reasoning", '{"content":"why"}', 2), (3, 2, 1, "error", "boom", 2), (3, 3, 1, "message_end", "{}", 2)],
    [(1, 4, 1, "message_end", '{"conversation_id":"c1","metadata":{"usage":{"total":9}}}', 3), (1, 5, 1, "message_end", '{"conversation_id":"c2"}', 3), (1, 3, 1, "message", '{"answer":5}', 3)],
    [(9, 1, 1, "message", said("z"), 10_000)],
    [(9, 2, 1, "message", said("y"), 20_000), (2, 2, 1, "message", said("too late"), 2)],
]


def test_turns_cross_micro_batches_out_of_order_and_time_out(spark, tmp_path):
    put(spark, str(tmp_path), BATCHES)
    rows = stateful.run(machines.fold_turns(stateful.streamed(spark, str(tmp_path), 1), "10 minutes", "1 hour"), "append")
    told = {(r.stream_id, r.content): r for r in rows.collect()}
    assert len(told) == rows.count()
    one = told[1, "ab5"]
    assert (one.reasoning, one.total_tokens, one.upstream_id, one.status, one.failed, str(one.started)) == ("why", 9, "c2", "done", 0, "2024-01-01 00:01:00")
    # What came before the abort is kept, and what comes after the watermark isn't taken.
    assert told[2, "part"].status == "aborted"
    assert (told[3, "x"].status, told[3, "x"].failed) == ("error", 1)
    # A stream that speaks again after the silence has another turn; the last one isn't over yet.
    assert {k for k in told if k[0] == 9} == {(9, "z")} and told[9, "z"].status == "aborted"


def test_turns_are_told_as_they_grow(spark, tmp_path):
    put(spark, str(tmp_path), BATCHES)
    rows = stateful.run(machines.fold_turns(stateful.streamed(spark, str(tmp_path), 1), "10 minutes", "1 hour", progress=True), "update")
    assert [(r.content, r.status) for r in rows.where("stream_id = 1").orderBy("batch").collect()][:3] == [("b", "open"), ("ab", "open"), ("ab5", "done")]


def chunk_log(spark, folder, rows):
    held = [(s, q, START + datetime.timedelta(minutes=m), raw) for s, q, m, raw in rows]
    captures.capture(spark.createDataFrame(held, "stream_id long, seq long, at timestamp, chunk binary"), str(folder))


def test_frames_cross_chunks_batches_and_restarts(spark, tmp_path):
    text = 'event: message\r\ndata: {"answer":"你😀"}\r\n\r\n\ndata: a\ndata: b\n\n: a comment\n\nevent: message_end\ndata: {}'.encode()
    pieces = [text[i : i + 3] for i in range(0, len(text), 3)]
    logs, sent = tmp_path / "logs", str(tmp_path / "sent")
    numbered = [(1, k, k, raw) for k, raw in enumerate(pieces)]

    def read():
        return stateful.run(machines.split_frames(captures.chunks_of(captures.stream_lines(spark, str(logs))), silence="5 hours"), "append", sent, polled=True)

    # The chunks of the first part lack one that comes with the second; another comes twice.
    chunk_log(spark, logs, [x for x in numbered[:12] if x[1] != 4] + [(2, 0, 1, b"data: open"), (3, 1, 1, b"data: behind a gap\n\ndata: y")])
    assert read().count() == 0
    chunk_log(spark, logs, [numbered[4], numbered[7], *numbered[12:], (2, 1, 9, b" end")])
    frames = {(r.stream_id, r.n): (r.event, r.data) for r in read().collect()}
    assert frames == {(1, 0): ("message", '{"answer":"你😀"}'), (1, 1): (None, "a\nb")}
    # After the silence unfinished frames count, and so does what waited behind a gap.
    chunk_log(spark, logs, [(8, 0, 10_000, b"x")])
    rows = read()
    frames = {(r.stream_id, r.n): (r.event, r.data) for r in rows.collect()}
    assert rows.count() == len(frames) == 6
    assert [frames[k] for k in ((1, 2), (2, 0), (3, 0), (3, 1))] == [("message_end", "{}"), (None, "open end"), (None, "behind a gap"), (None, "y")]


@pytest.mark.parametrize("step", [1, 2, 5, 1000])
def test_cut_frames(step):
    raw = b"\n\r\ndata: a\n\r\n\ndata: b\r\n\r\n\n\nevent: c\n\ndata: \xff\ndata: d"
    held, out = b"", []
    for i in range(0, len(raw), step):
        found, held = machines.cut_frames(held, raw[i : i + step])
        out += found
    parsed = [x for x in map(machines.parse_frame, [*out, held]) if x]
    assert parsed == [(None, "a"), (None, "b"), ("c", ""), (None, "\ufffd\nd")]


def test_captured_lines_grow(spark, tmp_path):
    logs, sent = tmp_path / "logs", str(tmp_path / "sent")
    logs.mkdir()

    def read():
        rows = stateful.run(captures.stream_lines(spark, str(logs), split=7), "append", sent, polled=True)
        return sorted((r.file, r.at, r.line) for r in rows.collect())

    def wanted(**files):
        out = []
        for name, raw in files.items():
            at = 0
            for line in raw.encode().split(b"\n")[:-1]:
                out.append((name, at, line.decode()))
                at += len(line) + 1
        return sorted(out)

    a, b = "one\n\nthree is a longer line, across splits\n", "x\n"
    (logs / "a").write_text(a + "unfin")
    (logs / "_hidden").write_text("no\n")
    assert read() == wanted(a=a)
    (logs / "a").write_text(a + "unfinished, no more\nlast 你\nopen")
    (logs / "b").write_text(b)
    assert read() == wanted(a=a + "unfinished, no more\nlast 你\n", b=b)
    assert read() == wanted(a=a + "unfinished, no more\nlast 你\n", b=b)


def test_rate_limit(spark, tmp_path):
    asked = "id long, user_id long, at timestamp, cost long"
    at = lambda s: START + datetime.timedelta(seconds=s)
    parts = [
        [(1, 1, at(0), 2), (2, 1, at(1), 1), (3, 1, at(1), 1), (4, 2, at(0), 4), (5, 2, at(0), 3)],
        [(6, 1, at(20), 3), (7, 1, at(21), 1), (8, 2, at(5), 1)],
        # Of 500 seconds later, and one that comes late but within the watermark, after a later one was decided.
        [(9, 1, at(520), 3)],
        [(10, 1, at(515), 1)],
        [(11, 3, at(900), 1)],
        # Too late for a decision.
        [(12, 1, at(30), 1)],
    ]
    stateful.arrived(spark, [spark.createDataFrame(p, asked).coalesce(1) for p in parts], str(tmp_path / "in"), files=1)
    rows = stateful.run(machines.limited(stateful.streamed(spark, str(tmp_path / "in"), 1), 3, "10 seconds", "100 seconds"), "append").collect()
    # A bucket of three, one more each ten seconds: a denied request takes nothing.
    assert {r.id: (r.outcome, r.tokens_left) for r in rows} == {
        1: ("allow", 1), 2: ("allow", 0), 3: ("deny", 0), 4: ("deny", 3), 5: ("allow", 0), 6: ("deny", 2), 7: ("allow", 1), 8: ("deny", 0), 9: ("allow", 0), 10: ("deny", 0), 11: ("allow", 2),
    }


def test_a_batch_that_runs_twice_writes_once(spark, tmp_path):
    schema = "id long, key string, at timestamp"
    held = spark.createDataFrame([(1, "a")], "id long, key string")
    rows = [[(10, "a", START), (12, "b", START), (11, "b", START)], [(20, "b", START), (21, "c", START), (22, "c", START)], [(30, "c", START), (31, "d", START)]]
    stateful.arrived(spark, [spark.createDataFrame(r, schema).coalesce(1) for r in rows], str(tmp_path / "in"), files=1)
    target, broken = str(tmp_path / "table"), []

    def breaking(write):
        def own(batch, n):
            write(batch, n)
            if n == 1 and not broken:
                broken.append(n)
                raise RuntimeError("lost after writing, before the stream knew")

        return own

    def go():
        stream = stateful.streamed(spark, str(tmp_path / "in"), 1).withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["id"]).drop("at")
        sinks.written_once(stream, held, target, "key", "id", breaking)

    with pytest.raises(Exception, match="lost after writing"):
        go()
    assert sorted(r.id for r in sinks.with_held(spark, held, target).collect()) == [1, 11, 21]
    go()
    assert sorted(map(tuple, sinks.with_held(spark, held, target).collect())) == [(1, "a"), (11, "b"), (21, "c"), (31, "d")]
    # A batch before the last one changes nothing when it is asked for again.
    sinks.once(held, target, "key", "id")(spark.createDataFrame([(5, "z")], "id long, key string"), 0)
    assert sorted(r.id for r in sinks.with_held(spark, held, target).collect()) == [1, 11, 21, 31]


def test_streams_of_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, user_id long, at timestamp, cost long")
    stateful.arrived(spark, [empty], str(tmp_path / "in"))
    assert stateful.run(machines.limited(stateful.streamed(spark, str(tmp_path / "in"))), "append").count() == 0
    assert stateful.beat(empty, "user_id", "id", "at", "1 day").count() == 0


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    put(spark, str(tmp_path), [[(1, 1, 0, "e", "", 0)], [(1, 2, 0, "e", "", 6000)], [(1, 3, 0, "e", "", 6001)], [(1, 4, 0, "e", "", 1)]])
    counted = stateful.streamed(spark, str(tmp_path), 1).withWatermark("at", "1 hour").groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"))
    rows = stateful.latest(stateful.run(counted.select(F.col("w.start").alias("day"), "n"), "update"), ["day"])
    assert sorted(r.n for r in rows.collect()) == [1, 2]


def test_frames_are_read_from_chunks(spark):
    chunks = [(1, 0, "event: message\nda"), (1, 1, 'ta: {"answer":"你"}\r\n'), (1, 2, "\nevent: message_end\n"), (1, 3, "data: {}"), (2, 0, "data: x\ndata: y\n\n\n")]
    frames = turns.split_frames(turns.lines_of_chunks(spark.createDataFrame(chunks, "stream_id long, seq long, chunk string")))
    assert [tuple(r)[2:] for r in frames.orderBy("stream_id", "seq").collect()] == [("message", '{"answer":"你"}'), ("message_end", "{}"), (None, "x\ny")]


def test_files(spark, tmp_path):
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.bin").write_bytes(b"x")
    (tmp_path / "a.bin").write_bytes(b"x" * 10)
    (tmp_path / "b.bin").write_bytes(b"x" * 30)
    os.utime(tmp_path / "a.bin", (0, 0))
    found = files.listing(spark, f"{tmp_path}/*.bin")
    assert sorted((r.path.rsplit("/", 1)[1], r.size, r.outcome) for r in files.oversized(found, 20).collect()) == [("a.bin", 10, "ok"), ("b.bin", 30, "too_large")]
    assert [r.path.rsplit("/", 1)[1] for r in limits.expired(found, "modified", F.current_timestamp()).collect()] == ["a.bin"]
    (tmp_path / "env").write_text("# APP_A=0\nAPP_A = 1=2\nAPP_B=x\nOTHER=3\nbroken\n")
    held = spark.createDataFrame([("APP_B", "kept")], "key string, value string")
    got = changes.key_values(files.lines(spark, str(tmp_path / "env")), "APP_", held)
    assert sorted(map(tuple, got.collect())) == [("APP_A", "1=2", "file"), ("APP_B", "kept", "held")]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_requests_are_decided_by_time_whatever_their_ids(spark, tmp_path):
    """Ids that begin anew with each day, and two requests in one millisecond whose ids run against their time."""
    days = spark.range(400).select((F.col("id") % 4 * 100 + F.floor(F.col("id") / 4)).alias("event_id"), (F.col("id") % 4 * 86_400_000_000 + F.floor(F.col("id") / 4) * 600_000_000).alias("us"), (F.lit(1) + F.floor(F.col("id") / 4) % 3).alias("user_id"), (F.col("id") * 7 % 11).alias("k"))
    days = days.withColumn("us", F.col("us") * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1) + 400_000_000_000)
    close = spark.createDataFrame([(901, 900_000_000_000_300, 9, 5), (900, 900_000_000_000_700, 9, 4)], "event_id long, us long, user_id long, k long")
    rows = days.unionByName(close).select("event_id", "user_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit("}")).alias("props"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    for name in os.listdir("/root/testdata/sf0.001"):
        db.sql(f"create view {name.removesuffix('.parquet')} as select * from '/root/testdata/sf0.001/{name}'")
    db.sql(f"create or replace view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted((r.id, r.user_id, r.outcome, r.tokens_left) for r in QUERIES["rate_limit_decisions"](spark, str(tmp_path)).collect())
    assert len(got) == 402 and got == sorted(db.sql(f"select id, user_id, outcome, tokens_left from ({ORACLE_SQL['rate_limit_decisions']})").fetchall())


def test_captured_logs_are_read_in_few_ranges(spark, tmp_path, monkeypatch):
    """A range is a task: small ones would make as many tasks as there are 64 KB."""
    asked, own = [], captures.stream_lines
    monkeypatch.setattr(captures, "stream_lines", lambda spark, folder, split=captures.SPLIT: asked.append(split) or own(spark, folder, split))
    assert stateful.captured(spark, "/root/testdata/sf0.001").count() > 0
    assert len(asked) == 2 and min(asked) >= captures.BLOCK


@pytest.mark.parametrize("name", ["turns_closed_streamed", "chunks_to_frames_streamed"])
def test_streams_of_ids_that_begin_anew_lose_nothing(spark, tmp_path, name):
    """Other users' events of the same days with larger ids: none of them is late, as they come in the order of their time."""
    own = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 400")
    more = own.withColumn("event_id", F.col("event_id") + 100_000).withColumn("user_id", F.col("user_id") + 5_000)
    own.unionByName(more).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    for table in os.listdir("/root/testdata/sf0.001"):
        db.sql(f"create view {table.removesuffix('.parquet')} as select * from '/root/testdata/sf0.001/{table}'")
    db.sql(f"create or replace view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, db.sql(ORACLE_SQL[name]).fetchall()))


def test_buckets_take_the_nearest_millisecond(spark, tmp_path):
    """Two requests a token's refill apart, but for less than a millisecond: cut down, the second would find a token less, or one more."""
    refill = 1_200_000_000
    rows = [(k, u, t, 1) for u, (a, b) in enumerate([(400, -400), (600, 0), (500, 0), (499, 0), (0, -500), (0, -501), (999, 400), (300, 700)]) for k, t in ((2 * u, 10**15 + a), (2 * u + 1, 10**15 + refill + b))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, us long, k long").select("event_id", "user_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit("}")).alias("props"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    for name in os.listdir("/root/testdata/sf0.001"):
        db.sql(f"create view {name.removesuffix('.parquet')} as select * from '/root/testdata/sf0.001/{name}'")
    db.sql(f"create or replace view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted((r.id, r.user_id, r.outcome, r.tokens_left) for r in QUERIES["rate_limit_decisions"](spark, str(tmp_path)).collect())
    assert len(got) == 16 and got == sorted(db.sql(f"select id, user_id, outcome, tokens_left from ({ORACLE_SQL['rate_limit_decisions']})").fetchall())
