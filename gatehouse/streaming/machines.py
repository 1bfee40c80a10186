"""Keyed state of streams as state machines: frames out of chunks of bytes, turns out of events, decisions of a rate limit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gatehouse.operators import turns

_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def typed_state(spark: SparkSession):
    """While a query is started: typed state variables need the state store that keeps them on disk."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def on_time(rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
    """Rows (ms, …) that the watermark hasn't passed; Spark itself filters by that of the micro-batch before."""
    for part in rows:
        own = part[part["ms"] >= timer_values.getCurrentWatermarkInMs()]
        if len(own):
            yield own


# Frames


def parse_frame(raw: bytes) -> tuple[str | None, str] | None:
    """(event, data) of one frame's bytes: the last event line, data lines joined by newlines; None if it holds neither. Bytes that are no UTF-8 become replacement characters."""
    event, data = None, []
    for line in raw.decode("utf-8", "replace").split("\n"):
        line = line.removesuffix("\r")
        if line.startswith("event:"):
            event = line[6:].strip(" ")
        elif line.startswith("data:"):
            data.append(line[5:].lstrip(" "))
    return (event, "\n".join(data)) if event is not None or data else None


_END = re.compile(rb"(?:^|\n)\r?\n")


def cut_frames(held: bytes, fresh: bytes) -> tuple[list[bytes], bytes]:
    """The frames that held and fresh bytes complete, and what is left; a blank line ends a frame. Only the fresh bytes, and the two before them, are searched."""
    raw, out, at = held + fresh, [], 0
    look = max(0, len(held) - 2)
    while True:
        # At a frame's beginning a blank line counts too; else it must follow a line's end.
        found = _END.match(raw, at) if look <= at and raw[at : at + 2].lstrip(b"\r")[:1] == b"\n" else None
        found = found or re.compile(rb"\n\r?\n").search(raw, max(look, at))
        if not found:
            return out, raw[at:]
        out.append(raw[at : found.end()])
        at = look = found.end()


class FrameSplitter(StatefulProcessor):
    """Frames of each stream's chunks of bytes, with the bytes of an unfinished frame as state.

    Chunks carry their number (seq, from 0). One that comes before its turn waits in a map until the
    gap closes; one that was read already, or is there twice, is left out. Once a stream is silent for
    `silence` of event time what is unfinished counts as its last frame, and its state goes; chunks that
    then still wait behind a gap are read in their order, as the gap will not close any more.
    """

    def __init__(self, silence: str) -> None:
        self.silence = milliseconds(silence)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, n long, timer long")
        self.held = handle.getValueState("held", "raw binary")
        self.ahead = handle.getMapState("ahead", "seq long", "raw binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        following, n, timer = self.place.get() or (0, 0, 0)
        held = bytes((self.held.get() or (b"",))[0])
        waits, last, fresh = {}, 0, bytearray()
        for part in on_time(rows, timerValues):
            last = max(last, int(part["ms"].max()))
            waits |= {seq: bytes(raw) for seq, raw in zip(part["seq"].tolist(), part["chunk"].tolist(), strict=True) if seq >= following}
        if not last:
            return
        stored = {k[0]: bytes(v[0]) for k, v in self.ahead.iterator()} if self.ahead.exists() else {}
        waits = {**waits, **stored}
        while following in waits:
            fresh += waits.pop(following)
            following += 1
        for seq in stored:
            if seq not in waits:
                self.ahead.removeKey((seq,))
        for seq, raw in waits.items():
            if seq not in stored:
                self.ahead.updateValue((seq,), (raw,))
        found, held = cut_frames(held, bytes(fresh))
        rows_out, n = self._rows(key, found, n)
        due = max(timer, last + self.silence)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.place.update((following, n, due))
        self.held.update((held,))
        if len(rows_out):
            yield rows_out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        _, n, _ = self.place.get()
        rest = b"".join(bytes(v[0]) for _, v in sorted((tuple(k), tuple(v)) for k, v in self.ahead.iterator()))
        found, held = cut_frames(bytes(self.held.get()[0]), rest)
        rows, _ = self._rows(key, [*found, held], n)
        self.place.clear()
        self.held.clear()
        self.ahead.clear()
        if len(rows):
            yield rows

    @staticmethod
    def _rows(key: Any, found: list[bytes], n: int) -> tuple[pd.DataFrame, int]:
        parsed = [x for x in map(parse_frame, found) if x]
        rows = pd.DataFrame({"stream_id": [key[0]] * len(parsed), "n": range(n, n + len(parsed)), "event": [e for e, _ in parsed], "data": [d for _, d in parsed]})
        return rows, n + len(parsed)


def split_frames(chunks: DataFrame, late: str = "10 minutes", silence: str = "1 hour") -> DataFrame:
    """(stream_id, n, event, data) of a stream of chunks (stream_id, seq, at, chunk): frames of each stream, numbered from 0, as soon as they are whole. Chunks older than the watermark by `late` are dropped."""
    own = chunks.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return own.groupBy("stream_id").transformWithStateInPandas(FrameSplitter(silence), "stream_id long, n long, event string, data string", "append", "eventTime")


# Turns


TURN = "stream_id long, started timestamp, content string, reasoning string, total_tokens long, upstream_id string, failed int, status string"


class TurnMachine(StatefulProcessor):
    """Turns of each stream's events, with their pieces as state, a list that each micro-batch adds to in one go.

    A turn ends where a stream is silent for longer than `silence` of event time. Pieces may come in
    any order, the last of a place counts: a turn is told once the watermark has passed its last piece by `silence`, so no piece of
    it can come any more, and its pieces go. status is error once an error came, done after an end, and
    aborted otherwise: what came before a reader or the upstream went away is told with it. With
    progress, a stream's last turn as it stands is told in each micro-batch that changes it, as open, error or done.
    """

    def __init__(self, silence: str, progress: bool) -> None:
        self.silence, self.progress = milliseconds(silence), progress

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "ms long")
        self.pieces = handle.getListState("pieces", "us long, seq long, sub_seq int, kind string, text string, number long, upstream string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, fresh = None, []
        plain = lambda x: x if isinstance(x, str) else None
        for part in on_time(rows, timerValues):
            for us, seq, sub, kind, text, number, upstream in zip(*[part[c].tolist() for c in ("us", "seq", "sub_seq", "kind", "text", "number", "upstream")], strict=True):
                fresh.append((int(us), int(seq), int(sub), kind, plain(text), None if pd.isna(number) else int(number), plain(upstream)))
                first = int(us) if first is None else min(first, int(us))
        if first is None:
            return
        self.pieces.appendList(fresh)
        self._due(first // 1000 + self.silence + 1)
        if self.progress:
            yield self._rows(key, [(self._turns()[-1], False)])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        out, rest, passed = [], [], timerValues.getCurrentWatermarkInMs()
        for turn in self._turns():
            due = turn[-1][0][0] // 1000 + self.silence + 1
            if due <= passed:
                out.append((turn, True))
                continue
            if not rest:
                self._due(due)
            rest += [(*place, *value) for place, value in turn]
        if rest and out:
            self.pieces.put(rest)
        elif out:
            self.pieces.clear()
        if out:
            yield self._rows(key, out)

    def _due(self, at: int) -> None:
        """A timer at that time, unless there is an earlier one."""
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is None or at < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _turns(self) -> list[list]:
        """The pieces by turn, both in order of time."""
        out: list[list] = []
        held = {tuple(x[:3]): tuple(x[3:]) for x in map(tuple, self.pieces.get())}
        for place, value in sorted(held.items(), key=lambda x: x[0]):
            if not out or place[0] - out[-1][-1][0][0] > self.silence * 1000:
                out.append([])
            out[-1].append((place, value))
        return out

    @staticmethod
    def _rows(key: Any, told: list[tuple[list, bool]]) -> pd.DataFrame:
        rows = []
        for turn, over in told:
            pieces = sorted((p[1:], v) for p, v in turn)
            texts = {k: "".join(v[1] for _, v in pieces if v[0] == k and v[1]) for k in ("message", "reasoning")}
            usage = [v[2] for _, v in pieces if v[2] is not None]
            upstream = [v[3] for _, v in pieces if v[3]]
            kinds = {v[0] for _, v in pieces}
            status = "error" if "error" in kinds else "done" if "end" in kinds else "aborted" if over else "open"
            rows.append((key[0], pd.Timestamp(min(p[0] for p, _ in turn) * 1000), texts["message"], texts["reasoning"], usage[-1] if usage else None, upstream[-1] if upstream else None, int("error" in kinds), status))
        out = pd.DataFrame(rows, columns=["stream_id", "started", "content", "reasoning", "total_tokens", "upstream_id", "failed", "status"])
        return out.astype({"total_tokens": "Int64"})


def fold_turns(events: DataFrame, late: str = "10 minutes", silence: str = "1 hour", progress: bool = False) -> DataFrame:
    """Turns (TurnMachine) of a stream of translated events (stream_id, seq, sub_seq, event, data, at). Events older than the watermark by `late` are dropped."""
    event, data = F.col("event"), F.col("data")
    kind = F.when(event.isin("message", "reasoning", "error"), event).when(event.isin("message_end", "agent_done"), "end").otherwise("other")
    text = F.when(event == "message", turns.answer_of(data)).when(event == "reasoning", turns.text_of(data, "$.content"))
    flat = events.select(
        "stream_id", "seq", "sub_seq", F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), kind.alias("kind"), text.alias("text"),
        turns.usage_of(event, data).alias("number"), turns.upstream_of(event, data).alias("upstream"),
    ).withWatermark("at", late)
    return flat.groupBy("stream_id").transformWithStateInPandas(TurnMachine(silence, progress), TURN, "update" if progress else "append", "eventTime")


# Limits


class TokenBucket(StatefulProcessor):
    """Allows or denies each request by a bucket of tokens a user, refilled evenly; the state is one number, the time at which the bucket is full again.

    Requests are decided as they come, those of one micro-batch by time (to the microsecond) and id; the bucket
    is reckoned in milliseconds, each time to the nearest one (near), the half away from zero. One that comes after a
    later one was decided finds the bucket as that one left it. Denied requests take nothing. When the
    watermark passes the time at which the bucket is full, a new bucket is the same: the state goes.
    """

    def __init__(self, capacity: int, refill: int) -> None:
        self.capacity, self.refill = capacity, refill

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.full = handle.getValueState("full", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.full.get()[0] if self.full.exists() else None
        full, out = held or 0, []
        asked = sorted(x for part in on_time(rows, timerValues) for x in zip(part["us"].tolist(), part["id"].tolist(), part["near"].tolist(), part["cost"].tolist(), strict=True))
        for _, id_, ms, cost in asked:
            after = max(full, ms) + cost * self.refill
            allowed = after - ms <= self.capacity * self.refill
            full = after if allowed else full
            out.append((id_, key[0], "allow" if allowed else "deny", max(0, self.capacity - -(-max(0, full - ms) // self.refill))))
        if full != held and full:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(full)
            self.full.update((full,))
        if out:
            yield pd.DataFrame(out, columns=["id", "user_id", "outcome", "tokens_left"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.full.clear()
        return iter(())


def limited(requests: DataFrame, capacity: int = 60, refill: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """(id, user_id, outcome, tokens_left) of a stream of requests (id, user_id, at, cost): allow or deny by a bucket of `capacity` tokens, one more each `refill`, and the whole tokens left. Requests older than the watermark by `late` get no decision."""
    at = F.col("at").cast("timestamp")
    own = requests.select("id", "user_id", "cost", at.alias("at"), F.unix_millis(at).alias("ms"), F.unix_micros(at).alias("us"))
    own = own.withColumn("near", F.expr("(us + if(us < 0, -500, 500)) div 1000")).withWatermark("at", late)
    return own.groupBy("user_id").transformWithStateInPandas(TokenBucket(capacity, milliseconds(refill)), "id long, user_id long, outcome string, tokens_left long", "append", "eventTime")
