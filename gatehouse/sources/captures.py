"""Captured event streams: logs of chunks of bytes in files that grow, read as a stream by byte offsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads at most, and bytes that it holds at a time.
SPLIT, BLOCK = 64 << 20, 4 << 20


@dataclass
class Range(InputPartition):
    """Bytes of a file: the lines that begin in them. begins: whether a line surely begins at the first."""

    path: str
    low: int
    high: int
    begins: bool


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder (a path, or a URI such as file:, hdfs: or s3:), and the folder's path in it."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return pafs.LocalFileSystem(), folder


def last_line_end(store: pafs.FileSystem, path: str, size: int) -> int:
    """Where the last whole line of a file ends; what follows is still being written."""
    with store.open_input_file(path) as f:
        high = size
        while high > 0:
            low = max(0, high - (1 << 16))
            at = f.read_at(high - low, low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return 0


class _Lines(DataSourceStreamReader):
    """Offsets are the bytes read of each file, so a restart goes on where the checkpoint says; files may grow and new ones may come, lines are taken once they are whole."""

    def __init__(self, folder: str, split: int) -> None:
        self.folder, self.split = folder, split
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, folder = _opened(self.folder)
        out = {}
        for info in store.get_file_info(pafs.FileSelector(folder, recursive=False)):
            if info.type != pafs.FileType.File or info.base_name[0] in "._":
                continue
            if self.known.get(info.base_name, (-1, 0))[0] != info.size:
                self.known[info.base_name] = info.size, last_line_end(store, info.path, info.size)
            if self.known[info.base_name][1]:
                out[info.base_name] = self.known[info.base_name][1]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, high in sorted(end.items()):
            first = start.get(name, 0)
            out += [Range(name, a, min(a + self.split, high), a == first) for a in range(first, high, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, folder = _opened(self.folder)
        with store.open_input_file(f"{folder}/{partition.path}") as f:
            yield from _lines(f, partition)


def _lines(f, part: Range) -> Iterator[pa.RecordBatch]:
    """The lines that begin within a range, in blocks; the last one may end behind it."""
    size = f.size()
    at = part.low
    if not part.begins:  # the line that holds the byte before belongs to the range before
        at -= 1
        while at < part.high:
            block = f.read_at(min(BLOCK, size - at), at)
            found = block.find(b"\n")
            if found >= 0:
                at += found + 1
                break
            at += len(block)
            if not block:
                return
    while at < part.high:
        held = f.read_at(min(BLOCK, part.high - at), at)
        while held[-1:] != b"\n":
            more = f.read_at(min(1 << 16, size - at - len(held)), at + len(held))
            if not more:
                break
            cut = more.find(b"\n")
            held += more[: cut + 1] if cut >= 0 else more
        raw = np.frombuffer(held, np.uint8)
        ends = np.flatnonzero(raw == 10)
        if not len(ends):
            return
        starts = np.concatenate([[0], ends[:-1] + 1])
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        lines = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[: ends[-1] + 1][raw[: ends[-1] + 1] != 10].tobytes())])
        names = pa.array([part.path] * len(ends), pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array(starts + at, pa.int64()), lines], names=["file", "at", "line"])
        at += len(held)


class CapturedLines(DataSource):
    """Whole lines of the files of a folder as (file, at, line), at being the byte at which a line begins; option split: bytes that a task reads at most."""

    @classmethod
    def name(cls) -> str:
        return "captured_lines"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Lines(self.options["path"], int(self.options.get("split", SPLIT)))


def stream_lines(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """The lines of a folder's files as a stream."""
    spark.dataSource.register(CapturedLines)
    return spark.readStream.format("captured_lines").option("split", str(split)).load(folder)


def capture(chunks: DataFrame, folder: str) -> None:
    """Adds chunks (stream_id, seq, at, chunk as bytes) to the logs in a folder, a line each."""
    fields = [F.col("stream_id").cast("string"), F.col("seq").cast("string"), F.unix_micros(F.col("at").cast("timestamp")).cast("string"), F.regexp_replace(F.base64("chunk"), "\\s", "")]
    chunks.select(F.concat_ws("\t", *fields).alias("value")).write.mode("append").text(folder)


def chunks_of(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, at, chunk) of a log's lines; lines that aren't such are left out."""
    part = F.split("line", "\t", -1)
    read = lines.select(F.try_element_at(part, F.lit(1)).try_cast("long").alias("stream_id"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("seq"), F.timestamp_micros(F.try_element_at(part, F.lit(3)).try_cast("long")).alias("at"), F.unbase64(F.try_element_at(part, F.lit(4))).alias("chunk"))
    return read.where("stream_id is not null and seq is not null and at is not null and chunk is not null")
