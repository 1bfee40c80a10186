"""Token ids in files of directly addressable codes: op8."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatehouse.llm import chunks, common

#: Bits of a chunk at each level, bits of a bitmap between two entries of its rank directory.
WIDTH, BLOCK = 8, 512
#: A segment ends with the document that brings it to so many ids or documents.
IDS, DOCUMENTS = 1 << 18, 4096
END = 2
VOCABULARY = "byte_bpe_50k.json"


def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels of an array of ids: chunks (the low byte of each id that reaches the level), continuation bitmaps (set where an id goes on to the next level) and rank directories (set bits before each block)."""
    rest, levels, marks, ranks = ids.astype(np.uint32), [], [], []
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest >> WIDTH != 0
        marks.append(np.packbits(more, bitorder="little").tobytes())
        sums = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks.append(np.concatenate([[0], np.cumsum(sums)[:-1]]).astype("<u4").tobytes() if len(sums) else b"")
        rest = rest[more] >> WIDTH
        if not len(rest):
            return levels, marks, ranks


def decode(levels: list[bytes], marks: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    ids, at = np.frombuffer(levels[0], np.uint8).astype(np.uint32), None
    for k in range(1, len(levels)):
        more = np.flatnonzero(np.unpackbits(np.frombuffer(marks[k - 1], np.uint8), bitorder="little"))
        at = more if at is None else at[more]
        ids[at] |= np.frombuffer(levels[k], np.uint8).astype(np.uint32) << np.uint32(WIDTH * k)
    return ids


def rank(marks: bytes, ranks: bytes, i: int) -> int:
    """Set bits before place i: the directory's entry, and those of its block before i."""
    block = min(i // BLOCK, len(ranks) // 4 - 1)
    low = int.from_bytes(marks[block * BLOCK // 8 : -(-i // 8)], "little") & ((1 << (i - block * BLOCK)) - 1)
    return int.from_bytes(ranks[4 * block : 4 * block + 4], "little") + low.bit_count()


class Segment:
    """A segment's codes, laid out once for reading at many places."""

    def __init__(self, levels: list[bytes], marks: list[bytes], ranks: list[bytes]) -> None:
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.marks = [np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little") for x in marks]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    def rank(self, k: int, i: int) -> int:
        """Marks before place i of level k: the directory's entry, and those of its block before i."""
        block = min(i // BLOCK, len(self.ranks[k]) - 1)
        return int(self.ranks[k][block]) + np.count_nonzero(self.marks[k][block * BLOCK : i])

    def span(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b, without decoding what lies before: those that go on to the next level lie there side by side, from the rank of a to the rank of b."""
        ids, at = self.levels[0][a:b].astype("<u4"), None
        for k in range(1, len(self.levels)):
            more = np.flatnonzero(self.marks[k - 1][a:b])
            if not len(more):
                break
            at = more if at is None else at[more]
            a = self.rank(k - 1, a)
            b = a + len(more)
            ids[at] |= self.levels[k][a:b].astype(np.uint32) << np.uint32(WIDTH * k)
        return ids


def token(levels: list[bytes], marks: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at place i, read without decoding a block: a byte a level, and a rank from the directory and at most BLOCK bits."""
    out = 0
    for k in range(len(levels)):
        out |= levels[k][i] << (WIDTH * k)
        if not marks[k][i // 8] >> (i % 8) & 1:
            break
        i = rank(marks[k], ranks[k], i)
    return out


_SCHEMA = "pid int, seq int, n_tokens long, doc_ids array<long>, ends array<long>, levels array<binary>, marks array<binary>, ranks array<binary>"
_SEGMENT = pa.schema([("pid", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("levels", pa.list_(pa.binary())), ("marks", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def _writer(vocabulary: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seq, pid = chunks.ByteLevel(vocabulary).table(), 0, 0
        closing = np.array([end], np.int32)
        held: list[np.ndarray] = []
        doc_ids: list = []
        ends: list[int] = []

        def segment() -> pa.RecordBatch:
            levels, marks, ranks = encode(np.concatenate(held))
            row = [[pid], [seq], [ends[-1]], [doc_ids], [ends], [levels], [marks], [ranks]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _SEGMENT, strict=True)], schema=_SEGMENT)

        for batch in batches:
            if not batch.num_rows:
                continue
            pid = batch.column("pid")[0].as_py()
            own = batch.column("doc_id").to_pylist()
            for low, high, _, _, _, ids, stops in chunks.by_document(batch.column("text"), chunks.byte_level_cuts, table):
                at = 0
                for doc_id, stop in zip(own[low:high], stops.tolist(), strict=True):
                    held += [ids[at:stop], closing]
                    ends.append((ends[-1] if ends else 0) + stop - at + 1)
                    doc_ids.append(doc_id)
                    at = stop
                    if ends[-1] >= IDS or len(ends) >= DOCUMENTS:
                        yield segment()
                        seq += 1
                        held, doc_ids, ends = [], [], []
        if ends:
            yield segment()

    return write


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Encodes whole documents and writes their ids, each document's followed by `end`, to `path` in ascending doc_id order.

    Each file holds one range of doc_ids as rows of segments: document ids and ends, and the ids as
    directly addressable codes (encode). Rows of one doc_id are ordered by a hash of the text, and a
    null doc_id comes first; null text is empty and gives the end id alone. An empty table gives no
    segment. Other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text", F.spark_partition_id().alias("pid"))
    ordered.mapInArrow(_writer(vocabulary, end), _SCHEMA).write.parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            held = Segment(row["levels"], row["marks"], row["ranks"])
            n = len(row["ends"])
            starts = [0, *row["ends"][:-1]]
            crc = [zlib.crc32(held.span(a, b)) for a, b in zip(starts, row["ends"], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "pid": pa.array([row["pid"]] * n, pa.int32()), "seq": pa.array([row["seq"]] * n, pa.int32()), "within": pa.array(starts, pa.int64()), "n_tokens": pa.array(np.diff([0, *row["ends"]]), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold of each document: (doc_id, start, n_tokens, ids_crc32).

    Each document's ids are read at their place through the rank directories (Segment). Starts are running
    sums of segment sizes within a file, and of file totals; only the latter, one
    row a file, meet in one task.
    """
    files = spark.read.schema(_SCHEMA).parquet(path)
    sizes = files.select("pid", "seq", "n_tokens")
    before = sizes.groupBy("pid").agg(F.sum("n_tokens").alias("n")).selectExpr("pid", "sum(n) over (order by pid) - n as before")
    own = F.sum("n_tokens").over(Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    starts = sizes.withColumn("own", own).join(before, "pid").select("pid", "seq", (F.col("own") + F.col("before")).alias("at"))
    rows = files.select("pid", "seq", "doc_ids", "ends", "levels", "marks", "ranks").mapInArrow(_reader, "doc_id long, pid int, seq int, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["pid", "seq"]).select("doc_id", (F.col("at") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files and read back."""
    import uuid

    path = f"{common.shared_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write_tokens(common.table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
