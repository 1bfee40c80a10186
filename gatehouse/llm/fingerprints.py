"""Quartile bucket digests of documents: op7."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

BUCKETS = 256
#: A step of the length code is a factor of so much.
LENGTH_STEP = 1.25
#: Mean bucket difference from which two digests count as wholly unlike, and what a step of length adds to it.
WHOLLY_UNLIKE, LENGTH_COST, LENGTH_MOST = 3.0, 0.06, 10


def digest(raw: bytes) -> str:
    """Hex digest of a text's bytes: two bits for each bucket's quartile among all bucket counts, then a byte for the length.

    Fewer than three bytes fill no bucket; such texts differ in the length byte and a short hash only.
    """
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return "00" * (BUCKETS // 4) + f"{len(a):02x}" + raw.hex().rjust(4, "0")
    h = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA6B))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    h = (h + a[2:]) * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x165667B1)
    counts = np.bincount(h >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    ranked = np.sort(counts)
    q1, q2, q3 = ranked[BUCKETS // 4 - 1], ranked[BUCKETS // 2 - 1], ranked[3 * BUCKETS // 4 - 1]
    quarter = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = (quarter[:, 0] << 6) | (quarter[:, 1] << 4) | (quarter[:, 2] << 2) | quarter[:, 3]
    length = min(255, 3 + int(math.log(len(a), LENGTH_STEP)))
    return packed.astype(np.uint8).tobytes().hex() + f"{length:02x}0000"


_PAIRS = np.arange(256, dtype=np.uint8)
_FOUR = np.stack([_PAIRS >> 6, (_PAIRS >> 4) & 3, (_PAIRS >> 2) & 3, _PAIRS & 3], 1).astype(np.int8)


def likeness(a: str, b: str) -> float:
    """Likeness of two digests, 0 to 1; 1 only for equal digests.

    Bucket quartiles that are opposite count double; the mean difference and the capped length
    difference are subtracted from 1.
    """
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    n = BUCKETS // 4
    apart = np.abs(_FOUR[x[:n]] - _FOUR[y[:n]])
    mean = (int(apart.sum()) + 3 * int((apart == 3).sum())) / BUCKETS
    steps = min(abs(int(x[n]) - int(y[n])), LENGTH_MOST)
    return max(0.0, min(0.999, 1.0 - (mean + LENGTH_COST * steps) / WHOLLY_UNLIKE))


def edited(text: str, following: str) -> str:
    """The text whose last quarter of code points is replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("pid", pa.int32()), ("kind", pa.string()), ("text", pa.large_string())])


def _compared(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    new = edited(text, following).encode()
    other = digest(new)
    return doc_id, len(text), hashlib.sha256(new).hexdigest(), mark, other, likeness(mark, other), likeness(mark, next_mark)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one ordered range: each but the last is compared with the one after it; the first and the last go out as texts."""
    held, pid = None, None
    for batch in batches:
        rows = []
        for doc_id, text, pid in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "pid")), strict=True):
            mark = digest(text.encode())
            if held is None:
                rows.append((None,) * 7 + (pid, "first", text))
            else:
                rows.append(_compared(*held, text, mark) + (pid, "row", None))
            held = doc_id, text, mark
        if rows:
            yield _batch(rows, _OUT)
    if held is not None:
        yield _batch([(held[0],) + (None,) * 6 + (pid, "last", held[1])], _OUT)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of each range against the first of the range that follows."""
    schema = pa.schema(list(_OUT)[:7])
    for batch in batches:
        rows = [_compared(doc_id, text, digest(text.encode()), following, digest(following.encode())) for doc_id, text, following in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "following")), strict=True)]
        if rows:
            yield _batch(rows, schema)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole documents, of their edited texts, and the likeness of each to its edited text and to the next document.

    Documents are dealt into ranges of (doc_id, hash of the text), so repeated ids have a fixed
    order and a hot id is spread; each range is read as a stream with one row held back. Only one
    row of each range, never the table, meets its neighbour by a join.

    Null text is empty. An empty table gives no rows; a single document is followed by itself. A
    null doc_id sorts first. Other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text", F.spark_partition_id().alias("pid"))
    parts = common.checkpoint(ranged.mapInArrow(_scan, f"{_ROW}, pid int, kind string, text string"))
    first = parts.where("kind = 'first'").select("pid", F.col("text").alias("following"))
    follow = first.select("pid").selectExpr("pid", "coalesce(lead(pid) over (order by pid), min(pid) over ()) as next")
    last = parts.where("kind = 'last'").select("pid", "doc_id", "text").join(follow, "pid")
    ends = last.join(first.withColumnRenamed("pid", "next"), "next").select("doc_id", "text", "following")
    names = [f.name for f in list(_OUT)[:7]]
    return parts.where("kind = 'row'").select(*names).unionByName(ends.mapInArrow(_close, _ROW))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document."""
    return fingerprint_documents(common.table(spark, sf_dir, "documents"))
