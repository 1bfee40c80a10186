"""What the training-data operators share: table access, scratch tables, word hashes, link components."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.sources.scratch import shared_dir

#: White space as the contracts define it; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data by name; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def placed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, and its path there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    return placed(df, name)[0]


def cleared(spark: SparkSession, *paths: str) -> None:
    """The space of tables that nothing reads any more (placed) is given back: an empty one takes the place of each."""
    for path in paths:
        spark.range(0, numPartitions=1).write.mode("overwrite").parquet(path)


#: Rows of ids, of 8 bytes each, up to which a checked side is broadcast.
BROADCAST_IDS = 1 << 20


def keep_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """df joined by how ("left_semi" or "left_anti") with the doc_ids of ids, which is computed and counted first: a small one is broadcast, so that texts needn't be shuffled; a larger one is joined plainly."""
    ids = checkpoint(ids.select("doc_id").distinct())
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the start and end of each row; null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start, end = offsets[:-1].copy(), offsets[1:].copy()
    if column.null_count:
        end[np.asarray(column.is_null())] = start[np.asarray(column.is_null())]
    return raw, start, end


#: Rows of a batch that goes to a Python worker, where the session has Spark's own number.
BATCH_ROWS = "2000"


def small_batches(spark: SparkSession) -> None:
    """Texts travel to Python workers in smaller batches than Spark's 10,000 rows, unless the session names a number of its own: a batch stands in the executor's direct memory and in the worker's, and neither gives such room back soon."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def spare() -> None:
    """Memory of batches and arrays that are done with goes back to the system; the pool and the C library would keep it for a process that other stages' tasks share."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_CHUNK = 1 << 20


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_CHUNK, _BASE)
_DOWN = _powers(_CHUNK, pow(_BASE, -1, 1 << 64))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of spans of bytes that follow each other without overlap; with lower, A-Z count as a-z.

    Sums of code times a power of an odd base, from running sums over windows of at most a megabyte,
    so that a text of any length takes bounded memory.
    """
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        low = int(start[k])
        stop = int(np.searchsorted(end, low + _CHUNK, "right"))
        if stop > k:
            part = raw[low : int(end[stop - 1])]
            code = _CODES[_LOWER[part] if lower else part]
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(code * _UP[: len(part)], out=sums[1:])
            a = start[k:stop] - low
            out[k:stop] = (sums[end[k:stop] - low] - sums[a]) * _DOWN[np.minimum(a, _CHUNK - 1)]
            k = stop
        else:  # one span longer than a window
            total = 0
            for i in range(low, int(end[k]), _CHUNK):
                part = raw[i : min(i + _CHUNK, int(end[k]))]
                code = _CODES[_LOWER[part] if lower else part]
                total += int((code * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, i - low, 1 << 64)
            out[k] = total % (1 << 64)
            k += 1
    return mix(out)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of one text, in order, after lower-casing A-Z. A word is a run of bytes that aren't white space."""
    if not len(raw):
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(_SPACES[raw], prepend=True, append=True))
    return span_hashes(raw, edge[::2], edge[1::2], lower=True)


def shingles(raw: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of `size` words; with fewer words the whole sequence is the one shingle, without words there is none."""
    words = word_hashes(raw)
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    out = words[: n - width + 1].copy()
    for i in range(1, width):
        out = mix(out * np.uint64(3) + words[i : n - width + 1 + i])
    if width < size:
        out = mix(out + np.uint64(width))
    return np.unique(out)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links between longs: (id, component), component being the smallest reachable id.

    Alternates large-star and small-star steps (each a join and a group-by minimum, so that a hot
    node is summed map-side and a hot join key can be split) until the links no longer change; every
    step is checkpointed in the shared folder. Links that hold a null or join an id with itself are
    ignored; no links give no rows.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    edges = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        edges = checkpoint(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        seen = state
