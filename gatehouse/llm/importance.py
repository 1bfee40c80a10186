"""Target-distribution importance resampling over word-id suffix arrays: op13."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatehouse.llm import common

#: Runs of so many consecutive words at most are features, and they fall into so many buckets.
LONGEST, BUCKETS = 2, 10_000
#: Documents with so many words may be drawn, this share of them in percent, with this seed.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of text whose words share one suffix array; a longer document has one of its own.
BLOCK = 4 << 20

_WORDS = np.zeros(256, bool)
_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_ids(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of texts that lie one after the other in raw: ids from 1, in order, with a 0 after each text; how many words each text has; and the words by id - 1."""
    low, high = int(start[0]), int(end[-1])
    part = _LOWER[raw[low:high]]
    inside = _WORDS[part]
    # A text ends a word, though the next one begins with a word's byte: places are shifted by one for each text before.
    text_at = np.arange(len(start))
    spaced = np.zeros(high - low + len(start), bool)
    shift = np.repeat(text_at, end - start)
    spaced[np.arange(high - low) + shift] = inside
    edge = np.flatnonzero(np.diff(spaced, prepend=False, append=False))
    first, stop = edge[::2], edge[1::2]
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(stop - first, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part[inside]))]).dictionary_encode()
    held = np.bincount(np.searchsorted(end - low + text_at, first, "right"), minlength=len(start)) if len(first) else np.zeros(len(start), np.int64)
    ids = np.zeros(len(first) + len(start), np.int64)
    ids[np.arange(len(first)) + np.repeat(text_at, held)] = np.asarray(words.indices) + 1
    return ids, held, words.dictionary


def suffixes(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes in the order of their first `depth` ids, and of how many of these each shares with the one before it. Ranks of twice the length come from pairs of ranks, as in a suffix array by doubling."""
    n, done, rank = len(ids), 1, ids
    while done < depth:
        step = min(done, depth - done)
        pair = rank * np.int64(int(rank.max()) + 2)
        pair[: n - step] += rank[step:] + 1
        rank = np.unique(pair, return_inverse=True)[1] if done + step < depth else pair
        done += step
    order = np.argsort(rank)
    shared, same = np.zeros(n, np.int8), np.ones(n, bool)
    same[0] = False
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    for k in range(depth):
        own = padded[order + k]
        same[1:] &= own[1:] == own[:-1]
        shared += same
    return order, shared


@cache
def _appended(size: int) -> np.ndarray:
    """What a CRC-32 becomes when so many zero bytes follow, by each value of each of its four bytes: it is linear over bits."""
    of = lambda x: _zeros(x, size)
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k, 1 << bit : 2 << bit] = out[k, : 1 << bit] ^ np.uint32(of(1 << (8 * k + bit)))
    return out


def _zeros(state: int, size: int) -> int:
    """The register after so many zero bytes: zlib starts from the complement of the value given and returns a complement."""
    return zlib.crc32(b"\0" * size, state ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def joined_crc(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts a + b from those of a and b, and the bytes of b."""
    out = right.copy()
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        x, table = left[at], _appended(n) if n <= 256 else None
        if table is None:
            out[at] ^= np.array([_zeros(v, n) for v in x.tolist()], np.uint32)
        else:
            out[at] ^= table[0, x & 255] ^ table[1, x >> 8 & 255] ^ table[2, x >> 16 & 255] ^ table[3, x >> 24]
    return out


def feature_buckets(raw: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to `longest` words of the texts, text by text; how many features and words each has.

    The texts' word ids share one suffix array. Where neighbours in it share k ids, they are the same
    k-gram: each such stretch is hashed once, at its head, and its bucket goes back to all its places.
    """
    ids, held, words = word_ids(raw, start, end)
    n_words = held
    place = np.flatnonzero(ids)
    of = np.repeat(np.arange(len(start)), held)
    left = np.repeat(np.cumsum(held), held) - np.arange(len(place))  # words from here to the text's end
    texts = words.to_pylist()
    crc = np.array([zlib.crc32(w) for w in texts], np.uint32)
    size = np.array([len(w) for w in texts], np.int64)
    order, shared = suffixes(ids, longest)
    after = np.zeros(len(ids), np.int64)
    after[place] = left
    parts, owners = [], []
    for k in range(1, longest + 1):
        own = after[order] >= k
        at, heads = order[own], np.flatnonzero(shared[own] < k)
        if not len(at):
            break
        first = at[heads]
        value = crc[ids[first] - 1]
        for i in range(1, k):
            nxt = ids[first + i] - 1
            blank = np.full(len(first), zlib.crc32(b" "), np.uint32)
            value = joined_crc(joined_crc(value, blank, np.ones(len(first), np.int64)), crc[nxt], size[nxt])
        found = np.zeros(len(ids), np.uint16 if buckets <= 1 << 16 else np.uint32)
        found[at] = np.repeat((value % np.uint32(buckets)).astype(found.dtype), np.diff(np.append(heads, len(at))))
        has = left >= k
        parts.append(found[place[has]])
        owners.append(of[has])
    if not parts:
        return np.zeros(0, np.uint16), np.zeros(len(start), np.int64), n_words
    owner = np.concatenate(owners)
    return np.concatenate(parts)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(start)), n_words


def _indexer(longest: int, buckets: int):
    names = ["doc_id", "n_words", "n_features", "buckets"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, start, end = common.texts_of(batch.column("text"))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(end, start[a] + BLOCK, "right")))
                # Null texts lie nowhere: their place is where the next one starts.
                found, n, n_words = feature_buckets(raw, start[a:b], end[a:b], longest, buckets) if end[b - 1] > start[a] else (np.zeros(0, np.uint16), np.zeros(b - a, np.int64), np.zeros(b - a, np.int64))
                offsets = np.concatenate([[0], np.cumsum(n * found.itemsize)]).astype(np.int64)
                held = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(found.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n_words), pa.array(n), held.cast(pa.binary())], names=names)
                a = b

    return index


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): buckets of the features of each text, as little-endian integers of two bytes (four where there are more than 65,536 buckets)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_indexer(longest, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def _values(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column, and where each row's begin and end."""
    raw, start, end = common.texts_of(column.cast(pa.large_binary()).view(pa.large_string()))
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    low = int(start[0]) if len(start) else 0
    high = int(end[-1]) if len(end) else 0
    return np.frombuffer(raw[low:high].tobytes(), kind), np.append(start - low, high - low) // kind.itemsize


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_values(batch.column("buckets"), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return count


def bucket_counts(indexed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket: each task sums its own rows, Spark sums the tasks', and one number a bucket comes to the driver."""
    rows = indexed.select("buckets").mapInArrow(_counter(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: 1000 times the logarithm of how much likelier it is in the target than in the corpus, with one more of each bucket, floored."""
    n, corpus_all, target_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (corpus_all + n)) / float((s + 1) * (target_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found, at = _values(batch.column("buckets"), len(gain))
            sums = np.concatenate([[0], np.cumsum(gain[found])])
            n = np.asarray(batch.column("n_features"))
            weight = np.where(n > 0, (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of docs, of which `percent` of those with `least_words` words are drawn without replacement, the likelier the more their features look like those of target (text).

    Scores are weights plus Gumbel noise that a hash of the id gives, so the highest scores are the
    draw. Scores are integers within some 120,000 values, whatever the corpus (a gain is at most 1000
    times the logarithm of 2^64, noise lies between -3,200 and 22,900), so a count by score tells the
    lowest score that is drawn and where in the order each score begins; ranks within a score are counted
    apart from all other scores.

    Null and empty texts have no feature and the weight 0. A null doc_id takes noise of the seed
    alone and comes last among equal scores; rows of one doc_id are documents each, equal ones ordered by
    their features. An empty table gives no rows; an empty target counts nothing. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    indexed, path = common.placed(features(docs, longest, buckets), "importance-features")
    wanted = bucket_counts(features(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets), buckets)
    gain = gains(bucket_counts(indexed, buckets), wanted)
    weighed = indexed.mapInArrow(_weigher(gain), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    scored, scores_path = common.placed(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("may")), "importance-scores")
    common.cleared(spark, path)
    held = sorted(((r["score"], r["n"]) for r in scored.where("may").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in held) // 100
    before, at = {}, 0
    for score, n in held:
        if at >= draw:
            break
        before[score] = at
        at += n
    names = ["doc_id", "n_features", "weight", "score"]
    if not before:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    lowest = min(before)
    starts = spark.createDataFrame(list(before.items()), "score long, before long")
    own = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    top = scored.where(F.col("may") & (F.col("score") >= lowest)).withColumn("own", own).join(F.broadcast(starts), "score")
    rank = F.col("before") + F.col("own")
    drawn = top.select(*names, F.when(rank <= draw, rank).alias("rank"))
    return drawn.unionByName(scored.where(~(F.col("may") & (F.col("score") >= lowest))).select(*names, F.lit(None).cast("long").alias("rank")))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document weighed towards the benchmark's texts, and a quarter of them drawn."""
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
