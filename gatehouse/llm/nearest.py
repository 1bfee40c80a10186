"""Approximate nearest neighbours by probed lists and an adaptive dimension scan: op9."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatehouse.llm import common

#: Vectors, by smallest hash of their id, on which the lists' centres are fitted at most, and how many of them a list needs.
SAMPLE, PER_LIST = 65_536, 16
#: Lists of a shelf, the unit that goes to a task.
SHELF = 16
#: Share of true neighbours, among the sample, whose lists a query must probe; the number of probes follows from it. Sampled queries that tell it.
COVERED, TRIED = 0.95, 256
#: Vectors and queries that one task holds together, and queries that are compared at once.
BLOCK, QUERIES, ROWS = 4096, 2048, 256
#: Dimensions of a column block, and the chance with which a test abandons a vector that it shouldn't.
COLUMNS, CHANCE = 16, 0.001
#: Share of the probes that gives the bound for the others.
EARLY = 8


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return np.asarray(flat).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) without vectors that are null, empty, zero or hold null or non-finite components, or whose length isn't the commonest (of equally common ones the smallest), and that length."""
    kind = dict(vectors.dtypes)["embedding"]
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = own.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))
    size = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return (good.where(F.size("embedding") == size["dim"]), size["dim"]) if size else (good, 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres of k groups of the rows of x, and each row's group."""
    own = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(5):
        at = _closest(x, own)
        sums, held = np.zeros_like(own), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        own[held > 0] = sums[held > 0] / held[held > 0, None]
    return own, _closest(x, own)


def _closest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    half = 0.5 * (points * points).sum(1)
    return np.concatenate([np.argmax(x[a : a + 4096] @ points.T - half, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def centres(good: DataFrame, dim: int, n: int, k_near: int, covered: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray, int]:
    """Centres of the lists, fitted with a few rounds of k-means on at most SAMPLE vectors, the shelf of each list, and the number of probes with which TRIED of them reach the lists of a share `covered` of their nearest in the sample.

    There are four times the square root of n lists, up to SAMPLE / PER_LIST.
    """
    lists = max(1, min(4 * math.isqrt(n), SAMPLE // PER_LIST, n // PER_LIST))
    rows = good.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(min(SAMPLE, lists * 2 * PER_LIST)).select("embedding").toArrow().column("embedding")
    x, rng = _matrix(rows, dim), np.random.default_rng(seed)
    own, at = _kmeans(x, min(lists, len(x)), rng)
    shelf = _kmeans(own, max(1, len(own) // SHELF), rng)[1]
    some = rng.permutation(len(x))[:TRIED]
    near = x[some] @ x.T
    near[np.arange(len(some)), some] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k_near, len(x) - 1)]
    place = np.argsort(np.argsort(0.5 * (own * own).sum(1) - x[some] @ own.T, axis=1), axis=1)
    reached = np.sort(np.take_along_axis(place, at[best], axis=1).ravel())
    return own, shelf, int(reached[min(len(reached) - 1, math.ceil(covered * len(reached)))]) + 1 if len(reached) else 1


def _assigner(points: np.ndarray, dim: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"), dim)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(_closest(x, points), pa.int32()), pa.array((x * x).sum(1), pa.float64())], ["vec_id", "embedding", "list", "square"])

    return assign


def _prober(points: np.ndarray, shelf: np.ndarray, dim: int, held: np.ndarray, k: int, wanted: int):
    """Lists of each query by shelf, those of the first round and the others: `wanted` of the nearest, and more until they surely hold k candidates. The first round has one list in EARLY, and enough for 4 * k candidates."""
    half = 0.5 * (points * points).sum(1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(half - _matrix(batch.column("embedding"), dim) @ points.T, axis=1, kind="stable")
            sums = np.cumsum(held[order], axis=1)
            n = np.minimum(np.maximum(wanted, (sums <= k).sum(1) + 1), len(points))
            early = np.minimum(np.maximum(-(-wanted // EARLY), (sums <= 4 * k).sum(1) + 1), n)
            at, late, shelves, lists = [], [], [], []
            for i, (row, m, e) in enumerate(zip(order, n.tolist(), early.tolist(), strict=True)):
                for second, part in ((False, row[:e]), (True, row[e:m])):
                    on = shelf[part]
                    for one in np.unique(on).tolist():
                        at.append(i)
                        late.append(second)
                        shelves.append(one)
                        lists.append(part[on == one])
            probes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("embedding").take(take), pa.array(late), pa.array(shelves, pa.int32()), probes], ["vec_id", "embedding", "late", "shelf", "lists"])

    return probe


def shares(dim: int, chance: float = CHANCE) -> list[tuple[int, float]]:
    """After how many dimensions of a randomly rotated vector which share of its squared length is exceeded with the given chance: the quantile of a beta distribution, summed up on a grid."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for done in range(COLUMNS, dim, COLUMNS):
        log = (done / 2 - 1) * np.log(x) + ((dim - done) / 2 - 1) * np.log1p(-x)
        mass = np.cumsum(np.exp(log - log.max()))
        out.append((done, float(x[min(len(x) - 1, np.searchsorted(mass, (1 - chance) * mass[-1]))])))
    return [*out, (dim, 1.0)]


def scan(qr: np.ndarray, xr: np.ndarray, bound: np.ndarray, tests: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, vector row) whose squared distance is within each query's bound, but for those that a test abandons by chance.

    Rotated vectors are compared in blocks of columns. After each block a vector whose partial distance
    exceeds the share of the bound that so many dimensions of a vector within it hardly exceed (shares)
    is abandoned. Blocks are matrix products while most pairs live and are taken pair by pair then.
    """
    low = 0
    part = np.zeros((len(qr), len(xr)))
    rows = columns = None
    for done, share in tests:
        q, x = qr[:, low:done], xr[:, low:done]
        if rows is None:
            part += (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T)
            live = part <= (bound * share * (1 + 1e-9) + 1e-12)[:, None]
            if np.count_nonzero(live) * 4 < live.size:
                rows, columns = np.nonzero(live)
                part = part[rows, columns]
        else:
            part += ((q[rows] - x[columns]) ** 2).sum(1)
            keep = part <= bound[rows] * share * (1 + 1e-9) + 1e-12
            rows, columns, part = rows[keep], columns[keep], part[keep]
        low = done
    return np.nonzero(live) if rows is None else (rows, columns)


def _best(ids: np.ndarray, score: np.ndarray, k: int, rows: np.ndarray) -> np.ndarray:
    """Places of the k best of each row, ties to the smaller id."""
    order = np.lexsort((ids, -score, rows))
    rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
    return order[rank < k]


def _searcher(dim: int, top: float, k: int, seed: int):
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim + 1, dim + 1)))[0]
    tests = shares(dim + 1)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        """Largest inner products are smallest distances once every vector has one more dimension that brings it to the length of the longest."""
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        candidates = candidates.sort_by("list")
        q, x = (_matrix(t.column("embedding"), dim) for t in (queries, candidates))
        own, ids, square, at = (np.asarray(c) for c in (queries.column("vec_id"), candidates.column("vec_id"), candidates.column("square"), candidates.column("list")))
        limit = np.asarray(queries.column("bound").cast(pa.float64()).fill_null(-np.inf))
        qr, xr = np.column_stack([q, np.zeros(len(q))]) @ rotation, np.column_stack([x, np.sqrt(np.maximum(0.0, top - square))]) @ rotation
        probes = queries.column("lists").combine_chunks()
        asked = np.asarray(probes.flatten())
        of = np.repeat(np.arange(len(q)), np.diff(np.asarray(probes.offsets)))
        length = (q * q).sum(1) + top

        def reach(r, score):
            """Squared distance of the lifted vectors at a score, and a little more for rounding."""
            return length[r] - 2 * score + 1e-9 * (1 + length[r])

        bound = reach(np.arange(len(q)), limit)
        found: list[tuple] = []
        for one in np.unique(at).tolist():
            a, b = np.searchsorted(at, [one, one + 1])
            here = of[asked == one]
            for i in range(0, len(here), ROWS):
                some = here[i : i + ROWS]
                r, c = scan(qr[some], xr[a:b], bound[some], tests)
                r, c = some[r], c + a
                other = own[r] != ids[c]
                r, c = r[other], c[other]
                score = np.einsum("ij,ij->i", q[r], x[c])
                best = _best(ids[c], score, k, r)
                r, c, score = r[best], c[best], score[best]
                found.append((r, c, score))
                last = np.flatnonzero(np.bincount(r, minlength=len(q))[r] == k)[k - 1 :: k]
                bound[r[last]] = np.minimum(bound[r[last]], reach(r[last], score[last]))
        if not found:
            return schema.empty_table()
        r, c, score = (np.concatenate(z) for z in zip(*found, strict=True))
        best = _best(ids[c], score, k, r)
        return pa.table([pa.array(own[r[best]]), pa.array(ids[c[best]]), pa.array(score[best])], schema=schema)

    return search


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, covered: float = COVERED, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the largest inner product found for each vector whose id is divisible by `every`.

    Every vector goes to the list of its nearest centre; a query probes its nearest lists, as many as
    the sample asks for (centres). The nearest eighth of them is searched first; the k-th score found
    there bounds the adaptive scan of the others (scan). Neighbouring lists make a shelf, whose vectors
    are dealt into blocks of about BLOCK by a hash and its queries into stacks of about QUERIES, so that
    a hot list is many small groups; a query travels once a shelf and block, and k rows go on. Counts of
    the lists and shelves, at most SAMPLE / PER_LIST numbers, are all that reaches the driver beside the
    sample.

    Ties go to the smaller vec_id. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do those whose length isn't the commonest. Rows that repeat a vec_id
    are candidates each, but none for a query with their id; of repeated queries the smallest vector
    (by its components in order) asks. No usable vector gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    good, dim = usable(vectors)
    empty = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], empty)
    kind = dict(good.dtypes)["embedding"]
    points, shelf, wanted = centres(good, dim, good.count(), k, covered, seed)
    shelves = F.broadcast(spark.createDataFrame([(i, int(s)) for i, s in enumerate(shelf)], "list int, shelf int"))  # at most SAMPLE / PER_LIST rows
    assigned = good.mapInArrow(_assigner(points, dim), f"vec_id long, embedding {kind}, list int, square double")
    listed, listed_at = common.placed(assigned.join(shelves, "list"), "nearest-lists")
    counts = {r["list"]: r for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.max("square").alias("top")).collect()}
    held = np.array([counts[i]["n"] if i in counts else 0 for i in range(len(points))], np.int64)
    top = max(r["top"] for r in counts.values())
    queries = listed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    probed = queries.mapInArrow(_prober(points, shelf, dim, held, k, wanted), f"vec_id long, embedding {kind}, late boolean, shelf int, lists array<int>")
    probed, probed_at = common.placed(probed, "nearest-probes")
    asked = {r["shelf"]: r["n"] for r in probed.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
    full = np.bincount(shelf, weights=held).astype(int)
    dealt = [(i, max(1, -(-int(full[i]) // BLOCK)), max(1, -(-asked[i] // QUERIES))) for i in sorted(asked) if full[i]]
    if not dealt:
        return spark.createDataFrame([], empty)
    grid = F.broadcast(spark.createDataFrame(dealt, "shelf int, blocks int, stacks int"))  # a row a shelf
    right = listed.join(grid, "shelf").select("shelf", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("stacks") - 1)).alias("stack"), "vec_id", "embedding", "square", "list")

    def searched(part: DataFrame) -> DataFrame:
        left = part.join(grid, "shelf").select("shelf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("stacks")).cast("int").alias("stack"), "vec_id", "embedding", "lists", "bound")
        found = left.groupBy("shelf", "block", "stack").cogroup(right.groupBy("shelf", "block", "stack"))
        return found.applyInArrow(_searcher(dim, top, k, seed), "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = common.checkpoint(ranked(searched(probed.where("not late").withColumn("bound", F.lit(None).cast("double")))))
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    second = searched(probed.where("late").join(bounds, "vec_id", "left"))
    both = common.checkpoint(ranked(first.select("query_id", "vec_id", "score").unionByName(second)).select("query_id", "rank", "vec_id", "score"))
    common.cleared(spark, listed_at, probed_at)
    return both


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20."""
    return nearest(common.table(spark, sf_dir, "embeddings"))
