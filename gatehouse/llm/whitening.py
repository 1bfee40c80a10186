"""Embedding whitening from exact covariances by products of digit slices: op12."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 32
#: Bits of a limb and rows of a block: 2 * LIMB + 13 = 53 bits, so a float64 product of two limbs' blocks is exact.
LIMB, ROWS = 20, 1 << 13
#: Bits of the parts in which big integers travel; a sum of 2^31 of them fits a long.
PART = 32
#: Blocks after which 64-bit sums are carried over to big integers.
CARRY = 64

_LONG = 1 << 63


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) without vectors that are null, empty or hold null or non-finite entries, or whose length isn't the commonest (of equally common ones the smallest), and that length; 0 if there is none."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = own.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    size = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return (good.where(F.size("embedding") == size["dim"]), size["dim"]) if size else (good, 0)


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """The long of each entry; what a long can't hold is held at its ends."""
    y = np.floor(SCALE * np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim))
    high, low = y >= float(_LONG - (1 << 21)), y < float(-_LONG)
    out = np.where(high | low, 0.0, y).astype(np.int64) + SHIFT
    out[high], out[low] = _LONG - 1, SHIFT - _LONG
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers where they fit, else as Python's."""
    most = max(map(abs, sums), default=0) + n * max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if most < _LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def limbs(d: np.ndarray, bits: int = LIMB) -> list[np.ndarray]:
    """Digit slices of integers, the lowest first, as doubles: each but the last from 0 to 2^bits - 1, the last signed and no larger."""
    out = []
    while True:
        if not d.size or max(abs(int(d.min())), abs(int(d.max()))) < 1 << bits:
            return [*out, d.astype(np.float64)]
        high = d >> bits
        out.append((d - (high << bits)).astype(np.float64))
        d = high


def square_sums(d: np.ndarray) -> list[int]:
    """Sum of squares of each row, exactly."""
    parts = limbs(d)
    total = [0] * len(d)
    for p in range(len(parts)):
        for q in range(p, len(parts)):
            # A row has fewer than 2^13 entries at a time, so these sums of products of limbs are exact.
            for at in range(0, d.shape[1], ROWS):
                part = np.einsum("ij,ij->i", parts[p][:, at : at + ROWS], parts[q][:, at : at + ROWS])
                for i, v in enumerate(part.astype(np.int64).tolist()):
                    total[i] += v << (LIMB * (p + q) + (q > p))
    return total


class Gram:
    """Sums of d.T @ d over blocks of integers, exact whatever their size."""

    def __init__(self, dim: int) -> None:
        self.dim, self.blocks = dim, 0
        self.levels: dict[int, np.ndarray] = {}
        self.total = np.zeros((dim, dim), object)

    def add(self, d: np.ndarray) -> None:
        for at in range(0, len(d), ROWS):
            parts = limbs(d[at : at + ROWS])
            for p, left in enumerate(parts):
                for q in range(p, len(parts)):
                    product = (left.T @ parts[q]).astype(np.int64)
                    held = self.levels.setdefault(p + q, np.zeros((self.dim, self.dim), np.int64))
                    held += product if p == q else product + product.T
            self.blocks += 1
            if self.blocks % CARRY == 0:
                self.carry()

    def carry(self) -> None:
        for level, held in self.levels.items():
            self.total += held.astype(object) << (LIMB * level)
        self.levels = {}


def parts_of(value: int) -> list[int]:
    """An integer's parts of PART bits, the lowest first, the last signed."""
    out = []
    while not -(1 << PART) < value < 1 << PART:
        out.append(value & ((1 << PART) - 1))
        value >>= PART
    return [*out, value]


_CELLS = ["cell", "part", "value"]


def _cells(values: list[int]) -> pa.RecordBatch:
    rows = [(c, k, v) for c, x in enumerate(values) if x for k, v in enumerate(parts_of(x))]
    cell, part, value = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(part, pa.int32()), pa.array(value, pa.int64())], names=_CELLS)


def _summed(cells: DataFrame, n: int) -> list[int]:
    """n big integers, summed by Spark part by part and put together here."""
    out = [0] * n
    for r in cells.groupBy("cell", "part").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] += r["value"] << (PART * r["part"])
    return out


def entry_sums(good: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column("embedding"), dim)
                n += len(x)
                high += (x >> PART).sum(0)
                low += (x & ((1 << PART) - 1)).sum(0)
        yield _cells([n, *[(h << PART) + v for h, v in zip(high.tolist(), low.tolist(), strict=True)]])

    n, *sums = _summed(good.select("embedding").mapInArrow(add, "cell long, part int, value long"), dim + 1)
    return n, sums


def covariance(good: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of the integer vectors with divisor n, each entry the double next to the exact value.

    Rows are centred first: n * x - S are integers, so their products are sums of products of limbs
    that float64 BLAS gives exactly. What comes to the driver is one big integer for each pair of dimensions.
    """
    upper = np.triu_indices(dim)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = Gram(dim)
        for batch in batches:
            if batch.num_rows:
                gram.add(deviations(integers(batch.column("embedding"), dim), n, sums))
        gram.carry()
        yield _cells(gram.total[upper].tolist())

    exact = _summed(good.select("embedding").mapInArrow(add, "cell long, part int, value long"), len(upper[0]))
    out = np.zeros((dim, dim))
    out[upper] = [float(Fraction(v, n**3)) for v in exact]
    return np.maximum(out, out.T) if dim == 1 else out + np.triu(out, 1).T


def axes(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; a vector's largest entry is positive."""
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    sign = np.sign(w[np.argmax(np.abs(w), axis=0), np.arange(w.shape[1])])
    return e, w * np.where(sign == 0, 1.0, sign)


def whitened_rows(x: np.ndarray, n: int, sums: list[int], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and x - S / n by columns of matrix."""
    d = deviations(x, n, sums)
    return d, (d.astype(np.float64) / n) @ matrix


def _identity_error(good: DataFrame, dim: int, n: int, sums: list[int], matrix: np.ndarray) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity.

    Each task centres its own rows by their mean before it multiplies; tasks' squares meet with what
    their means add (sums of n_t * m_t * m_t'), in decimals, so that the order of the sum is of no account.
    """
    k = matrix.shape[1]
    upper = np.triu_indices(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = integers(batch.column("embedding"), dim) if batch.num_rows else np.zeros((0, dim), np.int64)
            for at in range(0, len(x), ROWS):
                z = whitened_rows(x[at : at + ROWS], n, sums, matrix)[1]
                own = z.mean(0)
                step = own - mean
                square += (z - own).T @ (z - own) + np.outer(step, step) * (rows * len(z) / (rows + len(z)))
                mean += step * (len(z) / (rows + len(z)))
                rows += len(z)
        values = np.concatenate([rows * mean, (square + rows * np.outer(mean, mean))[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["cell", "value"])

    cells = good.select("embedding").mapInArrow(add, "cell long, value double").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,15)")).alias("value"))
    found = {r["cell"]: float(r["value"]) for r in cells.collect()}
    mean = np.array([found[i] for i in range(k)]) / n
    cov = np.array([found[k + i] for i in range(len(upper[0]))]) / n - mean[upper[0]] * mean[upper[1]]
    return float(np.abs(cov - (upper[0] == upper[1])).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits): each vector along the principal components of all, in units of their standard deviations.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do those whose
    length isn't the commonest one; repeated rows count as often as they come, and a null vec_id
    stays. Entries that a long can't hold count as its ends. A component without variance (an
    eigenvalue up to the dimensions times the rounding of the largest) has a null whitened, and takes no
    part in identity_error, which is null if there is no other; explained is null if no dimension
    varies. deviation is null where it is beyond a long; deviation_digits has it in any case. An empty
    table gives no rows. Other columns are ignored.

    The driver gets one integer a dimension, one for each pair of dimensions and one double for each pair
    of components, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    good, dim = usable(vectors)
    n, sums = entry_sums(good, dim) if dim else (0, [])
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    if not n:
        return spark.createDataFrame([], schema)
    v = covariance(good, dim, n, sums)
    e, w = axes(v, components)
    varies = e > dim * np.finfo(float).eps * max(float(e[0]), 0.0)
    matrix = w[:, varies] / np.sqrt(e[varies])
    trace = math.fsum(np.diag(v).tolist())
    error = _identity_error(good, dim, n, sums, matrix) if varies.any() else None
    explained = [float(x) / trace if trace else None for x in e.tolist()]
    k, place = len(e), np.flatnonzero(varies)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                d, z = whitened_rows(integers(part.column("embedding"), dim), n, sums, matrix)
                out, known = np.zeros((len(z), k)), np.zeros((len(z), k), bool)
                out[:, place], known[:, place] = z, True
                squares = square_sums(d)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * k), pa.array(out.ravel(), pa.float64(), mask=~known.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([s if s < _LONG else None for s in squares], pa.int64()), pa.array(map(str, squares), pa.string()), rows], names=["vec_id", "deviation", "deviation_digits", "z"])

    rows = good.mapInArrow(project, "vec_id long, deviation long, deviation_digits string, z array<double>")
    told = F.array(*[F.lit(x).cast("double") for x in explained])
    each = rows.select("vec_id", "deviation", "deviation_digits", F.posexplode("z").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(told, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_digits",
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding along the 32 first components."""
    return whiten(common.table(spark, sf_dir, "embeddings"))
