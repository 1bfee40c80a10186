"""Tables kept in parts by a hash of their key: a change rewrites the parts that it touches, and leaves all other files as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.sources.scratch import shared_dir

#: Names of the columns that the files have besides the table's own.
PART, LIVE = "_part", "_live"


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def create(rows: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """Writes rows to path in parts."""
    _write(rows.withColumn(PART, _part(key, parts)).withColumn(LIVE, F.lit(True)), path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """The table as it stands."""
    return spark.read.parquet(path).where(LIVE).drop(PART, LIVE)


def touched(keys: DataFrame, key: str, parts: int) -> list[int]:
    """The parts in which keys lie, at most `parts` numbers."""
    return sorted(r[0] for r in keys.select(_part(key, parts).alias("p")).distinct().collect())


def change(spark: SparkSession, path: str, key: str, keys: DataFrame, how: Callable[[DataFrame], DataFrame], parts: int = 64) -> list[int]:
    """Applies how (old rows to new rows) to the parts in which keys lie, and returns these; no other file is read or written.

    how must keep the key of every row, or make rows of keys alone: rows of other parts would be an error
    and are refused. The new rows are kept in the shared folder before the old files give way, so one run
    that breaks off leaves the table as it was or has it changed part by part, and running it again is
    safe where how applied twice is the same as once. A part whose rows all go keeps an empty file's place by a row that isn't live.
    """
    shared_dir(spark)
    where = touched(keys, key, parts)
    if not where:
        return []
    old = spark.read.parquet(path).where(F.col(PART).isin(where))
    new = how(old.where(LIVE).drop(PART, LIVE)).withColumn(PART, _part(key, parts)).withColumn(LIVE, F.lit(True))
    marks = spark.createDataFrame([(p,) for p in where], f"{PART} int").withColumn(LIVE, F.lit(False))
    held = new.unionByName(marks, allowMissingColumns=True).checkpoint()
    strayed = held.where(~F.col(PART).isin(where))
    if not strayed.isEmpty():
        raise ValueError("a change made rows outside the parts of its keys")
    _write(held, path)
    return where
