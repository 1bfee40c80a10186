"""Limits: requests a minute, upload sizes, and files past their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breaches(requests: DataFrame, at: str, width: str, most: int, who: str = "user_id") -> DataFrame:
    """(who, start, n): windows in which someone makes more than `most` requests; summed up map-side."""
    own = requests.groupBy(who, F.window(at, width).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return own.select(who, F.col("w.start").alias("start"), "n")


def admitted(chunks: DataFrame, most: int) -> DataFrame:
    """(upload_id, n_read, bytes, outcome) of chunks (upload_id, seq, size): chunks are read in order until their sum exceeds `most`; then the upload is too_large and what follows is not read."""
    along = Window.partitionBy("upload_id").orderBy("seq")
    before = F.coalesce(F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = chunks.select("upload_id", "size", before.alias("before")).where(F.col("before") <= most)
    return read.groupBy("upload_id").agg(F.count("*").alias("n_read"), F.sum("size").alias("bytes")).withColumn("outcome", F.when(F.col("bytes") > most, "too_large").otherwise("ok"))


def expired(files: DataFrame, modified: str, now: Column, days: int = 30) -> DataFrame:
    """Files last changed more than so many days ago; those without a time stay."""
    return files.where(F.col(modified) < now - F.make_dt_interval(F.lit(days)))
