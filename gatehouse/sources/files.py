"""Files as tables: listings, lines, and chunks of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, size) of the files of one folder, not of those below it; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def oversized(files: DataFrame, most: int) -> DataFrame:
    """files (…, size) with outcome ok or too_large."""
    return files.withColumn("outcome", F.when(F.col("size") > most, "too_large").otherwise("ok"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line) of text files; at grows along each file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def stream_lines(spark: SparkSession, folder: str, files_a_batch: int = 8) -> DataFrame:
    """(path, line) of text files as they come, so many a micro-batch: event streams caught in files."""
    read = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
