"""A table that a stream adds to, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.streaming import machines


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def added(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """What was added to the table, with batch, the micro-batch that added it; no rows where there is none yet."""
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{target}/batch=-1")
    return spark.read.schema(f"{schema}, batch int").option("basePath", target).parquet(f"{target}/batch=*")


def once(held: DataFrame, target: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """What a stream does with each micro-batch: of each key its first row by order goes to the table, unless held or an earlier micro-batch has the key.

    Each micro-batch has a folder of its own, and the largest number among these is the last batch. One
    that runs again because the stream broke off replaces its own rows, judged against earlier batches
    alone, so they are the same; one before the last is done for good and left as it is.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = added(spark, target, _schema(batch))
        last = before.agg(F.max("batch")).first()[0]
        if last is not None and n < last:
            return
        first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        known = held.select(key).unionByName(before.where(F.col("batch") < n).select(key))
        first.join(known, key, "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return write


def written_once(stream: DataFrame, held: DataFrame, target: str, key: str, order: str, wrap: Callable = lambda write: write) -> None:
    """Adds a stream's rows to the table until its input is used up (once). wrap: what is put around the writing of each micro-batch."""
    with machines.typed_state(stream.sparkSession):
        query = stream.writeStream.option("checkpointLocation", f"{target}-state").trigger(availableNow=True).foreachBatch(wrap(once(held, target, key, order))).start()
    query.awaitTermination()


def with_held(spark: SparkSession, held: DataFrame, target: str) -> DataFrame:
    """held and all that was added to it."""
    return held.unionByName(added(spark, target, _schema(held)).select(*held.columns))
