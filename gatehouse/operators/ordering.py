"""Places and neighbours in an order of a whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.operators.names import unused
from gatehouse.sources.scratch import shared_dir


def _ranged(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, str, str]:
    """rows in ranges of the order, with the range and the place in it; kept, so that both stay what they are."""
    shared_dir(rows.sparkSession)
    part, within = unused(rows, "part"), unused(rows, "within")
    ranged = rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    numbered = ranged.withColumn(within, F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("long"))
    return numbered.checkpoint(), part, within


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order that must be total: counted range by range, and only the ranges' sizes, a row each, are summed up in one task."""
    own, part, within = _ranged(rows, order)
    sizes = own.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))
    return own.join(F.broadcast(before), part).select(*rows.columns, (F.col("before") + F.col(within)).alias(name))


def with_next(rows: DataFrame, order: list[Column], keys: list[str]) -> DataFrame:
    """rows with next, a struct of keys of the row that follows in an order that must be total, null for the last: read from the neighbour within a range, and from the next range's first row at its end."""
    own, part, within = _ranged(rows, order)
    following = F.lead(F.struct(*keys)).over(Window.partitionBy(part).orderBy(within))
    first = own.where(F.col(within) == 1).select(part, F.struct(*keys).alias("first"))
    after = first.select(part, F.lead("first").over(Window.orderBy(part)).alias("after"))  # a row a range
    joined = own.withColumn("next", following).join(F.broadcast(after), part)
    return joined.select(*rows.columns, F.coalesce("next", "after").alias("next"))
