"""Mixing sources to target weights by capped water-filling: op10 and a stage of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatehouse.llm import common

#: Weights of the sources in code point order, repeating; null is the last source.
WEIGHTS = (5, 2, 1)
#: Most epochs of a source.
MOST = 3
#: Slices of a source by hash; only the one in which its fraction ends is put in order.
SLICES = 4096
#: Sources up to which their targets are broadcast; beyond, a plain join takes over.
SOURCES = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for (source, source_size).

    Targets share the sum of all sizes by weight; a source whose share is above `most` times its
    size is clamped there and the excess is shared again by weight among the rest, until none is
    above. That fixed point is found directly: by ascending most * size / weight, the clamped sources
    are the leading ones, and the first level that the next source can bear is the answer. The window
    runs over one row a source.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int")))
    bound = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("bears", F.col("cap") / F.col("weight"))
    order = Window.orderBy("bears", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    clamped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = bound.withColumn("level", (total - clamped) / open_).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("bears"), F.struct("place", "level"))).over(Window.partitionBy())
    return level.withColumn("first", first).select("source", "source_size", F.least(F.col("cap"), F.coalesce("first.level", "level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17, slices: int = SLICES) -> DataFrame:
    """docs with size, source_size, target and times: how often the mix repeats each document.

    A source's target over its size is its number of epochs. Whole epochs repeat every document; the
    fraction repeats once more those first in a seeded order by hash, up to the document at which the
    source's words come nearest to the target. Slices of the hash are summed first, so that only the
    slice in which the fraction ends is sorted, and a hot source is never sorted in one task.

    The size is the number of words; null or empty text has size 0 and is taken as often as its
    source's whole epochs. A source without words has target 0. Null is a source of its own.
    Repeated rows and null ids count as documents of their own; an empty table gives no rows. Other
    columns are kept, whatever their names; added columns replace columns of the same names.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "times")]
    sized = docs.select(F.struct(*kept).alias("row"), "source", F.col("doc_id").alias("id"), F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("h"))
    sized = sized.withColumn("slice", F.pmod(F.shiftrightunsigned("h", 40), F.lit(slices)).cast("int"))
    sliced = common.checkpoint(sized.groupBy("source", "slice").agg(F.sum("size").alias("words")))
    wanted = targets(sliced.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    wanted = wanted.withColumn("epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    wanted = wanted.withColumn("whole", F.floor("epochs")).withColumn("part", (F.col("epochs") - F.col("whole")) * F.col("source_size"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    ends = sliced.withColumn("before", before).alias("s").join(wanted.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")))
    over = F.when(F.col("before") + F.col("words") > F.col("part"), F.struct("slice", "before"))
    ends = common.checkpoint(ends.groupBy(F.col("w.source").alias("of"), "source_size", "target", "whole", "part").agg(F.min(over).alias("end")))
    # A row a source; texts needn't be shuffled to meet so few.
    joined = sized.join(F.broadcast(ends) if ends.count() <= SOURCES else ends, F.col("source").eqNullSafe(F.col("of")))
    at = F.coalesce(F.col("end.slice"), F.lit(-1))
    outside = joined.where(F.col("slice") != at).withColumn("more", (F.col("slice") < at).cast("int"))
    edge = Window.partitionBy("of").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = joined.where(F.col("slice") == at).withColumn("upto", F.col("end.before") + F.sum("size").over(edge))
    inside = inside.withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("part")).cast("int")).drop("upto")
    both = outside.unionByName(inside)
    return both.select("row.*", "size", "source_size", "target", (F.col("whole") + F.when(F.col("size") > 0, F.col("more")).otherwise(0)).alias("times"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    mixed = mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))
