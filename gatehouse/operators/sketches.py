"""Statistics kept by day that merge into any span: quantile sketches and exact sets of users as bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank error that a sketch of this size stays below for nearly all quantiles.
K, RANK_ERROR = 800, 0.01


def daily_quantiles(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """(keys…, day, sketch, n): a sketch of each day's values; null values don't count. Its size is bounded, and it is built map-side without a sort."""
    own = rows.where(F.col(value).isNotNull())
    return own.groupBy(*keys, F.to_date(at).alias("day")).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("sketch"), F.count("*").alias("n"))


def merged_quantiles(daily: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """(keys…, n, names…): quantiles of all days of daily together, by the names of ranks."""
    merged = daily.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in ranks.items()])


def daily_users(rows: DataFrame, at: str, user: str) -> DataFrame:
    """(day, bucket, users): the users of each day as bitmaps, one for each stretch of 32,768 ids, built map-side; null users don't count."""
    own = rows.where(F.col(user).isNotNull()).select(F.to_date(at).alias("day"), F.bitmap_bucket_number(user).alias("bucket"), F.bitmap_bit_position(user).alias("bit"))
    return own.groupBy("day", "bucket").agg(F.bitmap_construct_agg("bit").alias("users"))


def rolling_users(daily: DataFrame, days: int) -> DataFrame:
    """(day, n): how many users there were on each day of daily or the days before it, `days` together; exact. Days are dealt to the spans that they belong to, and bitmaps merged by stretch."""
    known = daily.select("day").distinct()
    spans = daily.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_add("day", k))).alias("day"), "bucket", "users").join(known, "day", "left_semi")
    merged = spans.groupBy("day", "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return merged.groupBy("day").agg(F.sum(F.bitmap_count("users")).alias("n"))


def within(rows: DataFrame, keys: list[str], value: str, estimates: DataFrame, ranks: dict[str, float], error: float = RANK_ERROR) -> DataFrame:
    """(keys…, n, names…): whether each estimate's true rank is within an error of its own, by counting the values up to it."""
    joined = rows.where(F.col(value).isNotNull()).join(F.broadcast(estimates.select(*keys, *ranks)), keys)

    def share(name: str, strict: bool) -> Column:
        return F.count_if(F.col(value) < F.col(name) if strict else F.col(value) <= F.col(name)) / F.count("*")

    fits = [((share(name, True) <= q + error) & (share(name, False) >= q - error)).alias(name) for name, q in ranks.items()]
    return joined.groupBy(*keys).agg(F.count("*").alias("n"), *fits)
