"""Knowledge bases: what a user may see, and lexical and vector retrieval."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.sources.scratch import shared_dir

K1, B = 1.2, 0.75


def lexical(documents: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(doc_id, score): the k documents with the highest BM25 score for the query's words, ties to the smaller id.

    Each text is read once, into its length and its counts of the query's words; these narrow rows are
    kept, and both the corpus statistics, a one-row aggregate, and the scores are computed from them.
    Null texts take no part.
    """
    words = sorted({w.lower() for w in query.split()})
    low = F.lower("text")
    pattern = r"(?<!\S)(" + "|".join(r"\Q" + w + r"\E" for w in words) + r")(?!\S)"
    found = F.regexp_extract_all(low, F.lit(pattern), F.lit(1)).alias("found")
    read = documents.where("text is not null").select("doc_id", (F.regexp_count("text", F.lit(r"\s+")) + 1).alias("n"), found)
    count = lambda q: F.size(F.filter("found", lambda w: w == F.lit(q))).cast("long")
    counts = [count(q).alias(f"c{i}") for i, q in enumerate(words)]
    shared_dir(documents.sparkSession)
    held = read.select("doc_id", "n", *counts).checkpoint()
    stats = held.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(words))]).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        weight = math.log(1 + (stats["docs"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5))
        score = score + F.lit(weight) * F.col(f"c{i}") * (K1 + 1) / (F.col(f"c{i}") + K1 * (1 - B + B * F.col("n") / F.lit(stats["mean"] or 1.0)))
    return held.select("doc_id", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def changed(documents: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """documents without those whose doc_id is gone, and with the new ones."""
    return documents.join(gone, "doc_id", "left_anti").unionByName(new)


def page_then_filter(catalog: DataFrame, key: str, seen: Column, number: int, size: int) -> DataFrame:
    """A page of the catalog by key, of which the entries that may be seen stay, and total, their number: a page may be short or empty."""
    page = catalog.orderBy(key).offset((number - 1) * size).limit(size).where(seen)
    return page.withColumn("total", F.count("*").over(Window.partitionBy(F.lit(0))))  # at most a page of rows


def filter_then_page(catalog: DataFrame, key: str, seen: Column, number: int, size: int) -> DataFrame:
    """A page of those entries of the catalog that may be seen, and total, the number of them all."""
    own = catalog.where(seen)
    total = own.agg(F.count("*").alias("total"))  # one row
    return own.orderBy(key).offset((number - 1) * size).limit(size).join(F.broadcast(total), how="cross")


def vector(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """(vec_id, score): the k vectors most like the query's one row (q) by cosine, ties to the smaller id."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e, q = F.col("embedding"), F.col("q")
    joined = vectors.join(F.broadcast(query.limit(1)))  # one row
    return joined.select("vec_id", F.round(dot(e, q) / (F.sqrt(dot(e, e)) * F.sqrt(dot(q, q))), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)
