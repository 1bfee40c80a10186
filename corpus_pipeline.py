"""A training corpus from the documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common, line_dedup, mixing, ngram_join, sentencepiece_codec, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts and null ids stay; repeated rows are judged each; an empty table, or labels of
    one class only, reject nothing. Columns of any names are kept.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document or an earlier place has already go, and documents of which nothing but such lines was there.

    Null and empty texts stay; rows of one doc_id are documents each; columns of any names are kept, and
    n_chars follows the text.
    """
    rows = docs.select("doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else []), F.struct(*docs.columns).alias("row"))
    kept = line_dedup.dedup_lines(rows).where("n_dropped = 0 or n_dropped < n_lines")
    return kept.select(*[F.col(c) if c in ("text", "n_chars") else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays, that with the smallest id, and one row of a repeated id.

    Documents without words, and rows without an id, are nobody's copies and stay.
    """
    return ngram_join.one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    A null source is a source of its own; a source without words has no target, so its documents go;
    columns of any names are kept.
    """
    mixed = mixing.mix(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("kept"))).where("times > 0")
    return mixed.select("kept", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))).select("kept.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it; null and empty texts have none."""
    return sentencepiece_codec.encode(docs).select("doc_id", "n_pieces", "ids", "exact")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", encode)]

#: The stages learn from labels and compare lines by edits, so SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage read is cleared once the next one's table is written."""
    docs, held = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = common.placed(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.cleared(spark, *held)
        held = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
