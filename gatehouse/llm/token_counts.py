"""Token counts of the sections of documents, from one encoding of each whole document: op6."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import chunks, common

VOCABULARY = "byte_bpe_50k.json"
#: Who gets a token that lies across a boundary: the section of its first or last character, or the one with most of it (the earlier of equals).
RULES = ("first", "last", "most")


def attribute(starts: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of tokens with adjoining sections: the section of each token by the rule, and whether it crosses a boundary.

    starts: ascending starts of the sections; first, last: places of each token's first and last character.
    """
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, last, "right") - 1
    crosses = a != b
    if rule == "last":
        return b, crosses
    if rule == "most" and crosses.any():
        a = a.copy()
        bounds = np.append(starts, np.iinfo(np.int64).max)
        for t in np.flatnonzero(crosses):
            own = np.arange(a[t], b[t] + 1)
            held = np.minimum(bounds[own + 1], last[t] + 1) - np.maximum(bounds[own], first[t])
            a[t] = own[np.argmax(held)]
    return a, crosses


def _counter(vocabulary: str, rule: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunks.ByteLevel(vocabulary)
        table = own.table()
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for low, high, raw, begins, stops, ids, _ in chunks.by_document(batch.column("text"), chunks.byte_level_cuts, table):
                # Bytes of the run, and with them its tokens, in characters.
                place = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, 0)
                ends = np.cumsum(own.bytes[ids])
                cut = np.flatnonzero(raw == 10) + 1
                starts = np.concatenate([begins, cut[~np.isin(cut, stops)]])
                document = np.concatenate([np.arange(high - low), np.searchsorted(begins, cut[~np.isin(cut, stops)], "right") - 1])
                # Documents without text have a section of their own that no token can reach.
                order = np.lexsort((starts, document))
                starts, document = starts[order], document[order]
                filled = stops[document] > begins[document]
                bounds = place[starts[filled]]
                n, over = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
                if filled.any():
                    section, crosses = attribute(bounds, place[ends - own.bytes[ids]], place[ends - 1], rule)
                    n[filled] = np.bincount(section, minlength=len(bounds))
                    over[filled] = np.bincount(section[crosses], minlength=len(bounds))
                fresh = np.flatnonzero(np.diff(document, prepend=-1))
                number = np.arange(len(starts)) - np.repeat(fresh, np.diff(np.append(fresh, len(starts))))
                length = place[-2] + 1 if len(raw) else 0
                at = np.append(place[:-1], length)
                base = at[begins[document]]
                upto = np.where(np.append(document[1:] == document[:-1], False), np.append(starts[1:], 0), stops[document])
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(document + low)), *[pa.array(x, pa.int64()) for x in (number, at[starts] - base, at[upto] - base, n, over)]], ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return count


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """Tokens of each line of each document: (doc_id, section, start, stop, n_tokens, n_crossing).

    A whole document is encoded once; the places of its tokens' characters are joined with the spans
    of its sections, so the counts of a document add up to the tokens of the whole text. A token that
    lies across a boundary counts once, where `rule` says, and in n_crossing of that section.

    Null or empty text gives one empty section with no token. Repeated rows are counted each. An
    empty table gives no rows; a null doc_id stays null. Other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(_counter(vocabulary, rule), "doc_id long, section long, start long, stop long, n_tokens long, n_crossing long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(common.table(spark, sf_dir, "documents"))
