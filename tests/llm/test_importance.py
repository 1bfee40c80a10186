"""op13 against a plain version of its contract."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gatehouse.llm import importance
from gatehouse.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams(words, longest):
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, longest=2, buckets=10_000, least=20, percent=25, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, x in docs for f in grams(words_of(x), longest))
    t = Counter(bucket(f) for x in target for f in grams(words_of(x), longest))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, x in docs:
        own = [bucket(f) for f in grams(words_of(x), longest)]
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in own]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x)) >= least])
    may = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_equals_a_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = QUERIES["op13_importance"](spark, SF)
    assert out.dtypes[:5] == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert got(out) == plain(docs, target)


ODD = [
    (1, None), (2, ""), (3, "one"), (3, "one"), (3, "One two"), (None, "no id " * 30), (4, "é😀 ß字 \x80x A_b-C9 " * 20), (5, "a b " * 30), (6, "w" * 70_000 + " tail"),
    (7, "same words here again " * 10), (8, "same words here again " * 10), (9, "same words here again " * 10), (10, " ".join(f"n{i}" for i in range(5000))), (11, "!!! ... ???"), (12, "end"), (13, "Start of it " * 9),
]


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
@pytest.mark.parametrize("block", [64, 4 << 20])
def test_odd_rows(spark, monkeypatch, longest, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in ODD], "doc_id long, text string, score int, buckets string").repartition(3)
    target = spark.createDataFrame([("again same words",), (None,), ("",)], "text string")
    assert got(importance.resample(docs, target, longest, 50, 3, 60)) == plain(ODD, ["again same words", None, ""], longest, 50, 3, 60)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(docs, target).count() == 0
    some = spark.createDataFrame([(d, "x y z " * 10) for d in range(9)], "doc_id long, text string")
    assert got(importance.resample(some, target.limit(0))) == plain([(d, "x y z " * 10) for d in range(9)], [])


def test_equal_scores_are_dealt_by_id(spark):
    rows = [(5, "a b c d " * 6)] * 4 + [(4, "a b c d " * 6)] * 4
    out = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string"), percent=50)
    assert got(out) == plain(rows, ["a"], percent=50)
    assert out.where("rank is not null").count() == 4


def test_suffixes_are_sorted_and_share_what_they_share():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 3, 4, 6):
        ids = rng.integers(0, 4, 200)
        order, shared = importance.suffixes(ids, depth)
        at = lambda i: tuple(ids[i : i + depth].tolist())
        assert sorted(order.tolist()) == list(range(200))
        keys = [at(i) for i in order.tolist()]
        assert keys == sorted(keys)
        for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), shared[1:].tolist(), strict=True):
            x, y = [np.pad(ids[i : i + depth], (0, max(0, i + depth - 200))) for i in (a, b)]
            assert n == next((k for k in range(depth) if x[k] != y[k]), depth)


def test_joined_crc():
    rng = np.random.default_rng(4)
    left = [rng.bytes(int(n)) for n in rng.integers(0, 40, 60)]
    right = [rng.bytes(int(n)) for n in [*rng.integers(0, 300, 58), 5000, 0]]
    crc = lambda x: np.array([zlib.crc32(b) for b in x], np.uint32)
    assert importance.joined_crc(crc(left), crc(right), np.array([len(b) for b in right])).tolist() == [zlib.crc32(a + b) for a, b in zip(left, right, strict=True)]
