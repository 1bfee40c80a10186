import random
import re

import numpy as np
import pytest

from gatehouse.llm import common, ngram_join

SCHEMA = "doc_id long, text string, lang string, keys string, n long"


def brute(rows, size, percent):
    sets = []
    for doc_id, text in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        k = min(size, len(words))
        sets.append((doc_id, frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()))
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=str)


def corpus(seed, n=70):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 12, 40, 90]))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text).title() if i % 3 else " ".join(text)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two"), (None, rows[0][1]), (3, rows[3][1]), (7, rows[9][1]), (506, "é É"), (507, "é é"), (508, "x" * 50000)]
    return rows


@pytest.mark.parametrize(("size", "percent", "frequent"), [(3, 90, None), (3, 90, 3), (5, 80, 4), (1, 55, 2), (2, 100, 3)])
def test_components_equal_brute_force(spark, size, percent, frequent):
    rows = corpus(size * percent)
    docs = spark.createDataFrame([(d, t, "en", "k", 5) for d, t in rows], SCHEMA).repartition(5)
    got = ngram_join.near_duplicates(docs, size, percent, frequent, bits=12).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, size, percent)


def test_sketches_fold_and_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (400, 500), (513, 600), (700, 1300), (3000, 3300)):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, m, dtype=np.uint64)])
        a, b = ngram_join.parity(x), ngram_join.parity(y)
        while len(a) < len(b):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        while len(b) < len(a):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        apart = sum(int(i).bit_count() for i in (a ^ b).view(np.uint64))
        assert apart <= len(np.setxor1d(x, y))
        assert len(ngram_join.parity(y)) * 64 >= max(512, len(y))


def test_long_documents_link_as_brute_force_says(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([500, 900, 1020, 1100, 2100]))]
        rows.append((3 * i, " ".join(base)))
        rows.append((3 * i + 1, " ".join(base[: int(len(base) * 0.93)])))
        rows.append((3 * i + 2, " ".join(base + [rng.choice(words) for _ in range(len(base) // 8)])))
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(4)
    got = sorted(((tuple(r) for r in ngram_join.near_duplicates(docs, 3, 90).collect())), key=str)
    assert got == brute(rows, 3, 90) and any(c != d for d, _, c in got)


def test_repeated_ids_count_as_each_text(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(3)]
    rows = [(5, texts[0]), (5, texts[1]), (9, texts[0] + " x"), (7, texts[1] + " y"), (3, texts[2]), (8, texts[2] + " z")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(3)
    got = {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs, 3, 90).collect()}
    assert got == {(5, 5), (9, 5), (7, 5), (3, 3), (8, 3)}


def test_combinations_are_used_with_default_parameters(spark):
    """Documents made of common passages alone are indexed by pairs of shingles, not by single ones, and still link as brute force says."""
    rng = random.Random(6)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(6)]
    rows = [(i, " ".join([*rng.sample(passages, 4), *(["extra"] * (i % 3))])) for i in range(60)]
    rows += [(100 + i, " ".join(f"u{i}x{j}" for j in range(3000))) for i in range(6)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(4)
    counts = ngram_join.frequencies(docs.select("text"), 3)
    frequent = ngram_join.frequent_from(counts, 0.99)
    tokens = common.shingles(np.frombuffer(rows[0][1].encode(), np.uint8), 3)
    often = counts[(tokens >> np.uint64(64 - ngram_join.SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((tokens.view(np.int64), often))
    keys = ngram_join.prefix_keys(tokens[order], often[order], 90, frequent)
    singles, pairs = np.isin(keys, tokens).sum(), (~np.isin(keys, tokens)).sum()
    assert pairs > 0 and singles < len(tokens) // 10 + 1
    got = ngram_join.near_duplicates(docs, 3, 90, 2 ** ((frequent - 1) // ngram_join.STEPS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 3, 90)


def test_one_of_each_and_empty(spark):
    rows = [(2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (9, None), (8, "z"), (None, "a b c d e f")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    assert sorted((r.doc_id for r in ngram_join.one_of_each(docs).collect()), key=str) == [1, 8, 9, None]
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
