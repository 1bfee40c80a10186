import os

import numpy as np
import pytest

from gatehouse.llm import nearest
from gatehouse.llm.nearest import nearest as search

SCHEMA = "vec_id long, embedding array<float>, list int, rank string"


def brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            order = sorted((-float(q @ y), j) for j, y in zip(ids, x, strict=True) if j != i)
            out[i] = [j for _, j in order[:k]]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_order(spark, monkeypatch, scale):
    monkeypatch.setattr(nearest, "BLOCK", 200)
    rng = np.random.default_rng(3)
    n = 1500
    x = rng.standard_normal((n, 24)) + 2 * rng.standard_normal((10, 24))[rng.integers(0, 10, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= rng.uniform(0.5, 2, n)[:, None]
    x[100:140] = x[100]
    x = x.astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist(), 0, "r") for i, v in enumerate(x)]
    odd = [(5000, None, 0, "r"), (5020, [], 0, "r"), (5040, [0.0] * 24, 0, "r"), (5060, [float("nan")] * 24, 0, "r"), (5080, [None] * 24, 0, "r"), (None, [1.0] * 24, 0, "r")]
    got = search(spark.createDataFrame(rows + odd, SCHEMA).repartition(6)).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]])
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
    wanted = brute(range(n), x, 20, 20)
    assert found.keys() == wanted.keys()
    assert all(v == sorted(v, key=lambda p: (-p[0], p[1])) and len(v) == 20 for v in found.values())
    recall = np.mean([len({j for _, j in found[i]} & set(w)) / 20 for i, w in wanted.items()])
    assert recall >= 0.9


def test_shares_are_beta_quantiles():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200_000, 64)) ** 2
    for done, share in nearest.shares(64, 0.01)[:-1]:
        assert np.mean(x[:, :done].sum(1) / x.sum(1) > share) == pytest.approx(0.01, abs=0.002)


def test_scan_finds_what_is_within_the_bound():
    rng = np.random.default_rng(2)
    q, x = rng.standard_normal((30, 65)), rng.standard_normal((2000, 65))
    away = ((q[:, None] - x[None]) ** 2).sum(2)
    bound = np.partition(away, 20, axis=1)[:, 20]
    bound[0] = np.inf
    found = set(zip(*map(np.ndarray.tolist, nearest.scan(q, x, bound, nearest.shares(65))), strict=True))
    wanted = set(zip(*map(np.ndarray.tolist, np.nonzero(away <= bound[:, None])), strict=True))
    assert found <= wanted and len(found) >= 0.99 * len(wanted) and len(found) < len(wanted) + 1


def test_odd_lengths_and_repeated_queries(spark):
    rows = [(20, [3.0, 1.0], 0, ""), (20, [1.0, 3.0], 0, ""), (1, [1.0, 0.0], 0, ""), (2, [0.0, 1.0], 0, ""), (40, [1.0, 0.0, 0.0], 0, ""), (5, [1.0], 0, "")]
    got = [tuple(r) for r in search(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()]
    assert got == [(20, 1, 2, 3.0), (20, 2, 1, 1.0)]


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1", "check_s"])
def test_recall_on_the_given_tables(spark, name):
    path = f"/root/testdata/{name}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no such table here")
    table = spark.read.parquet(path)
    rows = table.select("vec_id", "embedding").toArrow()
    ids, x = np.asarray(rows.column("vec_id")), nearest._matrix(rows.column("embedding"), 64)
    found = {}
    for r in search(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 20 == 0)
    assert found.keys() == set(ids[asked].tolist())
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = ids[np.argsort(-scores, axis=1)[:, :20]]
    recall = np.mean([len(found[int(i)] & set(b.tolist())) / 20 for i, b in zip(ids[asked], best, strict=True)])
    print(name, round(recall, 3))
    assert recall >= 0.9


def test_few_vectors_and_none(spark):
    rows = [(0, [1.0, 0.0], 0, ""), (20, [0.0, 1.0], 0, ""), (3, [1.0, 1.0], 0, ""), (3, [1.0, 1.0], 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 3, 1.0), (20, 3, 0, 0.0)]
    assert search(df.limit(0)).count() == 0
