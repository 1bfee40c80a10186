"""op12 against exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from gatehouse.llm import whitening
from gatehouse.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
ARRAY = "vec_id long, embedding array<double>, n int, deviation string"


def exact(vectors):
    """n, sums, deviations and the covariance of whole lists of numbers, by Python's integers."""
    x = [[min(max(math.floor(64 * c), -(2**63)), 2**63 - 1 - 1_000_000) + 1_000_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(dim)]
    d = [[n * r[k] - sums[k] for k in range(dim)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in range(dim)] for i in range(dim)])
    return n, d, v


def check(rows, vectors, components=32):
    """rows of whiten, by vec_id, against the contract for vectors {vec_id: list}."""
    ids = sorted(vectors)
    n, d, v = exact([vectors[i] for i in ids])
    k = min(components, len(v))
    e = np.sort(np.linalg.eigvalsh(v))[::-1][:k]
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, c) for i in ids for c in range(1, k + 1)]
    assert {r.n for r in rows} == {n}
    held = {(r.vec_id, r.component): r for r in rows}
    for i, own in zip(ids, d, strict=True):
        assert {held[i, c].deviation_digits for c in range(1, k + 1)} == {str(sum(x * x for x in own))}
        assert held[i, 1].deviation == (sum(x * x for x in own) if sum(x * x for x in own) < 2**63 else None)
    assert np.allclose([held[ids[0], c].explained for c in range(1, k + 1)], e / np.trace(v), rtol=1e-9, atol=1e-15)
    z = np.array([[held[i, c].whitened for c in range(1, k + 1)] for i in ids], float)
    good = e > 1e-9 * e[0]
    z = z[:, good]
    x = np.array([[float(Fraction(a, n)) for a in r] for r in d])
    cov = z.T @ z / n
    assert np.abs(cov - np.eye(z.shape[1])).max() < 1e-8
    assert held[ids[0], 1].identity_error < 1e-8
    # Projections on unit eigenvectors: what is whitened, scaled back, comes from vectors w with V w = e w.
    w = np.linalg.lstsq(x, z * np.sqrt(e[good]), rcond=None)[0]
    assert np.abs(v @ w - w * e[good]).max() < 1e-7 * e[0]
    if (e > 1e-9 * e[0]).sum() == len(v):
        assert np.allclose((w * w).sum(0), 1)
        signed = w[np.argmax(np.abs(w), axis=0), np.arange(w.shape[1])]
        assert (signed > 0).all()


def test_query(spark):
    out = QUERIES["op12_whitening"](spark, SF)
    assert dict(out.dtypes) | {"deviation_digits": "string"} == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double", "deviation_digits": "string"}
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check(out.collect(), {i: v for i, v in given.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)})


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e15, 1e30])
def test_large_entries_stay_exact(spark, scale):
    rng = np.random.default_rng(2)
    given = {i: (rng.normal(size=5) * scale * [1, 2, 3, 0.5, 0.1]).tolist() for i in range(60)}
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in given.items()], ARRAY).repartition(7)
    check(whitening.whiten(df, 4).collect(), given, 4)


def test_odd_rows(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, [2.0, 0.0]), (None, [1.0, 1.0]), (1, [0.5, 1.0]), (5, None), (6, []), (7, [1.0]), (8, [1.0, None]), (9, [1.0, float("nan")]), (10, [float("inf"), 0.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 3, "x") for i, v in rows], ARRAY)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert {r.n for r in got} == {5} and got[0].identity_error < 1e-9


def test_without_variance_or_rows(spark):
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], ARRAY)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, None, None, None)] * 4
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [3.0, 2.0], 0, "")], ARRAY)).collect()
    assert sorted((r.vec_id, r.component, r.whitened, r.explained) for r in flat) == [(1, 1, -1.0, 1.0), (1, 2, None, 0.0), (2, 1, 1.0, 1.0), (2, 2, None, 0.0)]
    for rows in ([], [(1, None, 0, ""), (2, [], 0, "")]):
        assert whitening.whiten(spark.createDataFrame(rows, ARRAY)).collect() == []


def test_products_of_limbs_are_exact(monkeypatch):
    monkeypatch.setattr(whitening, "CARRY", 2)
    monkeypatch.setattr(whitening, "ROWS", 64)
    rng = np.random.default_rng(1)
    for bits in (5, 20, 45, 62):
        d = rng.integers(-(1 << bits), 1 << bits, (300, 4))
        gram = whitening.Gram(4)
        gram.add(d[:200])
        gram.add(d[200:])
        gram.carry()
        big = d.astype(object)
        assert gram.total.tolist() == (big.T @ big).tolist()
        assert whitening.square_sums(d) == [sum(x * x for x in r) for r in big.tolist()]
    for v in (0, 5, -5, 1 << 32, -(1 << 32), (1 << 90) + 7, -(1 << 90) - 7):
        parts = whitening.parts_of(v)
        assert sum(p << (32 * k) for k, p in enumerate(parts)) == v and all(abs(p) <= 1 << 32 for p in parts)
