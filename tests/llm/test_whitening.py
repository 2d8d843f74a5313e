"""Whitening against plain numpy and exact whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcanon.llm import queries, whitening
from fieldcanon.llm.eigen import leading, leading_values, tridiagonal

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, components=4):
    """Rows ``(vec_id, x)``, the fit list's number, and numpy's eigenvalues and vectors."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    matrix = np.cov(np.array(fit, float).T, bias=True)
    values, vectors = np.linalg.eigh(matrix)
    return kept, fit, values[::-1][:components], vectors[:, ::-1][:, :components], np.trace(matrix)


def check(got, rows):
    kept, fit, values, vectors, trace = slow(rows)
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    assert len(got) == len(kept) * len(values)
    by_row = sorted((i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept)
    assert sorted((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == by_row
    mean = np.array(sums) / n
    want = sorted((i, k + 1, abs((np.array(x) - mean) @ vectors[:, k]) / math.sqrt(values[k])) for i, x in kept for k in range(len(values)))
    assert [w[:2] for w in want] == sorted((r.vec_id, r.component) for r in got)
    assert np.allclose([w[2] for w in want], [w[2] for w in sorted((r.vec_id, r.component, abs(r.whitened)) for r in got)], rtol=0, atol=1e-8)
    for r in got:
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-10)


def table_rows(n=300, d=12, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) / 3).astype(np.float32).tolist()
    rows = list(enumerate(x))
    return rows + [(n + i, x[0]) for i in range(n)] + [(5, x[7])]  # half of all rows repeat one vector


def test_against_numpy(spark):
    rows = table_rows()
    odd = [(9001, None), (9002, [1.0, None] + [0.0] * 10), (9003, [math.nan] * 12), (9004, [math.inf] + [0.0] * 11), (9005, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], SCHEMA).repartition(5)
    for c in ("x", "n", "component", "size", "at", "total", "i", "v"):
        df = df.withColumn(c, F.lit("clash"))
    check(whitening.whitened(df).collect(), rows)


def test_query_on_table(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check(queries.QUERIES["op13_whitening"](spark, data).collect(), rows)


def test_edges(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    empty = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert empty.columns == names and empty.collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect() == []
    # Another length is dropped; a null id stays; a dimension that is the double of another adds no component.
    rows = [(None, [0.0, 0.0, 3.0]), (1, [1.0, 2.0, 3.0]), (1, [-2.0, -4.0, 3.0]), (3, [1.0])]
    got = whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert {r.component for r in got} == {1} and len(got) == 3 and {r.vec_id for r in got} == {None, 1}
    assert got[0].explained == pytest.approx(1) and got[0].n == 3


def test_large_deviations_are_exact(spark):
    rows = [(i, [float(2**30 * (i - 2)), float(i * i), -7.25]) for i in range(5)]
    got = whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    kept, fit, *_ = slow(rows)
    sums = [sum(c) for c in zip(*fit)]
    want = {i: sum((len(fit) * c - s) ** 2 for c, s in zip(x, sums)) for i, x in kept}
    assert {r.vec_id: int(r.deviation) for r in got} == want and max(want.values()) > 2**64


@pytest.mark.parametrize("seed", range(6))
def test_leading(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 3, 8, 40, 90])
    m = np.random.default_rng(seed).standard_normal((n, n))
    q, _ = np.linalg.qr(m)
    spectra = [m @ m.T, q @ np.diag([5.0] * min(3, n) + [1.0] * (n - min(3, n))) @ q.T, np.eye(n), np.diag(np.arange(n, dtype=float)), np.zeros((n, n)), q @ np.diag([1 + 1e-9 * i for i in range(n)]) @ q.T, np.ones((n, n)) * 1e200]
    for a in spectra:
        a = (a + a.T) / 2
        k = min(4, n)
        values, vectors = leading(a, k)
        size = max(np.abs(a).max() * n, 1e-300)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=0, atol=1e-13 * size)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size


def test_bisection_finds_all_values():
    a = np.random.default_rng(3).standard_normal((30, 30))
    a = a + a.T
    d, e, _ = tridiagonal(a)
    assert np.allclose(leading_values(d, e, 30), np.linalg.eigvalsh(a)[::-1], atol=1e-12)
