import math

import numpy as np
import pytest

from meterline.llm import whitening

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, components=32):
    """Whitening by a dense eigendecomposition in long double sums; deviations in whole numbers."""
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dim = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(dim)]
    off = np.array([[(n * x[j] - sums[j]) / n for j in range(dim)] for _, x in kept])
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return {i: (sum((n * a - s) ** 2 for a, s in zip(x, sums)), off[k]) for k, (i, x) in enumerate(kept)}, values, vectors, values / np.trace(off.T @ off / n)


def check(found, rows, components=32):
    known, values, vectors, explained = brute(rows, components)
    k = len(values)
    table = {}
    for r in found:
        assert r["n"] == len(known) and r["deviation"] == known[r["vec_id"]][0]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-10)
        assert r["identity_error"] < 1e-10
        table[r["vec_id"], r["component"]] = r["whitened"]
    ids = sorted(known)
    assert len(table) == len(ids) * k
    got = np.array([[table[i, c] for c in range(1, k + 1)] for i in ids])
    want = np.array([known[i][1] for i in ids]) @ vectors / np.sqrt(values)
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-6


def test_table_against_dense(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    check(whitening.whiten(vectors.repartition(5)).collect(), rows)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.standard_normal(5) * [9, 3, 1, 1, 0.5] + 1000]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, float("nan"), 2.0, 3.0, 4.0]), (104, [float("inf")] * 5)]
    frame = spark.createDataFrame([*rows, *odd], VECTORS).selectExpr("*", "1 AS x", "2 AS n", "'c' AS component")
    check(whitening.whiten(frame).collect(), rows)
    shorter = spark.createDataFrame([*rows, (None, [1.0, 2.0])], VECTORS)
    check(whitening.whiten(shorter).collect(), rows)
    twice = whitening.whiten(spark.createDataFrame([*rows, *rows, (None, rows[0][1])], VECTORS))
    assert twice.count() == 81 * 5 and twice.filter("vec_id IS NULL").count() == 5


def test_lists_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect() == []
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(line, VECTORS)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 6  # the rank is one


def test_large_deviations_stay_exact(spark):
    rows = [(i, [float(2**30 * i), 1.0]) for i in range(5)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    want = {i: d for i, (d, _) in brute(rows)[0].items()}
    assert got == {i: d if d < 2**63 else None for i, d in want.items()}


@pytest.mark.parametrize("dim, wanted, gap", [(300, 12, 1.3), (200, 32, 1.02), (40, 32, 1.5)])
def test_solver_reaches_double_precision(dim, wanted, gap):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    values = gap ** -np.arange(dim, dtype=float)
    values[3] = values[2]  # a tie
    matrix = (q * values) @ q.T
    count = []
    found, vectors = whitening.jacobi_davidson(lambda v: count.append(v.shape[1]) or matrix @ v, dim, wanted)
    assert np.abs(found - np.sort(values)[::-1][:wanted]).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-12
    assert len(count) < 300


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    matrix = rng.standard_normal((20, 20))
    matrix = matrix + matrix.T
    right = rng.standard_normal((20, 3))
    assert np.abs(matrix @ whitening.minres(lambda v: matrix @ v, right, 25) - right).max() < 1e-6


def test_sums_add_up_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    points = spark.range(100).selectExpr("array(id, 2 * id) AS x").repartition(11)
    assert whitening.total(points, 2, lambda x: x.sum(axis=0).astype("float64"), 2).tolist() == [4950.0, 9900.0]
