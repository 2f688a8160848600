import math

import numpy as np
import pytest

from tillframe.llm import queries, whitening as wh

SCHEMA = "vec_id long, embedding array<float>, component int"


def brute(rows, components=32):
    """Ids, deviations, whitened rows (either sign) and explained shares by an eigendecomposition of exactly centred rows."""
    sound = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in sound], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    away = n * x - sums
    centred = away.astype(np.float64) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, x.shape[1])
    return [i for i, _ in sound], (away * away).sum(axis=1).tolist(), centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(found, wanted, tolerance):
    ids, deviation, whitened, explained = wanted
    k = whitened.shape[1]
    table = sorted(((r["deviation"], r["vec_id"], r["component"]), r["whitened"]) for r in found)
    order = sorted(range(len(ids)), key=lambda i: (deviation[i], ids[i]))
    assert [key for key, _ in table] == [(deviation[i], ids[i], c) for i in order for c in range(1, k + 1)]
    got = np.array([v for _, v in table]).reshape(-1, k)
    whitened = whitened[order]
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < tolerance
    assert max(r["identity_error"] for r in found) < 1e-4 and len({r["identity_error"] for r in found}) == 1
    for r in found:
        assert r["n"] == len(ids) and r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-4)


def test_query_equals_an_eigendecomposition(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(queries.whitened(spark, folder).collect(), brute(rows), 1e-8)


def test_nearly_dependent_columns(spark):
    """Columns whose Gram matrix no Cholesky factorisation without a shift would take."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 6)) * 2.0**30
    vectors = np.hstack([base, base[:, :2] + rng.integers(-3, 4, (400, 2))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = wh.whiten(frame).toPandas()
    assert found["identity_error"].max() < 1e-4 and found["whitened"].notna().all()
    w = found.sort_values(["vec_id", "component"])["whitened"].to_numpy().reshape(-1, 8)
    assert np.abs(w.T @ w / 400 - np.eye(8)).max() < 1e-4
    x = np.floor(64 * vectors)
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    explained = found[found["vec_id"] == 0].sort_values("component")["explained"].to_numpy()
    assert np.allclose(explained, values / values.sum(), rtol=1e-3)


def test_the_gram_matrix_alone_would_not_do():
    x = np.vander(np.linspace(0, 1, 300), 14)[:, :13]  # without the constant column
    x -= x.mean(axis=0)
    factors = []
    for step in range(wh.PASSES):
        q = wh.solved(x, factors)
        factors.append(wh.cholesky_upper(q.T @ q, 300, step == 0))
    q = wh.solved(x, factors)
    assert np.abs(q.T @ q - np.eye(13)).max() < 1e-13
    assert np.allclose(np.linalg.svd(factors[2] @ factors[1] @ factors[0], compute_uv=False), np.linalg.svd(x, compute_uv=False), rtol=1e-7)
    assert np.linalg.cond(x) > 1e8  # squared, beyond double precision


def test_triangular_solve():
    rng = np.random.default_rng(1)
    lower = np.tril(rng.normal(size=(70, 70))) + 8 * np.eye(70)
    right = rng.normal(size=(70, 5))
    assert np.allclose(lower @ wh.solve_lower(lower, right), right)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(50)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1])]
    odd = [(60, None), (61, [None] * 5), (62, [1.0, None, 0.0, 0.0, 0.0]), (63, [float("nan")] * 5), (64, [float("inf")] * 5), (65, [1e30] * 5), (66, [])]
    frame = spark.createDataFrame([(*r, 9) for r in rows + odd], SCHEMA)
    found = wh.whiten(frame).collect()
    assert len(found) == 5 * len(rows) and {r["n"] for r in found} == {len(rows)}
    known = {r["vec_id"]: r["deviation"] for r in found if r["vec_id"] not in (3, None)}
    ids, deviation, _, _ = brute(rows)
    assert known == {i: d for i, d in zip(ids, deviation) if i not in (3, None)}
    assert wh.whiten(frame.limit(0)).count() == 0


def test_lengths_apart_and_no_variance(spark):
    rows = [(i, [1.0, float(i), 2.0 * i]) for i in range(10)] + [(100, [5.0]), (200, [1.0, 2.0]), (201, [1.0, 2.0])]
    found = wh.whiten(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()
    three = [r for r in found if r["vec_id"] < 100]
    assert len(three) == 30 and {r["n"] for r in three} == {10}
    assert {r["component"] for r in three if r["whitened"] is None} == {2, 3}
    assert {r["n"] for r in found if r["vec_id"] >= 200} == {2}
    assert all(r["whitened"] is None and r["explained"] is None for r in found if r["vec_id"] >= 100)


def test_deviation_beyond_64_bits():
    x = np.array([[10**13, 0], [0, 0], [3, 4]])
    sums = x.sum(axis=0)
    found = wh.deviations(x, 3, sums)
    exact = [sum((3 * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    assert found == [e if e < 2**63 else None for e in exact]
