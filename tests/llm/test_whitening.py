"""Whitening against numpy on all rows, and rank-one updates against a full decomposition."""

import math

import numpy as np
import pytest

from trafficlens.llm import whitening


def expected(rows, components=32):
    """(rows that remain, x, n, sums, eigenvalues, vectors, trace) by one full decomposition."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    n, dim = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dim)]
    away = np.array([[(n * r[j] - sums[j]) / n for j in range(dim)] for r in x])
    values, vectors = np.linalg.eigh(away.T @ away / n)
    exact = [sum((n * r[j] - sums[j]) ** 2 for j in range(dim)) for r in x]
    return [i for i, _ in kept], exact, n, values[::-1][:components], away @ vectors[:, ::-1][:, :components], values.sum()


def check(frame, components=32):
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    ids, exact, n, values, projected, trace = expected(rows, components)
    got = whitening.whitened_components(frame, components).collect()
    by_component = {}
    for r in got:
        by_component.setdefault(r["component"], []).append(r)
    size = min(components, len(values))
    assert sorted(by_component) == list(range(1, size + 1))
    for k, found in by_component.items():
        assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in found) == sorted((i is None, i or 0, e) for i, e in zip(ids, exact))
        assert {r["n"] for r in found} == {n} and all(r["deviation_exact"] == r["deviation"] for r in found)
        assert all(math.isclose(r["explained"], values[k - 1] / trace, rel_tol=1e-9) for r in found)
        want = projected[:, k - 1] / math.sqrt(values[k - 1])
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, exact[i]))
        have = np.array([r["whitened"] for r in sorted(found, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]))])
        want = want[order]
        assert np.abs(have - want * np.sign(have @ want)).max() < 1e-7
    assert {r["identity_error"] < 1e-9 for r in got} == {True}
    assert len({r["identity_error"] for r in got}) == 1


def test_query_equals_a_full_decomposition(spark, folder):
    check(spark.read.parquet(f"{folder}/embeddings.parquet").repartition(11))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist(), "x") for i in range(40)]
    rows += [(3, None, "x"), (4, [1.0, None, 2.0, 3.0, 4.0], "x"), (5, [1.0, float("nan"), 2.0, 3.0, 4.0], "x"), (6, [float("inf")] * 5, "x"), (7, [], "x"),
             (None, [0.5, 0.25, -0.5, 1.0, 2.0], "x"), (8, [9.0, -9.0, 9.0, 9.0, 9.0], "x"), (8, [9.0, -9.0, 9.0, 9.0, 9.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n string").selectExpr("*", "'c' as whitened", "'c' as x", "'c' as component")
    check(frame)
    check(frame, 2)
    # another length than most
    more = frame.unionByName(frame.limit(1).selectExpr("vec_id", "array(1f, 2f) as embedding", "n", "whitened", "x", "component"))
    assert whitening.whitened_components(more).count() == 5 * 43


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance_there_are_no_components(spark, rows):
    found = whitening.whitened_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert found.collect() == [] and found.columns[:3] == ["vec_id", "component", "n"]


def test_fewer_vectors_than_dimensions(spark):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, rng.normal(size=12).tolist()) for i in range(4)], "vec_id bigint, embedding array<float>")
    found = whitening.whitened_components(frame).collect()
    assert {r["component"] for r in found} == {1, 2, 3} and max(r["identity_error"] for r in found) < 1e-9


@pytest.mark.parametrize("dim,n,step", [(1, 9, 1), (2, 30, 1), (6, 200, 1), (6, 200, 10), (20, 7, 1), (33, 150, 4)])
def test_rank_one_updates_and_merges(dim, n, step):
    rng = np.random.default_rng(dim)
    x = np.floor(rng.normal(size=(n, dim)) * 30 / step) * step
    x[:, dim // 2] = 5
    x[n // 2:n // 2 + 3] = x[0]
    parts = []
    for rows in np.array_split(x, 3):
        one = whitening.Spectrum(dim)
        for row in rows:
            one.add(row)
        parts.append(one)
    for other in parts[1:]:
        parts[0].merge(other)
    away = x - x.mean(0)
    found, scatter = parts[0], away.T @ away
    scale = max(np.abs(scatter).max(), 1)
    assert found.n == n and np.abs(found.mean - x.mean(0)).max() < 1e-11
    assert np.abs(found.vecs * found.vals @ found.vecs.T - scatter).max() / scale < 1e-11
    assert np.abs(found.vecs.T @ found.vecs - np.eye(dim)).max() < 1e-11
    assert np.abs(found.vals - np.linalg.eigvalsh(scatter)).max() / scale < 1e-11


def test_deviations_beyond_a_long():
    big = whitening.Whitening(4, (1 << 41, 0), np.zeros(2), np.eye(2), 0.0)
    x = np.array([[1 << 40, 0], [-(1 << 40), 7]])
    assert big.deviations(x) == [sum((4 * int(a) - s) ** 2 for a, s in zip(r, big.sums)) for r in x]
