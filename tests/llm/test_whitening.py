"""Whitening against numpy's symmetric solver and exact integers."""

import math

import numpy as np
import pytest

from plaintide.llm import feast, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, whitened int, deviation double"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1, 2.5) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def expected(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    far = n * x - sums
    exact = np.array([[float(v) for v in row] for row in far]) / n
    values, axes = np.linalg.eigh(exact.T @ exact / n)
    return n, (far * far).sum(axis=1), exact, values[::-1], axes[:, ::-1]


def test_against_numpy(spark):
    random = np.random.default_rng(1)
    vectors = (random.standard_normal((400, 40)) * np.linspace(0.05, 3, 40)).astype(np.float32)
    vectors[:130] = vectors[0]
    got = whitening.whitened_components(table(spark, vectors)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, exact, values, axes = expected(vectors)
    assert len(got) == 400 * 32 and set(got.n) == {n}
    assert got[got.component == 1].deviation.tolist() == deviation.tolist()
    z = got.whitened.to_numpy().reshape(400, 32)
    want = exact @ axes[:, :32] / np.sqrt(values[:32])
    sign = np.sign((z * want).sum(axis=0))
    assert np.abs(z * sign - want).max() < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(400, 32)[0], values[:32] / values.sum(), rtol=1e-12)
    assert np.abs(z.T @ z / n - np.eye(32)).max() < 1e-9 and 0 <= got.identity_error.max() < 1e-9


def test_unusable_vectors_and_repeated_or_null_ids(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, -1.0, 2.0], [1.5, 0.25, 0.0], [0.0, 0.0, 0.0], [0.5, -1.0, 2.0], [3.0, 1.0, -2.0]]
    bad = [None, [], [1.0, None, 2.0], [nan, 0.0, 0.0], [inf, 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0]]
    got = whitening.whitened_vectors(table(spark, good + bad, [1, 1, None, 2, 3, *range(10, 17)])).toPandas()
    assert len(got) == 5 and set(got.n) == {5} and got.vec_id.isna().sum() == 1
    _, deviation, _, values, _ = expected(good)
    assert sorted(got.deviation) == sorted(deviation)
    assert {len(w) for w in got.whitened} == {3} and got.explained[0] == pytest.approx(values / values.sum())


def test_empty_tables_equal_vectors_and_ties(spark):
    assert whitening.whitened_components(table(spark, [])).count() == 0
    assert whitening.whitened_components(table(spark, [None, []])).count() == 0
    same = whitening.whitened_vectors(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert [(r.n, r.deviation, r.whitened) for r in same] == [(3, 0, [])] * 3
    assert whitening.whitened_components(table(spark, [[1.0, 2.0]])).count() == 0
    # Two equal eigenvalues: some orthonormal axes, still whitened.
    square = whitening.whitened_vectors(table(spark, [[1, 0], [-1, 0], [0, 1], [0, -1]])).toPandas()
    z = np.array(square.whitened.tolist())
    assert np.abs(z.T @ z / 4 - np.eye(2)).max() < 1e-12


def test_sums_are_exact_for_large_entries(spark):
    big = [[3e7, 1.0], [-3e7, 2.0], [1.0, -2.9e7]]
    for vectors in (big, [[c / 64 for c in v] for v in big]):
        got = {r.vec_id: r.deviation for r in whitening.whitened_vectors(table(spark, vectors)).collect()}
        assert got == {i: int(v) if v < 1 << 63 else None for i, v in enumerate(expected(vectors)[1])}
    y = np.array([[1 << 40, 3], [5, -(1 << 41)]])
    assert whitening.products(y).tolist() == [(1 << 80) + 25, 3 * (1 << 40) - 5 * (1 << 41), 9 + (1 << 82)]


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 2, 60), np.repeat([5.0, 1.0], 30), np.append(np.full(40, 3.0), np.zeros(20)),
    10.0 ** -np.arange(60), 1 + 1e-12 * np.arange(60), np.array([7.0]), np.zeros(4),
])
def test_every_eigenvalue_of_an_interval_is_found(spectrum):
    random = np.random.default_rng(2)
    axes = np.linalg.qr(random.standard_normal((len(spectrum), len(spectrum))))[0]
    matrix = (axes * spectrum) @ axes.T
    matrix = (matrix + matrix.T) / 2
    true = np.linalg.eigvalsh(matrix)[::-1]
    tri = feast.tridiagonal(matrix)
    for shift in (0.5, 1.5, 4.0):
        assert feast.count_above(tri, shift) == (true > shift).sum()
    found, norm = feast.intervals(matrix, 32)
    pairs = [feast.eigenpairs(matrix, *row, norm) for row in found]
    assert [len(v) for v, _ in pairs] == [inside for _, _, inside in found]
    if not pairs:
        assert not spectrum.any()
        return
    values, vectors = feast.polished(matrix, np.hstack([v for _, v in pairs]))
    k = min(32, int((true > 1e-12 * true[0]).sum()))
    assert np.abs(values[:k] - true[:k]).max() <= 1e-13 * true[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0)[:k].max() < 1e-12 * true[0]
