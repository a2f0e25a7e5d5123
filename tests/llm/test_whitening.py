"""Whitening against numpy's eigenvectors and exact integers; spectrum slicing on hard matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm.spectrum import leading_eigenpairs, positive_inertia
from orderlens.llm.whitening import fit_whitening, op11_whitening, whiten, whitened_rows

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, k=8):
    """``{(place, component): (n, deviation, whitened, explained)}`` with exact integers and numpy's eigenvectors."""
    kept = [(i, v) for i, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = (n * x - sums).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for c in range(min(k, len(values))):
        e, axis = values[-1 - c], axes[:, -1 - c]
        for (i, _), d, y in zip(kept, deviation, centred, strict=True):
            out[i, c + 1] = (n, int(d), float(y @ axis / np.sqrt(e)), float(e / values.sum()))
    return out


def compare(rows, expected):
    found = {(r["vec_id"], r["component"]): r for r in rows}
    assert set(found) == set(expected) and len(rows) == len(expected)
    for c in {c for _, c in expected}:
        signs = {np.sign(found[key]["whitened"] * expected[key][2]) for key in expected if key[1] == c and abs(expected[key][2]) > 1e-3}
        assert len(signs) == 1
    for key, (n, deviation, whitened, explained) in expected.items():
        row = found[key]
        assert (row["n"], row["deviation"]) == (n, deviation)
        assert abs(row["whitened"]) == pytest.approx(abs(whitened), abs=1e-8)
        assert row["explained"] == pytest.approx(explained, rel=1e-9)
        assert row["identity_error"] < 1e-9


def sample(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ np.diag(1.3 ** -np.arange(d)) @ rng.standard_normal((d, d))).astype(np.float32).tolist()


def test_same_as_numpy_with_unusable_rows(spark):
    vectors = sample(400, 12)
    vectors += vectors[:40] + [None, [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11]
    frame = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).withColumn("n", F.lit("x")).withColumn("whitened", F.lit(1))
    compare(whitened_rows(frame.repartition(5)).collect(), brute(vectors))


def test_same_as_numpy_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in table] == list(range(len(table)))
    compare(op11_whitening(spark, "/root/testdata/sf0.01").collect(), brute([r["embedding"] for r in table]))


def test_fewer_dimensions_and_ids_of_any_kind(spark):
    vectors = sample(50, 3, 2)
    rows = [(None if i % 10 == 0 else 7, v) for i, v in enumerate(vectors)]
    found = whitened_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 150 and sum(r["vec_id"] is None for r in found) == 15


def test_no_components(spark):
    empty = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for vectors in ([], [None], [[]], [[1.0, 2.0]] * 5, [[float("nan")]]):
        found = whitened_rows(spark.createDataFrame(list(enumerate(vectors)), SCHEMA))
        assert found.columns == empty and found.collect() == []


def test_other_widths_are_left_out(spark):
    vectors = sample(40, 4, 3)
    frame = spark.createDataFrame([*enumerate(vectors), (100, [1.0]), (101, [1.0] * 9), (102, [])], SCHEMA)
    compare(whitened_rows(frame).collect(), brute(vectors))


def test_long_vectors_and_large_entries(spark):
    wide = sample(30, 200, 4)
    compare(whitened_rows(spark.createDataFrame(list(enumerate(wide)), SCHEMA)).collect(), brute(wide))
    large = [[1e12, 0.0], [-1e12, 1.0], [0.0, 2.0], [1e15, 3.0], [1e30, 3.0]]
    fit = fit_whitening(spark.createDataFrame(list(enumerate(large)), SCHEMA))
    found = whiten(spark.createDataFrame(list(enumerate(large)), SCHEMA), fit, ["vec_id"]).collect()
    # The entry of 1e30 fits no whole number; squares of the others exceed a long.
    assert fit.n == 4 and [r["vec_id"] for r in found] == [0, 1, 2, 3] and all(r["deviation"] is None for r in found)
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for v in large[:4]]
    assert fit.sums == [sum(column) for column in zip(*x, strict=True)]


def spectra():
    rng = np.random.default_rng(7)
    yield "random", np.abs(rng.standard_normal(40))
    yield "pairs", np.repeat(np.arange(1.0, 21.0), 2)
    yield "one equal group", np.r_[5.0, [1.0] * 30]
    yield "close", 1 + np.arange(30) * 1e-9
    yield "closer", np.r_[1 + np.arange(6) * 1e-14, np.full(10, 0.1)]
    yield "low rank", np.r_[3.0, 2.0, np.zeros(30)]
    yield "wide range", 10.0 ** -np.arange(12.0)
    yield "single", np.array([2.5])


@pytest.mark.parametrize(("name", "values"), list(spectra()), ids=[n for n, _ in spectra()])
def test_spectrum_slicing(name, values):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    matrix = (q * values) @ q.T
    pairs = leading_eigenpairs(matrix, 8)
    expected = [v for v in sorted(values, reverse=True)[:8] if v > 1e-12 * values.sum()]
    assert len(pairs) == len(expected)
    vectors = np.array([p.vector for p in pairs])
    np.testing.assert_allclose([p.value for p in pairs], expected, rtol=0, atol=1e-13 * values.sum())
    np.testing.assert_allclose(vectors @ vectors.T, np.eye(len(pairs)), atol=1e-6 if name == "close" else 1e-9)
    for p in pairs:
        assert p.below <= p.value <= p.above
        assert np.linalg.norm(matrix @ p.vector - p.value * p.vector) < 1e-13 * values.sum()


def test_inertia_of_indefinite_matrices():
    rng = np.random.default_rng(5)
    for size in (1, 2, 5, 30):
        for _ in range(20):
            m = rng.standard_normal((size, size))
            m = m + m.T
            assert positive_inertia(m) == int((np.linalg.eigvalsh(m) > 0).sum())
    assert positive_inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert positive_inertia(np.zeros((3, 3))) == 0
