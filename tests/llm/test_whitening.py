"""Whitening against NumPy's eigenvectors, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.llm import queries, whitening


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def expected(embeddings, k=16):
    sound = {i: v for i, v in embeddings if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    x = {i: np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64) + 1_000_000 for i, v in sound.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def test_query_equals_dense_eigenvectors(spark, small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    x, n, sums, values, vectors, trace = expected(rows)
    found = queries.op13_whiten(spark, small)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = found.toPandas().sort_values(["vec_id", "component"])
    assert len(table) == len(x) * 16 and set(table["n"]) == {n}
    assert table["identity_error"].nunique() == 1 and table["identity_error"].max() < 1e-10
    ids = sorted(x)
    deviation = {i: int(sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i], sums))) for i in ids}
    assert dict(zip(table["vec_id"], table["deviation"])) == deviation
    assert np.allclose(table["explained"].to_numpy()[:16], values / trace, rtol=1e-10)
    got = table["whitened"].to_numpy().reshape(-1, 16)
    want = (np.array([x[i] for i in ids]) - sums / n) @ vectors / np.sqrt(values)
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, atol=1e-7)


@pytest.mark.parametrize("d, wanted, spread", [(200, 5, 0.999), (40, 16, 0.5), (7, 16, 0.1), (300, 8, 0.97)])
def test_jacobi_davidson_reaches_double_precision(d, wanted, spread):
    random = np.random.default_rng(d)
    basis = np.linalg.qr(random.standard_normal((d, d)))[0]
    values = 100 * spread ** np.arange(d)
    matrix = (basis * values) @ basis.T
    steps = []

    def product(block):
        steps.append(block.shape[1])
        return matrix @ block

    found, vectors = whitening.jacobi_davidson(product, d, wanted)
    assert np.allclose(found, values[:wanted], rtol=1e-12, atol=1e-11)
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13
    assert max(steps) <= max(wanted, 1)


def test_repeated_eigenvalues():
    random = np.random.default_rng(1)
    basis = np.linalg.qr(random.standard_normal((60, 60)))[0]
    values = np.r_[np.full(6, 9.0), np.full(30, 4.0), np.linspace(1, 0, 24)]
    matrix = (basis * values) @ basis.T
    found, vectors = whitening.jacobi_davidson(lambda b: matrix @ b, 60, 10)
    assert np.allclose(found, values[:10], atol=1e-11)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, x string, id int")


def test_odd_rows(spark):
    random = np.random.default_rng(3)
    good = [(i, [float(c) for c in random.standard_normal(4)], 1, "a", 2) for i in range(30)]
    odd = [(100, None, 1, "a", 2), (101, [1.0, None, 0.0, 0.0], 1, "a", 2), (102, [1.0, float("nan"), 0.0, 0.0], 1, "a", 2),
           (103, [float("inf"), 0.0, 0.0, 0.0], 1, "a", 2), (104, [], 1, "a", 2), (105, [1.0, 2.0], None, None, None),
           (None, good[0][1], 1, "a", 2), good[1]]
    table = vectors_of(spark, good + odd)
    vectors = whitening.quantised(table)
    model = whitening.fit(vectors)
    assert model.n == 30 and len(model.values) == 4
    found = collected(whitening.whiten(vectors, model))
    assert [r[0] for r in found].count(1) == 8 and [r[0] for r in found].count(None) == 4
    assert {r[0] for r in found} == {*range(30), None}
    by_id = {(r[0], r[1]): r[4] for r in found}
    assert all(by_id[None, c] == by_id[0, c] for c in range(1, 5))


def test_constant_dimensions_and_few_vectors(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], 0, "", 0) for i in range(10)]
    vectors = whitening.quantised(vectors_of(spark, rows))
    model = whitening.fit(vectors)
    assert len(model.values) == 1 and abs(model.values[0] / model.trace - 1) < 1e-12
    for few in (rows[:1], rows[:1] * 3, []):
        vectors = whitening.quantised(vectors_of(spark, few))
        found = whitening.whiten(vectors, whitening.fit(vectors))
        assert found.collect() == [] and found.columns[:2] == ["id", "component"]


def test_deviation_beyond_64_bits_is_refused():
    centre = whitening.Centre(3_000_000_000, np.array([3_000_000_000 * 5, 0]))
    assert centre.deviations(np.array([[5, 0]]))[0] == 0
    with pytest.raises(OverflowError):
        centre.deviations(np.array([[1 << 40, 0]]))


def test_covariance_is_not_collected(spark):
    """One hot vector counts once: copies meet before the products."""
    rows = [(i, [1.0, 2.0], 0, "", 0) for i in range(2000)] + [(i, [float(i % 7), float(i % 5)], 0, "", 0) for i in range(2000, 2100)]
    vectors = whitening.quantised(vectors_of(spark, rows))
    assert whitening.fit(vectors).n == vectors.select(F.col("x")).distinct().count()
