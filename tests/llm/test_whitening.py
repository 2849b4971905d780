"""Whitening against numpy, eigenpairs of hard matrices, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import whitening as w
from gleanery.llm.queries import op13_whitening


def plain(rows, k=4):
    """{key: (n, deviation, whitened...)}, explained, of the usable rows, by numpy and unbounded integers."""
    x = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in rows}
    fit = np.array(sorted({tuple(v.tolist()) for v in x.values()}))
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {i: (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)), (v - s / n) @ vectors / np.sqrt(values)) for i, v in x.items()}
    return out, values / np.trace(y.T @ y / n)


def compare(got, rows, k=4):
    told, explained = plain(rows, k)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert set(by) == set(told)
    signs = None
    for i, (n, deviation, white) in sorted(told.items()):
        mine = sorted(by[i], key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, len(white) + 1))
        assert all(int(r["deviation"]) == deviation and r["n"] == n for r in mine)
        ours = np.array([r["whitened"] for r in mine])
        signs = np.where(ours * white < 0, -1, 1) if signs is None else signs
        assert np.allclose(ours, signs * white, atol=1e-8)
        assert np.allclose([r["explained"] for r in mine], explained, rtol=1e-10)
        assert all(0 <= r["identity_error"] < 1e-10 for r in mine)


def test_query_against_numpy(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(op13_whitening(spark, sf).collect(), rows)


@pytest.mark.parametrize("matrix", [
    np.diag([5.0, 5.0, 5.0, 5.0, 1.0]), np.diag([3.0, 2.0, 1.0]), np.ones((6, 6)), np.zeros((4, 4)), np.array([[2.0]]), np.array([[2.0, 1.0], [1.0, 2.0]]),
    np.diag([1e-200, 3e-200, 2e-200]), np.diag([1e150, 3e150, 2e150, 1e150]), np.kron(np.eye(4), np.array([[2.0, 1.0], [1.0, 2.0]])),
    np.diag(np.arange(21.0) - 10) ** 2 / 10 + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1), (lambda a: a @ a.T)(np.random.default_rng(1).standard_normal((40, 40))),
    np.eye(30) + 1e-9 * (lambda a: a + a.T)(np.random.default_rng(2).standard_normal((30, 30))), (lambda a: a @ a.T)(np.random.default_rng(3).standard_normal((50, 3))),
])
def test_leading_eigenpairs(matrix):
    values, vectors = w.leading(matrix, 4)
    k = min(4, len(matrix))
    norm = max(np.abs(matrix).max(), 1e-300) * len(matrix)
    assert np.allclose(values / norm, np.linalg.eigvalsh(matrix)[::-1][:k] / norm, atol=1e-14)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
    assert np.allclose(matrix / norm @ vectors, vectors * (values / norm), atol=1e-13)


def test_sturm_counts():
    a = np.random.default_rng(5).standard_normal((12, 12))
    d, e, _ = w.tridiagonal(a + a.T)
    values = np.linalg.eigvalsh(a + a.T)
    for x in (*np.linspace(-10, 10, 41), *(values + 1e-9), *(values - 1e-9)):
        assert w.count_below(d.tolist(), (e * e).tolist(), float(x), 1e-300) == int((values < x).sum())


def test_odd_vectors(spark):
    r = np.random.default_rng(7)
    good = [(i, [float(v) for v in r.standard_normal(6) * [9, 5, 3, 2, 1, 1] + 40]) for i in range(60)]
    # Copies, and copies but for less than a 256th, are one vector of the fit; -0.0 is 0.
    good += [(100 + i, [float(v) for v in good[0][1]]) for i in range(30)] + [(200, [0.0] * 6), (201, [-0.0] * 6), (202, [0.001] * 6)]
    bad = [(300, None), (301, []), (302, [None] * 6), (303, [1.0, 2.0, float("nan"), 0.0, 0.0, 0.0]), (304, [float("inf")] + [0.0] * 5), (305, [1.0] * 5), (306, [1.0] * 7), (307, [float("-inf")] * 6)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("x", F.lit("a")).withColumn("_key", F.lit(1)).withColumn("n", F.lit(2)).withColumn("_v", F.lit(3))
    for parts in (1, 6):
        compare(w.whiten(df.repartition(parts)).collect(), good)
    again = w.whiten(df.filter("vec_id < 60").unionByName(df.filter("vec_id < 60")).withColumn("vec_id", F.lit(None).cast("long")))
    assert again.count() == 60 * 2 * 4 and again.filter("vec_id IS NOT NULL").count() == 0


def test_few_dimensions_no_variance_and_no_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(0, [0.5, 1.0]), (1, [0.25, -1.0]), (2, [3.0, 4.0])]
    compare(w.whiten(frame(rows)).collect(), rows, 2)
    line = w.whiten(frame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)
    assert w.whiten(frame([(0, [1.0, 2.0]), (1, [1.0, 2.0])])).count() == 0
    assert w.whiten(frame([])).count() == 0 and w.whiten(frame([(0, None)])).columns[:2] == ["vec_id", "component"]


def test_deviation_is_exact():
    model = w.Whitening(10 ** 9, np.array([123456789, -5, 7]), np.empty(0), np.empty((3, 0)), 0.0)
    x = np.array([[300000, -2, 0], [-299999, 1, 5]])
    assert [int(v) for v in model.deviation(x)] == [sum((10 ** 9 * int(a) - int(b)) ** 2 for a, b in zip(row, model.sums, strict=True)) for row in x]


def test_numbers_beyond_the_bounds_are_refused(spark):
    with pytest.raises(ValueError):
        w.whiten(spark.createDataFrame([(0, [1e30, 1.0])], "vec_id long, embedding array<double>"))
