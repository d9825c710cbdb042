"""Whitening against a dense eigensolver and exact integers."""

import math

import numpy as np
import pytest

from tagmill.llm import queries, whitening

VECTORS = "vec_id long, embedding array<double>, n string, x int"


def solved(matrix, want=8):
    calls = []

    def product(q):
        calls.append(q.shape)
        return matrix @ q
    values, axes = whitening.jacobi_davidson(product, len(matrix), want)
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-13)
    return values, axes, calls


@pytest.mark.parametrize("spectrum", [1 / np.arange(1.0, 201), np.r_[[1e6, 1e3, 10.0], np.full(60, 1.0)], np.r_[[5.0] * 12, [1.0] * 100],
                                      np.linspace(1, 3, 64), np.array([2.0]), np.r_[3.0, 1.0, np.zeros(40)]])
def test_components_reach_double_precision(spectrum):
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    matrix = turn @ np.diag(spectrum) @ turn.T
    values, axes, calls = solved((matrix + matrix.T) / 2)
    expected = np.sort(spectrum)[::-1][:8]
    expected = expected[expected > 0]
    assert np.abs(values - expected).max() <= 1e-13 * expected[0]
    assert np.abs(matrix @ axes - axes * values).max() <= 1e-13 * expected[0]
    assert len(calls) < 150


def test_minres_solves_an_indefinite_system():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal(12)
    solver = whitening._minres(b, 60, 1e-13)
    v = next(solver)
    try:
        while True:
            v = solver.send(a @ v)
    except StopIteration as end:
        assert np.abs(a @ end.value - b).max() < 1e-8


def checked(rows, got, want=8):
    """Compares rows with numpy's eigenpairs and Python's integers."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in usable])
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:want], axes[:, ::-1][:, :want]
    white = y @ axes / np.sqrt(values)
    by_row = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by_row) == n * len(values)
    for k in range(len(values)):
        own = np.array([by_row[i, k + 1]["whitened"] for i, _ in usable])
        assert np.abs(own * np.sign(own @ white[:, k]) - white[:, k]).max() < 1e-8
    for (i, _), row in zip(usable, (n * x - sums).tolist()):
        r = by_row[i, 1]
        assert (r["n"], r["deviation"]) == (n, sum(d * d for d in row))
        assert abs(r["explained"] - values[0] / np.trace(y.T @ y / n)) < 1e-12 and r["identity_error"] < 1e-10
    return n


def test_the_query_against_a_dense_solver(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert checked(rows, queries.QUERIES["op13_whitening"](spark, folder).collect()) > 100


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(50)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("-inf"), 0.0, 0.0]), (105, [0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, None, 1) for i, v in rows + odd], VECTORS).repartition(7)
    assert checked(rows + odd, whitening.whiten(table).collect()) == 51
    repeated = whitening.whiten(table.where("vec_id < 50").withColumn("vec_id", table["vec_id"] * 0).union(table.where("vec_id < 3")))
    assert repeated.where("vec_id = 0 and component = 1").count() == 51


def test_nothing_to_whiten_gives_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame([(i, v, None, 1) for i, v in rows], VECTORS)).collect() == []


def test_lengths_are_fitted_apart_and_large_numbers_stay_exact(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 5.0]), (3, [3e11, 1.0]), (4, [1.0]), (5, [2.0]), (6, [4.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, None, 1) for i, v in rows], VECTORS)).collect()
    assert {(r["vec_id"], r["component"]) for r in got if r["vec_id"] > 3} == {(4, 1), (5, 1), (6, 1)}
    assert all(r["deviation"] is None for r in got if r["vec_id"] < 3) and all(r["n"] == 3 for r in got)
    x = [math.floor(1024 * v[0]) + 100_000 for _, v in rows[3:]]
    assert [r["deviation"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["vec_id"] > 3] == [(3 * a - sum(x)) ** 2 for a in x]
