"""Whitening against numpy's eigenvectors and whole-number sums."""

import math
import random

import numpy as np
import pytest

from merchantscope.llm import whitening
from merchantscope.llm.queries import queries


def brute(rows, k=4):
    """(id, exact deviation, x) of rows that take part; n, eigenvalues, vectors and trace of the fit list."""
    fine = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({v for _, v in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    deviations = [(i, sum((n * a - s) ** 2 for a, s in zip(v, sums)), np.array(v) - np.array([s / n for s in sums])) for i, v in fine]
    return n, deviations, values[order], vectors[:, order].T, values.sum()


def check(got, rows):
    n, deviations, values, vectors, trace = brute(rows)
    signs, want = {}, {}
    for i, deviation, y in deviations:
        want.setdefault((i, deviation), []).append(y)
    assert len(got) == sum(len(x) for x in want.values()) * len(values)
    for r in got:
        c = r.component - 1
        expected = [float(y @ vectors[c] / math.sqrt(values[c])) for y in want[(r.vec_id, r.deviation)]]
        if c not in signs and abs(expected[0]) > 1e-3:
            signs[c] = math.copysign(1, expected[0] * r.whitened)
        assert any(abs(signs.get(c, 1) * r.whitened - e) < 1e-8 * max(1, abs(e)) for e in expected)
        assert r.n == n and abs(r.explained - values[c] / trace) < 1e-10 and r.identity_error < 1e-9


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, id string, v string")


def test_random_and_odd(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.3 * j, 0.1 * (j + 1)) for j in range(9)]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(150)]  # one vector that a third of the rows share
    rows += [(None, rows[7][1]), (8, rows[8][1]), (8, rows[9][1]), (500, None), (501, []), (502, [float("nan")] * 9), (503, [None] + [0.1] * 8), (504, [float("-inf")] * 9)]
    got = whitening.whitened_rows(vectors_of(spark, [*rows, (505, [0.1, 0.2])])).collect()
    check(got, rows)


@pytest.mark.parametrize("scale", [1e7, 1e14])
def test_large_numbers_stay_exact(spark, scale):
    rng = random.Random(6)
    rows = [(i, [scale * (1 + rng.random()) for _ in range(5)]) for i in range(60)]
    vectors = whitening.floor_vectors(vectors_of(spark, rows), "embedding", 256, "vec_id")
    model = whitening.fit_whitening(vectors.select("v").distinct())
    n, deviations, values, _, trace = brute(rows, 5)
    assert model.n == n and abs(model.trace / trace - 1) < 1e-12 and np.allclose(model.values, values, rtol=1e-10)
    got = {r.id: r.deviation for r in whitening.whiten(vectors, model, 4).collect()}
    assert got == {i: (d if d < 1 << 63 else None) for i, d, _ in deviations}


def test_rank_limits_the_components(spark):
    line = [(i, [0.5 * i, 1.0 * i, -2.0 * i, 0.0, 0.0]) for i in range(20)]
    got = whitening.whitened_rows(vectors_of(spark, line)).collect()
    assert len(got) == 20 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    assert whitening.whitened_rows(vectors_of(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0
    assert whitening.whitened_rows(vectors_of(spark, [])).count() == 0


def test_factor_and_rotation_by_themselves():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 12)) * np.logspace(0, -6, 12)
    v = a.T @ a
    factor = whitening.pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v, rtol=0, atol=1e-14 * v.max())
    values, vectors = whitening.jacobi_columns(factor)
    assert np.allclose(vectors @ vectors.T, np.eye(12), atol=1e-10)
    assert np.allclose(values[:6], np.linalg.eigvalsh(v)[::-1][:6], rtol=1e-8)


def test_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(queries()["op13_jacobi_whitening"](spark, folder).collect(), rows)
