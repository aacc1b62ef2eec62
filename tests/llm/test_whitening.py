import math

import numpy as np
import pytest
from pyspark.sql import types as T

from regionpanel.llm import whitening as M

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("n", T.StringType()), T.StructField("component", T.StringType())])


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in vectors], SCHEMA)


def expected(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[c - s / n for c, s in zip(row, sums)] for row in x])
    cov = centred.T @ centred / n
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return n, centred, cov, deviation


def check(spark, vectors, k=32):
    rows = M.whiten(table(spark, list(enumerate(vectors))), k).collect()
    n, centred, cov, deviation = expected(vectors)
    values = np.linalg.eigvalsh(cov)[::-1][:min(k, len(cov))]
    assert len(rows) == n * len(values)
    white = np.zeros((n, len(values)))
    for r in rows:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.identity_error <= 1e-4
        if r.whitened is None:
            assert values[r.component - 1] < 1e-9 * max(values[0], 1)
        else:
            white[r.vec_id, r.component - 1] = r.whitened
            assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-6
    solid = values > 1e-6 * max(values[0], 1e-9)
    got = white[:, solid]
    assert np.abs(got.T @ got / n - np.eye(solid.sum())).max(initial=0) < 1e-8
    # each column is the projection on an eigenvector: C w = e w in terms of the vectors
    for j in np.flatnonzero(solid):
        axis = centred.T @ white[:, j] / n / np.sqrt(values[j])
        assert np.abs(cov @ axis - values[j] * axis).max() < 1e-7 * values[0]


def test_random_vectors(spark):
    rng = np.random.default_rng(0)
    check(spark, rng.normal(0, 0.3, (300, 40)).tolist())


def test_equal_eigenvalues_and_few_dimensions(spark):
    square = [[a, b, c] for a in (0.0, 1.0) for b in (0.0, 1.0) for c in (0.0, 1.0)]
    check(spark, square)
    check(spark, [[0.5], [0.25], [0.5]])


def test_repeated_rows_and_rank_below_the_dimensions(spark):
    rng = np.random.default_rng(2)
    few = rng.normal(size=(4, 9))
    check(spark, np.repeat(few, 30, 0).tolist())
    check(spark, [[0.1, 0.2]] * 5)


def test_malformed_rows_go(spark):
    good = [[0.1, 0.2], [0.3, -0.4], [0.5, 0.9]]
    bad = [None, [], [0.1, None], [float("nan"), 0.0], [float("inf"), 0.0], [0.1], [0.1, 0.2, 0.3]]
    rows = [(i, v) for i, v in enumerate(good + bad)] + [(None, good[0]), (0, good[0])]
    got = M.whiten(table(spark, rows)).collect()
    assert sorted({(r.vec_id is None, r.vec_id) for r in got}, key=repr) == [(False, 0), (False, 1), (False, 2), (True, None)]
    assert {r.n for r in got} == {5} and len(got) == 10
    assert M.whiten(table(spark, [])).collect() == [] and M.whiten(table(spark, [(1, None)])).collect() == []


def test_huge_entries_do_not_overflow(spark):
    rows = M.whiten(table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])])).collect()
    assert len(rows) == 6 and all(r.n == 3 for r in rows)


@pytest.mark.parametrize("n,rank", [(1, 1), (2, 2), (30, 30), (30, 7), (64, 64)])
def test_eigenvectors(n, rank):
    rng = np.random.default_rng(n + rank)
    x = rng.normal(size=(n, rank)) * rng.integers(1, 4, rank)
    matrix = x @ x.T
    values, vectors = M.leading_components(matrix, n)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1]).max() < 1e-11 * values[0]
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-11 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-11


def test_layout_does_not_matter(spark):
    rng = np.random.default_rng(3)
    df = table(spark, list(enumerate(rng.normal(size=(200, 12)).tolist())))
    one, many = ({(r.vec_id, r.component): r.whitened for r in M.whiten(df.repartition(p)).collect()} for p in (1, 9))
    flip = {c: np.sign(one[0, c] * many[0, c]) for c in range(1, 13)}
    assert max(abs(one[k] - flip[k[1]] * many[k]) for k in one) < 1e-9
