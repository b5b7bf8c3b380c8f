import math

import numpy as np
import pytest

from tickloom.llm.queries import op12_whitening
from tickloom.llm.whitening import Moments, fit_whitening, whitened

SMALL = "/root/testdata/sf0.001"


def brute(rows, components=4):
    """{vec_id: [(n, deviation, whitened up to sign, explained)]} and the covariance of the whitened."""
    xs = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows]
    distinct = [list(t) for t in sorted({tuple(x) for _, x in xs})]
    n, dims = len(distinct), len(distinct[0])
    sums = [sum(x[d] for x in distinct) for d in range(dims)]
    centred = np.array([[(n * x[d] - sums[d]) / n for d in range(dims)] for x in distinct])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    out = {}
    for i, x in xs:
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        y = (np.array(x) - np.array(sums) / n) @ axes[:, order] / np.sqrt(values[order])
        out[i] = [(n, deviation, y[c], values[order[c]] / np.trace(covariance)) for c in range(len(order))]
    return out


def held(frame, expected):
    rows = frame.collect()
    assert len(rows) == sum(map(len, expected.values()))
    signs = {}
    for r in rows:
        n, deviation, y, explained = expected[r.vec_id][r.component - 1]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-6)
        if abs(y) > 1e-3:
            signs.setdefault(r.component, np.sign(y * r.whitened))
        assert r.whitened * signs.get(r.component, 1) == pytest.approx(y, rel=1e-6, abs=1e-6)
        assert r.identity_error <= 1e-4


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    held(op12_whitening(spark, SMALL), brute(rows))


def test_bad_vectors_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=6).round(2).tolist()) for i in range(200)]
    good += [(900 + i, good[0][1]) for i in range(300)] + [(7, good[7][1])]  # one vector of many rows, one row twice
    bad = [(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6), (1004, [float("-inf")] + [0.0] * 5), (1005, [1.0, 2.0]), (1006, [1e300] * 6)]
    frame = whitened(spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<double>, component string").repartition(5))
    expected = brute(good)
    assert frame.where("vec_id = 7").count() == 8
    held(frame.dropDuplicates(["vec_id", "component"]), expected)


def test_no_variance_and_no_vector(spark):
    flat = whitened(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 2.0]), (3, [0.5, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert len(flat) == 6
    second = [r for r in flat if r.component == 2]
    assert all(r.whitened is None and r.explained == 0 and r.n == 2 for r in second)
    assert all(abs(r.whitened) == 1 for r in flat if r.component == 1)
    one = whitened(spark.createDataFrame([(1, [0.5, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.component, r.deviation, r.whitened) for r in one] == [(1, 0, None), (2, 0, None)]
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitened(none).collect() == [] and "identity_error" in whitened(none).columns
    assert fit_whitening(spark.createDataFrame([], "x array<long>")) is None


def test_deviations_beyond_a_long_are_null_and_others_exact(spark):
    rows = [(1, [2.0**43, 0.0]), (2, [-(2.0**43), 1.0]), (3, [0.0, 3.0]), (4, [1.0, 0.0])]
    out = {r.vec_id: r.deviation for r in whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    assert out[1] is None and out[3] == sum((4 * v - s) ** 2 for v, s in zip([0, 768], [256, 1024]))


def test_merge_equals_the_whole_far_from_zero():
    x = np.random.default_rng(2).integers(-50, 50, (1000, 5)) + 10**9
    parts = [Moments.of(p) for p in np.array_split(x, [3, 400, 401, 900])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merged(p)
    assert whole.sums == x.sum(axis=0).tolist() and whole.n == 1000
    assert np.allclose(whole.scatter / 1000, np.cov(x.T, bias=True), rtol=1e-9)
