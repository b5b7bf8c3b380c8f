import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm.embeddings import near_duplicates, partners


def brute(rows, threshold=0.95):
    ok = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = list(ok)
    x = np.array([ok[i] for i in ids])
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    label = list(range(len(ids)))
    changed = True
    while changed:
        new = [min([label[i], *[label[j] for j in np.flatnonzero(link[i])]]) for i in range(len(ids))]
        changed, label = new != label, new
    first = {}
    for i, c in zip(ids, label, strict=True):
        first[c] = min(first.get(c, i), i)
    return {i: (int(link[k].sum()), first[label[k]]) for k, i in enumerate(ids)} | {i: (0, i) for i, _ in rows if i not in ok}


def planted(n=600, d=32, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    for k in range(150):
        v = base[k % 40] + rng.standard_normal(d) * rng.choice([0.0, 0.1, 0.2, 0.3])
        rows.append((n + k, [float(x) for x in v]))
    return rows


def test_equals_brute_force_with_bad_vectors_and_clashing_names(spark):
    rows = planted()
    rows += [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, [None] * 32), (1004, [float("inf")] * 32), (1005, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    exact = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    for tile in (1024, 16):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(vectors, tile=tile).collect()}
        assert set(got) == set(exact)
        links = sum(n for n, _ in exact.values())
        assert sum(n for n, _ in got.values()) >= 0.97 * links
        assert all(got[i][0] <= exact[i][0] for i in got)
        assert np.mean([got[i][1] == exact[i][1] for i in got]) > 0.98
    assert near_duplicates(vectors.limit(0)).count() == 0


def test_copies_are_counted_and_rows_stay(spark):
    rows = [(i % 7, [1.0, 2.0, 3.0, float(i // 10)]) for i in range(20)] + [(99, [5.0, 5.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 21
    assert {r.n_links for r in got if r.vec_id != 99} == {19}
    assert {r.component_id for r in got if r.vec_id != 99} == {0}
    assert [r.kept for r in got if r.vec_id == 99] == [True]


@pytest.mark.parametrize(("n", "common"), [(300, 0.0), (6000, 0.0), (6000, 2.0)])
def test_recall_just_above_the_threshold(spark, n, common):
    """Pairs at a cosine of 0.951, among vectors with and without a strong common mean."""
    rng = np.random.default_rng(n)
    base = rng.standard_normal((n, 48)) + common
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    near = partners(unit[: n // 4], 0.951, seed=9)
    rows = list(enumerate(np.vstack([unit, near]).tolist()))
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    exact = brute(rows)
    links = sum(k for k, _ in exact.values())
    assert links >= n // 2 and sum(k for k, _ in got.values()) >= 0.97 * links
    assert all(got[i][0] <= exact[i][0] for i in got)


def test_driver_holds_no_sample_of_wide_vectors(spark):
    wide = spark.range(1500).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda k: F.sin(F.col("id") * 31 + k * k).cast("float")).alias("embedding"))
    tracemalloc.start()
    try:
        got = near_duplicates(wide).count()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == 1500 and most < 1500 * 1024 * 8


def test_tables_in_turns_find_what_all_at_once_do(spark):
    rows = planted(seed=4)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    all_at_once, in_turns, tiled = (
        {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(vectors, at_once=n, tile=tile).collect()} for n, tile in ((400, 1024), (2, 1024), (2, 16))
    )
    assert all_at_once == in_turns == tiled
    assert sum(n for n, _ in in_turns.values()) >= 0.97 * sum(n for n, _ in brute(rows).values())
