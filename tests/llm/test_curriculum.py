import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm.curriculum import SHAPES, curriculum, position_at, training_order
from tickloom.llm.queries import op2_curriculum_mix

SF = "/root/testdata/sf0.01"


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Resharing in rounds, as stated."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, list(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def check(docs, got):
    sizes = Counter()
    for r in docs:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    expected, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)


def test_targets_and_taken_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    got = curriculum(docs).collect()
    check(docs.collect(), got)
    rows = op2_curriculum_mix(spark, SF).collect()
    when = [r.first_position for r in rows if r.first_position is not None]
    assert when == sorted(when) and all(r.first_position is None for r in rows[len(when) :])
    again = {r.doc_id: r for r in rows}
    assert len(again) == len(source) == len(got)
    assert all(again[r.doc_id].taken == r.taken for r in op2_curriculum_mix(spark, SF).collect())


def test_bad_rows_and_clashing_names(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 2), (3, "x y", None, 3), (3, "x y", None, 3), (None, "w " * 50_000, "b", 4), (5, "q", "c", 5), (6, "z z", "d", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").withColumn("bucket", F.lit("k"))
    got = curriculum(docs)
    assert got.count() == len(rows)
    out = got.collect()
    check(docs.collect(), out)
    assert all(r.bucket == "k" for r in out)
    assert curriculum(docs.limit(0)).count() == 0


def test_positions_invert_the_schedule(spark):
    def demand(knots, x):
        area = 0.0
        for (a, u), (b, v) in zip(knots, knots[1:]):
            if x > a:
                t = min(x, b)
                area += (t - a) * (u + (u + (v - u) * (t - a) / (b - a))) / 2
        return area

    shares = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    for k, knots in enumerate(SHAPES):
        rows = spark.createDataFrame([(s,) for s in shares], "s double").select("s", position_at(F.col("s"), F.lit(k)).alias("x")).collect()
        assert all(demand(knots, r.x) / demand(knots, 1.0) == pytest.approx(r.s, abs=1e-9) for r in rows)


def test_training_order(spark):
    ordered = training_order(curriculum(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")))
    parts = ordered.select(F.spark_partition_id().alias("p"), "position", "words").collect()
    assert [r.position for r in parts] == sorted(r.position for r in parts)
