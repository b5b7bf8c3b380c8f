"""Running, rolling and ranked values against plain loops, and the plans behind them."""

import datetime
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scans, series, stats
from tickloom.operators import quality

DAY0 = datetime.date(2000, 1, 1)


def day(n):
    return DAY0 + datetime.timedelta(days=n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def alone(df):
    """Windows and aggregates without keys: exchanges to a single partition that rows of a window come by."""
    return re.findall(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan(df))


def long_series(seed, n, keys=("k",)):
    rng = random.Random(seed)
    return [(k, day(i), rng.choice([None, *[rng.uniform(-2, 5)] * 5]), rng.randrange(100)) for k in keys for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_scan_equals_a_loop(spark, ranges):
    data = long_series(1, 300)
    df = spark.createDataFrame(data, "k string, date date, x double, n int").repartition(6)
    kinds = {"s": ("sum", "n"), "c": ("count", "x"), "p": ("product", "x"), "hi": ("max", "x"), "lo": ("min", "x"), "l": ("last", "x"), "f": ("first", "x"), "g": ("lag", "x")}
    got = scans.scan(df, "date", {name: (kind, F.col(c)) for name, (kind, c) in kinds.items()}, ranges=ranges)
    assert not alone(got)
    assert "_range" not in got.columns
    seen, total, last = [], 0, None
    for row, (_, when, x, n) in zip(got.orderBy("date").collect(), data, strict=True):
        total += n
        seen += [] if x is None else [x]
        prod = 1.0
        for v in seen:
            prod *= v
        assert (row.date, row.s, row.c, row.g) == (when, total, len(seen), last)
        assert (row.hi, row.lo, row.l, row.f) == ((max(seen), min(seen), seen[-1], seen[0]) if seen else (None,) * 4)
        assert row.p == (pytest.approx(prod, rel=1e-12) if seen else None)
        last = x


def test_scan_by_keys_of_unequal_length_and_decimals(spark):
    data = [(k, i, i % 7) for k, n in (("long", 500), ("short", 3), (None, 4)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, i long, v int").withColumn("v", F.col("v").cast("decimal(10,2)"))
    got = scans.scan(df, "i", {"v": ("sum", F.col("v")), "was": ("lag", F.col("v"))}, keys=["k"], ranges=5)
    assert got.columns == ["k", "i", "v", "was"]
    for r in got.collect():
        assert r.v == sum(j % 7 for j in range(r.i + 1)) and (r.was is None) == (r.i == 0)


def test_ranges_are_of_numbers_and_times(spark):
    df = spark.createDataFrame([("a", 1)], "name string, n int")
    with pytest.raises(TypeError, match="name is string"):
        scans.scan(df, "name", {"s": ("sum", F.col("n"))})
    with pytest.raises(TypeError, match="name is string"):
        scans.average_ranks(df, "name")


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "date date, x double")
    assert scans.scan(df, "date", {"s": ("sum", F.col("x")), "g": ("lag", F.col("x"))}).collect() == []
    one = spark.createDataFrame([(day(0), None)], "date date, x double")
    assert scans.scan(one, "date", {"s": ("sum", F.col("x")), "g": ("lag", F.col("x"))}).first()[:] == (day(0), None, None, None)


@pytest.mark.parametrize(("n", "shift"), [(1, 0), (1, 2), (5, 0), (5, 1), (40, 3), (300, 0)])
def test_rolling_equals_sliding_frames(spark, n, shift):
    df = spark.createDataFrame(long_series(n, 120, ("a", "b")), "ticker string, date date, x double, n int").repartition(4)
    w, kinds = series.by_date(), {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}
    for column in ("x", "n"):
        fast = scans.with_rolling(df, {k: (k, F.col(column)) for k in kinds}, n, shift)
        slow = df.withColumns({k: series.rolling(f, F.col(column), w, n, shift) for k, f in kinds.items()})
        for a, b in zip(fast.orderBy("ticker", "date").collect(), slow.orderBy("ticker", "date").collect(), strict=True):
            assert a.asDict() == {k: v if v is None or isinstance(v, str | datetime.date) else pytest.approx(v, rel=1e-12, abs=1e-12) for k, v in b.asDict().items()}


def test_rolling_beta_equals_sliding_frames(spark):
    rng = random.Random(4)
    rows = [(t, day(i), None if rng.random() < 0.02 else rng.gauss(0, 1), 3.0 if t == "flat" else 0.1 if t == "part" and 30 < i < 60 else rng.gauss(1e4, 1)) for t in ("a", "flat", "part") for i in range(150)]
    df = spark.createDataFrame(rows, "ticker string, date date, s double, m double").repartition(4)
    for n in (2, 12, 60):
        fast = scans.with_rolling_beta(df, "s", "m", n).orderBy("ticker", "date").collect()
        slow = df.withColumn("beta", series.rolling_beta(F.col("s"), F.col("m"), series.by_date(), n)).orderBy("ticker", "date").collect()
        for a, b in zip(fast, slow, strict=True):
            assert a.beta == (None if b.beta is None else pytest.approx(b.beta, rel=1e-6)), (n, a)
        assert all(r.beta is None for r in fast if r.ticker == "flat")


def test_long_windows_cost_as_much_as_short_ones(spark):
    """Frames that windows look at: every one runs from the start of its block, none slides over n rows."""
    df = spark.range(100).select(F.lit("a").alias("ticker"), F.col("id").alias("date"), F.col("id").cast("double").alias("x"))
    for n in (10, 10_000):
        text = plan(scans.with_rolling(df, {"m": ("max", F.col("x")), "s": ("avg", F.col("x"))}, n))
        frames = set(re.findall(r"specifiedwindowframe\(RowFrame, ([^)]*)\)", text))
        lags = {f"-{n - 1}, -{n - 1}", f"{1 - n}, {1 - n}", "0, 0"}
        assert frames and all(f.startswith("unboundedpreceding") or f in lags for f in frames), frames


def test_next_known_is_bfill(spark):
    df = spark.createDataFrame(long_series(9, 60, ("a", "b")), "ticker string, date date, x double, n int")
    both = df.select(series.next_known(F.col("x")).alias("a"), series.bfill(F.col("x"), series.by_date()).alias("b")).collect()
    assert all(r.a == r.b for r in both)


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_average_ranks_over_all_rows(spark, ranges):
    rng = random.Random(2)
    values = [float(rng.choice([1, 1, 1, rng.randrange(50), -3])) for _ in range(400)] + [float("nan")] * 3
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "x double").repartition(5)
    got = {r.x if r.x == r.x else "nan": r.rank_x for r in scans.average_ranks(df, "x", ranges).collect()}
    order = sorted(values, key=lambda v: (v != v, v))
    for v in set(values) - {float("nan")}:
        places = [i + 1 for i, o in enumerate(order) if o == v]
        if places:
            assert got[v] == sum(places) / len(places)
    assert got["nan"] == len(values) - 1 and None not in got


def test_spearman_without_keys_has_no_task_of_all_rows(spark):
    rng = random.Random(6)
    rows = [(float(rng.randrange(9)), rng.random()) for _ in range(500)]
    df = spark.createDataFrame([("k", *r) for r in rows] + [("k", None, 1.0)], "k string, x double, y double")
    alone_ = stats.spearman(df, "x", "y")
    assert not alone(alone_)
    assert alone_.first().spearman == pytest.approx(stats.spearman(df, "x", "y", ["k"]).first().spearman)


def test_curves_and_verification_have_no_window_of_all_dates(spark):
    fund = spark.createDataFrame([(day(i), 10.0 + i % 5) for i in range(90)], "date date, adj_close double")
    index = spark.createDataFrame([(day(i), 20.0 + i % 4) for i in range(5, 90)], "date date, index_value double")
    compared = quality.verification_series(fund, index)
    assert not alone(compared) and not alone(quality.verify_index(fund, index))
    assert compared.count() == 84
    values = spark.createDataFrame([(p, day(i), 100.0 + i * (1 + j)) for j, p in enumerate("ab") for i in range(30)], "portfolio_id string, date date, portfolio_value double")
    curves = quality.strategy_curves(values, "a", "b")
    assert not alone(curves)
    last = curves.orderBy(F.desc("date")).first()
    assert (last.growth_a, last.growth_b) == (pytest.approx(129 / 100), pytest.approx(158 / 100))


def test_the_check_for_single_partition_windows_sees_one(spark):
    assert alone(spark.range(10).repartition(3).withColumn("r", F.row_number().over(Window.orderBy("id"))))
