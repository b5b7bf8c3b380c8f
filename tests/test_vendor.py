"""Which calls reach a price vendor: one for each ticker and only for the dates that a query wants."""

import datetime as dt
import uuid
from functools import reduce
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources import prices, vendor

FETCH = "tests.test_vendor:counted"
TICKERS = ["A", "B", "C", "D"]


def counted(ticker, start, end, options):
    """A price a day; every call leaves a file that tells what was asked."""
    Path(options["log"], uuid.uuid4().hex).write_text(f"{ticker} {start} {end}")
    for i in range((end - start).days):
        yield start + dt.timedelta(days=i), float(ord(ticker)), None


@pytest.fixture
def calls(tmp_path):
    def read():
        found = sorted(p.read_text() for p in tmp_path.iterdir())
        for p in tmp_path.iterdir():
            p.unlink()
        return found

    read.folder = str(tmp_path)
    return read


SPAN = ("2024-01-01", "2024-03-01", FETCH)


def where(spark, calls, condition, tickers=TICKERS):
    return vendor.fetched_where(spark, condition, tickers, *SPAN, log=calls.folder)


def test_frames_of_single_tickers_fetch_each_once(spark, calls):
    frames = vendor.by_ticker(spark, TICKERS, *SPAN, log=calls.folder)
    assert [frames[t].count() for t in TICKERS] == [60] * 4
    assert calls() == [f"{t} 2024-01-01 2024-03-01" for t in TICKERS]
    together = reduce(DataFrame.unionByName, [f.select(F.lit(t).alias("ticker"), "*") for t, f in frames.items()])
    assert {(r.ticker, r.adj_close) for r in together.collect()} == {(t, float(ord(t))) for t in TICKERS}
    assert len(calls()) == 4


def test_filters_narrow_what_is_fetched(spark, calls):
    day = lambda s: F.lit(s).cast("date")
    narrow = where(spark, calls, F.col("ticker").isin("B", "D", "X") & (F.col("date") > day("2024-01-09")) & (F.col("date") <= day("2024-01-20")))
    assert calls() == ["B 2024-01-10 2024-01-21", "D 2024-01-10 2024-01-21"]
    assert narrow.count() == 22 and narrow.where("ticker = 'B'").union(narrow.where("ticker = 'D'")).count() == 22
    assert where(spark, calls, (F.col("date") >= day("2023-01-01")) & (F.col("date") < day("2024-01-03")) & (F.col("ticker") == "A")).count() == 2
    assert where(spark, calls, (F.col("date") == day("2024-02-01")) & (F.col("ticker") == "C")).first().date == dt.date(2024, 2, 1)
    assert calls() == ["A 2024-01-01 2024-01-03", "C 2024-02-01 2024-02-02"]


def test_filters_that_exclude_all_fetch_nothing(spark, calls):
    for nothing in ("ticker = 'Z'", "date > '2025-01-01'", "ticker = 'A' AND ticker = 'B'"):
        assert where(spark, calls, nothing).count() == 0
    assert calls() == [] and spark.conf.get(vendor.PUSHDOWN, "false") == "false"


def test_other_filters_are_applied_by_spark(spark, calls):
    few = lambda condition: where(spark, calls, condition, ["A", "B"]).count()
    assert few("ticker = 'A' OR date = '2024-01-01'") == 61
    assert few("adj_close > 65.5") == 60 and few("ticker <> 'A'") == 60 and few("ticker LIKE 'B%'") == 60
    assert few("volume IS NULL AND ticker IS NOT NULL") == 120
    assert len(calls()) in range(8, 11)


def test_a_frame_may_be_used_in_several_ways(spark, calls):
    rows = vendor.vendor_panel(spark, TICKERS, *SPAN, log=calls.folder)
    both = rows.where("ticker = 'A'").unionByName(rows.where("ticker = 'B' AND date < '2024-01-03'"))
    assert sorted({(r.ticker, r.adj_close) for r in both.collect()}) == [("A", 65.0), ("B", 66.0)] and both.count() == 62
    assert rows.count() == 240


def test_the_benchmark_is_fetched_over_the_panels_dates(spark, calls):
    source = prices.NetworkPrices(spark, FETCH, log=calls.folder)
    own = spark.createDataFrame([("A", dt.date(2024, 1, 5), 1.0), ("A", dt.date(2024, 1, 9), 2.0)], "ticker string, date date, adj_close double")
    out = prices.with_benchmark(own, source, "B")
    assert out.where("ticker = 'B'").count() == 4
    assert calls() == ["B 2024-01-05 2024-01-09"]
    assert prices.with_benchmark(own, source, "B", end_included=True).where("ticker = 'B'").count() == 5
    calls()
    assert prices.with_benchmark(own, source, "A").count() == 2 and prices.with_benchmark(own.limit(0), source, "B").count() == 0
    assert calls() == []
