"""Ordered-series functions: columns over a window of one series (by default a ticker) by date.

All are null-aware: a rolling value needs a full window of non-null values, and a running value is
null where its input is null but goes on after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_date(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("date")


def clean(value: Column) -> Column:
    """NaN is missing: it becomes null on the way in."""
    return F.when(~F.isnan(value), value)


def ffill(value: Column, w: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def bfill(value: Column, w: WindowSpec) -> Column:
    """For short series: Spark computes such a frame anew for every row. next_known() takes one pass."""
    return F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def next_known(value: Column, *keys: str, order: str = "date") -> Column:
    """value, or else the next one that is not null: bfill by a window that runs backwards."""
    back = Window.partitionBy(*(keys or ("ticker",))).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(back)


def rolling(agg, value: Column, w: WindowSpec, n: int, shift: int = 0) -> Column:
    """agg over the n rows up to ``shift`` rows ago; null unless all n are there and not null. Any
    aggregate, at n steps a row; scans.with_rolling() takes sums, means and extremes in a fixed number."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def running(agg, value: Column, w: WindowSpec) -> Column:
    return F.when(value.isNotNull(), agg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def returns(value: Column, w: WindowSpec) -> Column:
    """Change against the row before; null if either is missing."""
    return F.try_divide(value, F.lag(value).over(w)) - 1


def padded_returns(df: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """df with the change between values whose gaps are filled forward first."""
    w, filled = by_date(*keys), f"{name}_filled"
    out = df.withColumn(filled, ffill(F.col(value), w))
    return out.withColumn(name, returns(F.col(filled), w)).drop(filled)


def cumulative_return(r: Column, w: WindowSpec) -> Column:
    return running(F.product, 1 + r, w) - 1


def cumulative_vwap(price: Column, volume: Column, w: WindowSpec) -> Column:
    """Volume-weighted mean price since the series began."""
    return F.try_divide(running(F.sum, price * volume, w), running(F.sum, volume, w))


def drawdown(value: Column, w: WindowSpec) -> Column:
    return F.try_divide(value, running(F.max, value, w)) - 1


def rebased(value: Column, w: WindowSpec) -> Column:
    """Multiples of the series' first known value."""
    return F.try_divide(value, F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def rolling_beta(stock: Column, market: Column, w: WindowSpec, n: int) -> Column:
    """Slope of stock on market over the last n rows; null before there are n, or if market is constant.
    It takes n steps a row; scans.with_rolling_beta() a fixed number."""
    frame = w.rowsBetween(-(n - 1), 0)
    enough = F.count(stock * market).over(frame) == n
    return F.when(enough, F.regr_slope(stock, market).over(frame))


def month_ends(start: Column, end: Column) -> Column:
    """Array of the calendar month ends from start to end, both included."""
    ends = F.transform(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month")), F.last_day)
    return F.when(start <= end, F.filter(ends, lambda d: d.between(start, end)))


def with_columns_over(df: DataFrame, columns: dict[str, Column], keep: Sequence[str] = ("ticker", "date")) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])
