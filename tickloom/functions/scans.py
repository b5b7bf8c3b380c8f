"""Running and rolling values whose work and parallelism follow the data.

``scan`` runs over one ordering that no key cuts up: rows are dealt out by ranges of the order,
every range is scanned by itself, the ranges' totals (one row each) are scanned, and what comes
before a range is added to its rows. ``with_rolling`` takes time linear in the rows whatever the
window's length: the series is cut into blocks of that length, and each window is the end of one
block and the beginning of the next.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an ordering is cut into.
RANGES = 64


def with_range(df: DataFrame, order: str, ranges: int = RANGES, name: str = "range") -> DataFrame:
    """df with the number of the range of ``order`` that a row is in: all rows of one value are in one range.

    The borders are quantiles, looked up at once: ``ranges`` values at most. Null is before all."""
    shares = [i / ranges for i in range(1, ranges)]
    kind = dict(df.dtypes)[order]
    if not kind.startswith(("date", "timestamp", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        raise TypeError(f"ranges are of numbers, dates or timestamps; {order} is {kind}")
    number = F.unix_date(order) if kind == "date" else F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith("timestamp") else F.col(order)
    borders = sorted(set(df.agg(F.percentile_approx(number, shares, 10_000).alias("b")).first().b or []))
    at_or_below = F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b <= number) if borders else F.array()
    return df.withColumn(name, F.when(F.col(order).isNull(), -1).otherwise(F.size(at_or_below)))


def _merge(kind: str, before: Column, own: Column) -> Column:
    """The running value where a range's own meets what comes before it; null stands for no value."""
    both = {
        "sum": before + own, "count": before + own, "product": before * own, "max": F.greatest(before, own), "min": F.least(before, own), "last": own, "first": before,
    }[kind]
    return F.coalesce(both, own, before)


_LOCAL: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "count": F.count, "product": F.product, "max": F.max, "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True),
}


def scan(
    df: DataFrame, order: str, columns: Mapping[str, tuple[str, Column]], keys: Sequence[str] = (), ranges: int = RANGES, then: Sequence[str] = ()
) -> DataFrame:
    """df with running values along ``order``, up to and including each row, without one task that sees all rows.

    columns: name -> (kind, value), of the kinds sum, count, product, max, min, last and first (nulls
    are passed over), and ``lag``: the value of the row before, null included. Rows of one ``order``
    value stand by the columns ``then``, and beyond that in no defined order. keys: a series for each,
    which may be of any length (null keys are one). df is read three times, so let it be a stored table if it is costly."""
    df = with_range(df, order, ranges, "_range")
    at = F.struct(order, *then)
    own = Window.partitionBy(*keys, "_range").orderBy(order, *then)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"_own_{n}": F.lag(v).over(own) if kind == "lag" else _LOCAL[kind](v).over(upto) for n, (kind, v) in columns.items()})
    local = local.withColumn("_first", F.row_number().over(own) == 1)

    def total(kind: str, value: Column) -> Column:
        if kind == "lag":
            return F.max_by(F.struct(value.alias("v")), at)
        if kind in ("last", "first"):
            return (F.max_by if kind == "last" else F.min_by)(value, F.when(value.isNotNull(), at))
        return _LOCAL[kind](value)

    def carry(name: str, kind: str) -> Column:
        """What the totals of the ranges before come to."""
        values = F.transform("_before", lambda x: x[name])
        if kind == "lag":
            return F.element_at(values, -1)["v"]
        of = totals.schema[name].dataType
        return F.aggregate(values, F.lit(None).cast(of), lambda acc, x: _merge(kind, acc, x).cast(of))

    totals = df.groupBy(*keys, "_range").agg(*[total(kind, v).alias(n) for n, (kind, v) in columns.items()])
    listed = totals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", *columns))).alias("_all"))
    before = listed.select(*keys, F.posexplode("_all").alias("_at", "_total"), "_all").where(F.col("_at") > 0)
    before = before.select(*keys, F.col("_total._range").alias("_range"), F.slice("_all", 1, F.col("_at")).alias("_before"))
    before = before.select(*keys, "_range", *[carry(n, kind).alias(f"_before_{n}") for n, (kind, _) in columns.items()])
    before = before.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, "_range")], *[f"_before_{n}" for n in columns])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, "_range")])
    out = local.join(before if keys else F.broadcast(before), same, "left")
    found = {}
    for n, (kind, _) in columns.items():
        if kind == "lag":
            found[n] = F.when(F.col("_first"), F.col(f"_before_{n}")).otherwise(F.col(f"_own_{n}"))
        else:
            found[n] = _merge(kind, F.col(f"_before_{n}"), F.col(f"_own_{n}"))
    kept = [c for c in df.columns if c not in ("_range", *columns)]
    return out.select(*kept, *[c.alias(n) for n, c in found.items()])


def average_ranks(df: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """A row for each distinct value of the column: the value and ``rank_<column>``, the mean rank of its rows
    over all of df. Values are counted first, so a value of many rows is one row; null has no rank."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    upto = scan(counts, column, {"_upto": ("sum", F.col("_n"))}, ranges=ranges)
    return upto.select(column, (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(f"rank_{column}"))


def with_rolling(df: DataFrame, columns: Mapping[str, tuple[str, Column]], n: int, shift: int = 0, keys: Sequence[str] = ("ticker",), order: str = "date") -> DataFrame:
    """df with values over the n rows up to ``shift`` rows before each; null unless all n are there and not null.

    columns: name -> (kind, value), of the kinds sum, avg, max and min. A window that ends at
    place o of a block is that block's rows up to o and the rows after o of the block before: two running
    values, one in each direction, so each row is looked at a fixed number of times and nothing is subtracted."""
    parts = {f"_{name}": (_LOCAL["sum" if kind == "avg" else kind], v) for name, (kind, v) in columns.items()}
    parts |= {f"_{name}_n": (F.count, v) for name, (_, v) in columns.items()}
    out, first, second = _blocks(df, parts, n, shift, keys, order)
    found = {}
    for name, (kind, _) in columns.items():
        a, b = first(f"_{name}"), second(f"_{name}")
        value = {"max": F.greatest(a, b), "min": F.least(a, b)}.get(kind, F.coalesce(a + b, a, b))
        count = F.coalesce(first(f"_{name}_n"), F.lit(0)) + F.coalesce(second(f"_{name}_n"), F.lit(0))
        found[name] = F.when(count == n, value / n if kind == "avg" else value)
    return out.select(*[c for c in df.columns if c not in found], *[c.alias(name) for name, c in found.items()])


def _blocks(df: DataFrame, parts: Mapping[str, tuple[Callable[[Column], Column], Column]], n: int, shift: int, keys: Sequence[str], order: str):
    """df with running values of parts in blocks of n rows, and functions that give, for the window that
    ends ``shift`` rows before a row, the part in its last block and the part in the one before."""
    series = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_i", F.row_number().over(series) - 1).withColumns({"_block": F.floor(F.col("_i") / n), "_place": F.col("_i") % n})
    up = Window.partitionBy(*keys, "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    # backwards, as a frame that reaches to the end is computed anew for every row
    down = Window.partitionBy(*keys, "_block").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{p}_up": agg(v).over(up) for p, (agg, v) in parts.items()})
    rows = rows.withColumns({f"{p}_down": agg(v).over(down) for p, (agg, v) in parts.items()})
    by_place = Window.partitionBy(*keys).orderBy("_i")
    late = {f"{p}_last": F.lag(f"{p}_up", shift).over(by_place) for p in parts} | {f"{p}_rest": F.lag(f"{p}_down", shift + n - 1).over(by_place) for p in parts}
    rows = rows.withColumns({**late, "_whole": F.lag("_place", shift).over(by_place) == n - 1})
    # a window that is exactly a block has no part in the one before
    return rows, lambda p: F.col(f"{p}_last"), lambda p: F.when(~F.col("_whole"), F.col(f"{p}_rest"))


def with_rolling_beta(df: DataFrame, stock: str, market: str, n: int, name: str = "beta", keys: Sequence[str] = ("ticker",), order: str = "date") -> DataFrame:
    """df with the slope of stock on market over the last n rows; null before there are n, where a value is
    missing, or if market is constant.

    The two parts of a window hold count, means and centred sums of squares and products, and meet by
    the pairwise formula, so nothing cancels."""
    x = F.when(F.col(stock).isNotNull(), F.col(market))
    y = F.when(F.col(market).isNotNull(), F.col(stock))
    parts = {"_n": (F.count, x * y), "_x": (F.avg, x), "_y": (F.avg, y), "_xx": (F.var_pop, x), "_xy": (lambda c: F.covar_pop(c, y), x), "_low": (F.min, x), "_high": (F.max, x)}
    out, first, second = _blocks(df, parts, n, 0, keys, order)
    a, b = first("_n"), F.coalesce(second("_n"), F.lit(0))
    share = F.try_divide((a * b).cast("double"), a + b)
    dx, dy = second("_x") - first("_x"), second("_y") - first("_y")
    met = lambda p, apart: first(p) * a + F.coalesce(second(p) * b + share * apart, F.lit(0.0))
    slope = F.try_divide(met("_xy", dx * dy), met("_xx", dx * dx))
    varies = F.least(first("_low"), second("_low")) < F.greatest(first("_high"), second("_high"))
    return out.select(*[c for c in df.columns if c != name], F.when((a + b == n) & varies, slope).alias(name))
