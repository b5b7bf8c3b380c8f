"""Aggregates whose edge cases are defined: constant columns, empty groups, ties, nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import average_ranks


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the rows that have both; null if either is constant there."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def with_average_ranks(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """df with rank_<c> for each column: ties share the mean of their ranks. keys: ranks within groups.
    Without keys each column's values are counted, ranked by ranges and joined back, so no task sees all rows."""
    for c in columns:
        if keys:
            peers = F.count("*").over(Window.partitionBy(*keys, c))
            df = df.withColumn(f"rank_{c}", F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (peers - 1) / 2)
        else:
            df = df.join(average_ranks(df.select(c), c), c, "left")
    return df


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), name: str = "spearman") -> DataFrame:
    """Rank correlation of the rows that have both. df is read several times where there are no keys."""
    ranked = with_average_ranks(df.dropna(subset=[x, y]), [x, y], keys)
    return ranked.groupBy(*keys).agg(pearson(F.col(f"rank_{x}"), F.col(f"rank_{y}")).alias(name))


def mean_or_null(value: Column) -> Column:
    """Mean that is null if any value is missing."""
    return F.when(F.count(value) == F.count("*"), F.avg(value))


def all_true(condition: Column) -> Column:
    """True for no rows."""
    return F.coalesce(F.every(condition), F.lit(True))


def any_true(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, data_type, n_rows, n_null) in one pass; NaN does not count as null."""
    counted = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    entries = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col("n").alias("n_rows"), F.col(f"c{i}").alias("n_null")) for i, (c, t) in enumerate(df.dtypes)]
    return counted.select(F.inline(F.array(*entries)))


def key_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(column_name, present, data_type, n_values, n_null) of the wanted columns: what a source offers, and how
    many distinct values and nulls those that it has hold, in one pass."""
    kinds, have = dict(df.dtypes), [c for c in wanted if c in dict(df.dtypes)]
    counted = df.agg(F.count("*").alias("n"), *[f(f"`{c}`").alias(f"{n}{i}") for i, c in enumerate(have) for n, f in (("d", F.count_distinct), ("k", F.count))])
    none = F.lit(None).cast("long")
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(c in kinds).alias("present"), F.lit(kinds.get(c)).cast("string").alias("data_type"),
            (F.col(f"d{have.index(c)}") if c in kinds else none).alias("n_values"), (F.col("n") - F.col(f"k{have.index(c)}") if c in kinds else none).alias("n_null"),
        )
        for c in wanted
    ]
    return counted.select(F.inline(F.array(*entries)))


def any_missing(df: DataFrame, *keys: str) -> DataFrame:
    """For each key, or over all rows, whether any value of each other column is missing."""
    return df.groupBy(*keys).agg(*[any_true(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns if c not in keys])


def displayed(df: DataFrame, percent: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """df with its doubles as text for people: ``percent`` columns as 12.3456%, others with ``digits`` decimals."""
    shown = {c: F.format_string("%.4f%%", F.col(c) * 100) if c in percent else F.format_string(f"%.{digits}f", c) for c, t in df.dtypes if t == "double"}
    return df.withColumns({c: F.when(F.col(c).isNotNull(), x) for c, x in shown.items()})


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values; ties in value order."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("times"))
    return counts.orderBy(F.desc("times"), column).limit(k)


def summary(df: DataFrame, date: str, key: str) -> DataFrame:
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count_distinct(key).alias("n_keys"), F.count("*").alias("n_rows"))


def completeness(panel: DataFrame, n_dates: Column | None = None) -> DataFrame:
    """(ticker, n_present, complete_pct): share of the calendar's dates on which a ticker has a price.

    The calendar is a count, not a join: a dense grid is never built."""
    dates = panel.agg(F.count_distinct("date")).scalar() if n_dates is None else n_dates
    return panel.groupBy("ticker").agg(F.count("adj_close").alias("n_present")).withColumn("complete_pct", F.lit(100.0) * F.col("n_present") / dates)


def complete_tickers(panel: DataFrame, always: Sequence[str] = ()) -> DataFrame:
    """Tickers without a gap, and those always kept."""
    dates = panel.agg(F.count_distinct("date")).scalar()
    counts = panel.groupBy("ticker").agg(F.count("adj_close").alias("n_present"))
    return counts.where((F.col("n_present") == dates) | F.col("ticker").isin(list(always))).select("ticker")
