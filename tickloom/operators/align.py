"""Alignment of series by date: joins, grids, as-of lookups, difference reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scans import scan


def inner_align(left: DataFrame, right: DataFrame, on: Sequence[str] = ("date",), value: str | None = None) -> DataFrame:
    """Rows on keys that both have; with ``value``, only where all values are present."""
    out = left.join(right, list(on))
    return out.dropna() if value is None else out.dropna(subset=[value])


def align_to_first(panel: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """The panel on the dates of the first of tickers that has any; others lose their other dates,
    and have null where they lack one of these."""
    order = F.array_position(F.array(*[F.lit(t) for t in tickers]), F.col("ticker"))
    own = panel.where(F.col("ticker").isin(list(tickers)))
    anchor = own.agg(F.min_by("ticker", order)).scalar()
    dates = own.where(F.col("ticker") == anchor).select("date")
    grid = dates.select("date", F.explode(F.array(*[F.lit(t) for t in tickers])).alias("ticker"))
    present = own.select("ticker").distinct()
    return grid.join(present, "ticker", "left_semi").join(own, ["date", "ticker"], "left")


def dense_grid(panel: DataFrame) -> DataFrame:
    """A row for every ticker on every date that any ticker has; missing values are null.

    The calendar, some thousands of dates, is one array value; the tickers stay distributed."""
    calendar = panel.agg(F.sort_array(F.collect_set("date"))).scalar()
    grid = panel.select("ticker").distinct().select("ticker", F.explode(calendar).alias("date"))
    return grid.join(panel, ["ticker", "date"], "left")


def drop_empty_dates(rows: DataFrame, value: str = "adj_close") -> DataFrame:
    """rows without the dates on which every ticker's value is null."""
    return rows.join(rows.where(F.col(value).isNotNull()).select("date"), "date", "left_semi")


def only_in(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def also_in(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_semi")


def append_absent(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """rows, and those of more whose key no row has."""
    return rows.unionByName(more.join(rows.select(key), key, "left_anti"))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], values: Sequence[str], on: str = "date", direction: str = "backward") -> DataFrame:
    """left with as_of_<on> and values of right's last row at or before each left row, however old, or with
    direction='forward' of its first row at or after it.

    Both sides are one series for each key, scanned by ranges of time: each range passes its last known
    row on to those that follow, so neither a range join nor a task with all rows of a key is
    planned. ``on`` is a date, a timestamp or a number. Of several right rows at one time any one is
    taken; a left row without time finds nothing. Each side is read three times."""
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction is backward or forward, not {direction!r}")
    kind = dict(left.dtypes)[on]
    time = F.unix_date(on) if kind == "date" else F.unix_micros(F.col(on).cast("timestamp")) if kind.startswith("timestamp") else F.col(on)
    held = F.struct(F.col(on).alias(f"as_of_{on}"), *values)
    own = [c for c in left.columns if c not in (*by, on)]
    l_rows = left.select(*by, on, F.struct(*own, F.lit(True).alias("_left")).alias("_row"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("_held"))
    r_rows = right.where(F.col(on).isNotNull()).select(*by, on, F.lit(None).cast(l_rows.schema["_row"].dataType).alias("_row"), held.alias("_held"))
    both = l_rows.unionByName(r_rows).withColumns({"_time": time if direction == "backward" else -time, "_asks": F.col("_row").isNotNull()})
    out = scan(both, "_time", {"_found": ("last", F.col("_held"))}, keys=by, then=["_asks"]).where("_asks")
    found = F.when(F.col(on).isNotNull(), F.col("_found"))
    return out.withColumn("_found", found).select(*by, on, *[F.col(f"_row.{c}").alias(c) for c in own], "_found.*")


def pivoted(panel: DataFrame, tickers: Sequence[str], value: str = "adj_close") -> DataFrame:
    """Wide form: a row for each date and a column for each ticker; repeated (date, ticker) raise."""
    one = panel.where(F.col("ticker").isin(list(tickers))).groupBy("date", "ticker").agg(F.first(value).alias(value), F.count("*").alias("n"))
    checked = one.withColumn(value, F.when(F.col("n") == 1, F.col(value)).otherwise(F.raise_error(F.lit("duplicate (date, ticker)")).cast("double")))
    return checked.groupBy("date").pivot("ticker", list(tickers)).agg(F.first(value))


def unpivoted(wide: DataFrame, value: str = "adj_close") -> DataFrame:
    return wide.unpivot(["date"], [c for c in wide.columns if c != "date"], "ticker", value).where(F.col(value).isNotNull())
