"""A price vendor behind Spark's data source API: ``spark.read.format("ticker_prices")``.

Each ticker is a partition, asked for by a task of its own, as a bulk download with threads would.
The vendor is a function ``fetch(ticker, start, end, options)`` that yields (date, adj_close,
volume), named in the option ``fetch`` as ``module:function``; the end date is not included.

``ticker_prices_where`` is the same source with filter pushdown: filters on ticker and date narrow what
is fetched. Spark 4.1 keeps the pushed filters with the loaded table, not with the query: a second
use of the same frame reads what the first one asked for, with wrong rows and no error. So frames
that callers hold have no pushdown (they ask for their tickers and dates by option), and
fetched_where(), which uses its frame once and returns what it wrote, is the only one to load it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator, Mapping
from importlib import import_module

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

from .files import stored

COLUMNS = "ticker string, date date, adj_close double, volume double"
#: Spark hands a Python source its filters only if this is set.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
DAY = dt.timedelta(days=1)


def from_parquet(ticker: str, start: dt.date, end: dt.date, options: Mapping[str, str]) -> Iterator[tuple[dt.date, float | None, float | None]]:
    """The offline vendor: a Parquet table of ticker, date, adj_close, volume at the option ``path``."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(options["path"]) if ":" in options["path"] else (fs.LocalFileSystem(), options["path"])
    wanted = (pc.field("ticker") == ticker) & (pc.field("date") >= start) & (pc.field("date") < end)
    table = ds.dataset(path, format="parquet", filesystem=store).to_table(columns=["date", "adj_close", "volume"], filter=wanted)
    yield from zip(*[table.column(c).to_pylist() for c in ("date", "adj_close", "volume")], strict=True)


class TickerPartition(InputPartition):
    """One ticker from start to end, end excluded."""

    def __init__(self, ticker: str, start: dt.date, end: dt.date) -> None:
        super().__init__(ticker)
        self.start, self.end = start, end


class TickerReader(DataSourceReader):
    """What is asked of the vendor: the options' tickers and dates."""

    def __init__(self, options: Mapping[str, str]) -> None:
        if absent := [k for k in ("fetch", "tickers", "start", "end") if k not in options]:
            raise ValueError(f"options are missing: {', '.join(absent)}")
        self.options = dict(options)
        self.tickers = list(dict.fromkeys(self.options["tickers"].split(",")))
        self.start, self.end = (dt.date.fromisoformat(self.options[k]) for k in ("start", "end"))

    def partitions(self) -> list[TickerPartition]:
        return [TickerPartition(t, self.start, self.end) for t in self.tickers] if self.start < self.end else []

    def read(self, partition: TickerPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        module, _, name = self.options["fetch"].partition(":")
        rows = list(getattr(import_module(module), name)(partition.value, partition.start, partition.end, self.options))
        dates, prices, volumes = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([partition.value] * len(rows), pa.string()), pa.array(dates, pa.date32()), pa.array(prices, pa.float64()), pa.array(volumes, pa.float64())],
            names=["ticker", "date", "adj_close", "volume"],
        )


class NarrowedReader(TickerReader):
    """TickerReader, narrowed by the filters that it takes over."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over (in)equalities of ticker and date with a value; the others are Spark's to apply."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("ticker",) and isinstance(f, EqualTo | EqualNullSafe | In | IsNotNull):
                if not isinstance(f, IsNotNull):  # no ticker that is asked for is null
                    wanted = set(value) if isinstance(f, In) else {value}
                    self.tickers = [t for t in self.tickers if t in wanted]
            elif column == ("date",) and isinstance(value, dt.date) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.start = max(self.start, value + DAY if isinstance(f, GreaterThan) else value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.end = min(self.end, value if isinstance(f, LessThan) else value + DAY)
            else:
                yield f


class TickerPrices(DataSource):
    """Options: fetch, tickers (comma-separated), start, end, and what fetch needs."""

    @classmethod
    def name(cls) -> str:
        return "ticker_prices"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> TickerReader:
        return TickerReader(self.options)


class NarrowedPrices(TickerPrices):
    """With pushdown: for frames that are used once."""

    @classmethod
    def name(cls) -> str:
        return "ticker_prices_where"

    def reader(self, schema) -> NarrowedReader:
        return NarrowedReader(self.options)


def vendor_panel(
    spark: SparkSession, tickers: list[str], start: str, end: str, fetch: str = "tickloom.sources.vendor:from_parquet", source: type[TickerPrices] = TickerPrices, **options: str
) -> DataFrame:
    """ticker, date, adj_close, volume from the vendor, the end date excluded."""
    spark.dataSource.register(source)
    asked = {"fetch": fetch, "tickers": ",".join(tickers), "start": start, "end": end, **options}
    return spark.read.format(source.name()).options(**asked).load()


def by_ticker(spark: SparkSession, tickers: list[str], start: str, end: str, fetch: str = "tickloom.sources.vendor:from_parquet", **options: str) -> dict[str, DataFrame]:
    """A frame of date, adj_close and volume for each ticker, as callers of single series expect. Each
    asks for its own ticker, so a use of a frame is one fetch."""
    return {t: vendor_panel(spark, [t], start, end, fetch, **options).select("date", "adj_close", "volume") for t in dict.fromkeys(tickers)}


def fetched_where(
    spark: SparkSession, condition: Column | str, tickers: list[str], start: str, end: str, fetch: str = "tickloom.sources.vendor:from_parquet", **options: str
) -> DataFrame:
    """The vendor's rows that fulfil a condition, fetched at once and written to the shared folder.

    Tickers that the condition's (in)equalities exclude are not fetched, and the others for its dates only;
    what else it says, Spark applies to the rows."""
    before = spark.conf.get(PUSHDOWN, None)
    spark.conf.set(PUSHDOWN, "true")
    try:
        return stored(vendor_panel(spark, tickers, start, end, fetch, NarrowedPrices, **options).where(condition))
    finally:
        spark.conf.unset(PUSHDOWN) if before is None else spark.conf.set(PUSHDOWN, before)
