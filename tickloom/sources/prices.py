"""Price sources: each returns a lazy long panel (ticker, date, adj_close and more)."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Sequence
from datetime import timedelta
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.series import by_date, clean, cumulative_vwap
from tickloom.operators.align import align_to_first

from .files import hadoop_path, number_or_code, read_by_suffix, short_names, strict_number, stripped_columns, universe
from .vendor import vendor_panel
from .workbooks import serial_date


class PriceSource(ABC):
    @abstractmethod
    def read(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        """Prices of tickers from start to end, both included."""

    def missing(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        """Those of tickers that have no row in the range."""
        spark = SparkSession.active()
        asked = spark.createDataFrame([(t,) for t in tickers], "ticker string")
        return asked.join(self.read(tickers, start, end).where(F.col("adj_close").isNotNull()), "ticker", "left_anti")


def in_range(rows: DataFrame, tickers: Sequence[str], start: str, end: str, end_included: bool = True) -> DataFrame:
    """Both filters reach the Parquet scan. Network vendors exclude the end date."""
    last = F.to_date(F.lit(end)) if end_included else F.date_sub(F.to_date(F.lit(end)), 1)
    return rows.where(F.col("ticker").isin(list(tickers)) & F.col("date").between(F.to_date(F.lit(start)), last))


class TablePrices(PriceSource):
    """A price table written by write_prices. align='first' puts all tickers on the first one's dates."""

    def __init__(self, spark: SparkSession, path: str, align: str | None = None) -> None:
        self.rows, self.align = spark.read.parquet(path), align

    def read(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        rows = in_range(self.rows, tickers, start, end).withColumn("adj_close", clean(F.col("adj_close")))
        return align_to_first(rows, tickers) if self.align == "first" else rows


class VendorPrices(PriceSource):
    """Daily vendor rows: tic, datadate, prccd, ajexdi or trfd, and for volumes cshtrd. The adjusted price
    is prccd * ajexdi, or with use_trfd the factor itself."""

    def __init__(self, rows: DataFrame, use_trfd: bool = False) -> None:
        needed = {"tic", "datadate", *(["trfd"] if use_trfd else ["prccd", "ajexdi"])}
        if absent := sorted(needed - set(rows.columns)):
            raise ValueError(f"columns are missing: {', '.join(absent)}")
        price = F.col("trfd") if use_trfd else F.col("prccd") * F.col("ajexdi")
        self.rows = rows.withColumns({
            "ticker": F.col("tic"), "date": F.to_date("datadate"), "adj_close": clean(price.cast("double")), "volume": F.col("cshtrd").cast("double") if "cshtrd" in rows.columns else F.lit(None).cast("double"),
        })

    @classmethod
    def open(cls, spark: SparkSession, path: str, use_trfd: bool = False) -> VendorPrices:
        """From a csv, parquet or xlsx file; long column names are cut and text columns typed."""
        rows, _ = short_names(read_by_suffix(spark, path))
        kinds = {c: F.col(c).try_cast("double") for c in ("prccd", "ajexdi", "trfd", "cshtrd") if c in rows.columns}
        if dict(rows.dtypes).get("datadate") == "string":
            kinds["datadate"] = serial_date(F.col("datadate"))
        return cls(stripped_columns(rows.withColumns(kinds), "tic", "cusip", "addzip"), use_trfd)

    def read(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        return in_range(self.rows, tickers, start, end).select("ticker", "date", "adj_close")

    def with_volume(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        return in_range(self.rows, tickers, start, end).select("ticker", "date", "adj_close", "volume")


class CrspPrices(PriceSource):
    """Daily security rows: TICKER, DATE, PRC, CFACPR, and RET as text, in which letters stand for returns
    that are not known. The adjusted price is PRC / CFACPR."""

    def __init__(self, rows: DataFrame) -> None:
        if absent := sorted({"TICKER", "DATE", "PRC", "CFACPR"} - set(rows.columns)):
            raise ValueError(f"columns are missing: {', '.join(absent)}")
        price = F.try_divide(F.col("PRC").cast("double"), F.col("CFACPR").cast("double"))
        self.rows = rows.withColumns({"ticker": F.col("TICKER"), "date": F.to_date("DATE"), "adj_close": clean(price)})

    def read(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        return in_range(self.rows, tickers, start, end).select("ticker", "date", "adj_close")

    def returns(self, tickers: Sequence[str], start: str, end: str, lenient: bool = False) -> DataFrame:
        """ticker, date, ret, code: stated returns. A letter code is an error, or if lenient a null ret with its code."""
        number, code = number_or_code(F.col("RET"))
        rows = in_range(self.rows, tickers, start, end)
        return rows.select("ticker", "date", (number if lenient else strict_number(F.col("RET"))).alias("ret"), code.alias("code"))


class NetworkPrices(PriceSource):
    """A vendor behind the data source API (vendor.py); options go to its fetch function."""

    def __init__(self, spark: SparkSession, fetch: str = "tickloom.sources.vendor:from_parquet", **options: str) -> None:
        self.spark, self.fetch, self.options = spark, fetch, options

    def read(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        return vendor_panel(self.spark, list(tickers), start, end, self.fetch, **self.options).withColumn("adj_close", clean(F.col("adj_close")))


class WidePrices(PriceSource):
    """Columns ``<ticker>|<field>`` beside date, as bulk vendors deliver them, read into long form."""

    def __init__(self, wide: DataFrame, end_included: bool = False) -> None:
        fields: dict[str, list[str]] = {}
        for c in wide.columns:
            if c != "date":
                fields.setdefault(c.split("|")[0], []).append(c)
        rows = F.array(*[
            F.struct(F.lit(t).alias("ticker"), *[(F.col(f"`{t}|{f}`") if f"{t}|{f}" in cs else F.lit(None)).cast("double").alias(n) for f, n in (("Adj Close", "adj_close"), ("Volume", "volume"))])
            for t, cs in fields.items()
        ])
        self.rows, self.end_included = wide.select("date", F.inline(rows)), end_included

    def read(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        return in_range(self.rows, tickers, start, end, self.end_included).withColumn("adj_close", clean(F.col("adj_close")))


def first_usable(openers: Sequence, tickers: Sequence[str], start: str, end: str, least_rows: int = 10) -> DataFrame:
    """The first source's panel that opens and has at least least_rows rows; opener() gives a PriceSource.

    Only that many rows are looked at. Raises if none will do."""
    for opener in openers:
        try:
            panel = opener().read(tickers, start, end)
        except AnalysisException:
            continue
        if panel.limit(least_rows).count() >= least_rows:
            return panel
    raise ValueError("no source has enough rows")


def write_prices(panel: DataFrame, path: str) -> None:
    """A price table partitioned by ticker, so that reads of some tickers skip the others' files."""
    panel.repartition("ticker").sortWithinPartitions("ticker", "date").write.partitionBy("ticker").option("compression", "snappy").parquet(path)


def write_bucketed(panel: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """A catalog table of the panel in so many buckets of tickers, one sorted file each: windows by ticker
    and joins with tables of as many buckets read it without a shuffle. path: the table's folder, else the warehouse's."""
    writer = panel.repartition(buckets, "ticker").write.bucketBy(buckets, "ticker").sortBy("ticker", "date").option("compression", "snappy")
    (writer if path is None else writer.option("path", path)).saveAsTable(name)


class BucketedPrices(PriceSource):
    """A price table written by write_bucketed. Joins by ticker and date use the buckets of tickers only if the
    session does not ask joins to be dealt out by all their keys, so that is set."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.rows = spark.table(name)

    def read(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        return in_range(self.rows, tickers, start, end).withColumn("adj_close", clean(F.col("adj_close")))


def with_benchmark(panel: DataFrame, source: PriceSource, benchmark: str = "SPY", end_included: bool = False) -> DataFrame:
    """panel, and the benchmark's rows from source over the panel's dates where the panel has none of it.
    As network vendors do, the last date is left out unless end_included. The panel's dates are looked
    up at once, as a vendor is asked for no others, and for none if the panel has the benchmark."""
    known = panel.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_if(F.col("ticker") == benchmark).alias("own")).first()
    if known.own or known.first is None:
        return panel
    # a source that leaves out its end date itself is asked for a day more
    rows = source.read([benchmark], str(known.first), str(known.last + timedelta(days=1) if end_included else known.last))
    upto = F.col("date") <= known.last if end_included else F.col("date") < known.last
    return panel.unionByName(rows.where((F.col("date") >= known.first) & upto), allowMissingColumns=True)


def ingest(pages: DataFrame, source: PriceSource, path: str, start: str, end: str, column: str | None = "Symbol", benchmark: str = "SPY") -> DataFrame:
    """One job from universe pages to a saved price table with cumulative VWAP: ticker, date, adj_close,
    volume, vwap. The list of tickers, some hundreds, is read at once; prices never are."""
    tickers = [r.ticker for r in universe(pages, benchmark, column=column).orderBy("ticker").collect()]
    panel = source.read(tickers, start, end).select("ticker", "date", "adj_close", "volume")
    write_prices(panel.withColumn("vwap", cumulative_vwap(F.col("adj_close"), F.col("volume"), by_date())), path)
    return pages.sparkSession.read.parquet(path)


class Cache(ABC):
    """Subclass to keep frequently read tables elsewhere."""

    @abstractmethod
    def get(self, key: str) -> DataFrame | None: ...

    @abstractmethod
    def set(self, key: str, rows: DataFrame) -> None: ...


class TableCache(Cache):
    """Named tables under one shared folder, as snapshots.

    set() writes a new version beside the old ones and then swaps the key's pointer by one atomic
    rename, so a reader sees the old table or the new one, never parts of both or none, and frames
    that get() gave go on reading what they began with. Versions that are no longer the current one are
    deleted by set() once they are older than ``keep_seconds``, or by sweep()."""

    def __init__(self, spark: SparkSession, folder: str, keep_seconds: float = 86_400) -> None:
        self.spark, self.folder, self.keep_seconds = spark, folder.rstrip("/"), keep_seconds

    def current(self, key: str) -> str | None:
        """The key's version; None if there is none."""
        path, store = hadoop_path(self.spark, f"{self.folder}/{key}/current")
        if not store.exists(path):
            return None
        stream = store.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def get(self, key: str) -> DataFrame | None:
        version = self.current(key)
        return None if version is None else self.spark.read.parquet(f"{self.folder}/{key}/{version}")

    def set(self, key: str, rows: DataFrame) -> None:
        version = f"version-{uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{key}/{version}")
        fs = self.spark._jvm.org.apache.hadoop.fs
        pointer, store = hadoop_path(self.spark, f"{self.folder}/{key}/current")
        written = fs.Path(f"{self.folder}/{key}/{version}.pointer")
        out = store.create(written, True)
        out.write(bytearray(version.encode()))
        out.close()
        kind = getattr(fs, "Options$Rename")
        overwrite = self.spark.sparkContext._gateway.new_array(kind, 1)
        overwrite[0] = kind.OVERWRITE
        context = fs.FileContext.getFileContext(store.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(written), context.makeQualified(pointer), overwrite)
        self.sweep(key, self.keep_seconds)

    def sweep(self, key: str, older_than: float = 0.0) -> int:
        """Deletes versions but the current one that were written more than so many seconds ago; their number.
        A version that is being written has no pointer yet and counts by its age, so leave time for writers."""
        path, store = hadoop_path(self.spark, f"{self.folder}/{key}")
        now, current, gone = time.time(), self.current(key), 0
        for status in store.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("version-") and name != current and now - status.getModificationTime() / 1000 >= older_than:
                store.delete(status.getPath(), True)
                gone += not name.endswith(".pointer")
        return gone
