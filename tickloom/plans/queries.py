"""Named queries over the driver's tables: one for each operator or family, whole tables each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import scans, series, stats
from tickloom.operators import align, metrics, quality, templates
from tickloom.operators.execution import EquityEngine, executable
from tickloom.operators.strategies import (
    STRATEGIES, BettingAgainstBeta, MeanReversion, Momentum, SingleHold, WeightedHold, with_bands,
)
from tickloom.sources import files, html, prices, vendor, workbooks

from . import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
START, END = "1996-01-01", "1997-12-31"
BRANDS = ["Brand#3", "Brand#11", "Brand#24"]
ALL_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def shown(df: DataFrame) -> DataFrame:
    """Dates as text and doubles at 6 places, so that results compare across engines."""
    out = {c: F.date_format(c, "yyyy-MM-dd") for c, t in df.dtypes if t == "date"}
    out |= {c: F.round(c, 6) + 0.0 for c, t in df.dtypes if t == "double"}
    return df.withColumns(out) if out else df


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(f(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


class _Panel(prices.PriceSource):
    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def read(self, tickers, start, end):
        return prices.in_range(self.rows, tickers, start, end)


def kept_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel for queries that read it several times: order lines are scanned and summed
    once, and the panel, a row for each brand and week, is written to the shared folder."""
    return files.stored(panels.price_panel(spark, sf_dir))


# --- sources, filters, reshaping


@query
def scan_filter_panel(spark, sf_dir):
    panel = panels.price_panel(spark, sf_dir)
    return _Panel(panel).read(BRANDS, START, END).where(F.col("ticker") != BRANDS[0])


@query
def scan_half_open(spark, sf_dir):
    daily = panels.price_panel(spark, sf_dir, "day")
    return prices.in_range(daily, BRANDS, START, END, end_included=False)


@query
def missing_tickers(spark, sf_dir):
    return _Panel(panels.price_panel(spark, sf_dir)).missing([*BRANDS, "Brand#99"], START, END)


@query
def panel_pivot(spark, sf_dir):
    wide = align.pivoted(panels.price_panel(spark, sf_dir), ALL_BRANDS)
    return wide.toDF("date", *[b.replace("#", "_").lower() for b in ALL_BRANDS])


@query
def panel_unpivot(spark, sf_dir):
    return align.unpivoted(align.pivoted(panels.price_panel(spark, sf_dir, "day"), ALL_BRANDS, "volume"), "volume")


@query
def bulk_vendor_unpivot(spark, sf_dir):
    long = panels.price_panel(spark, sf_dir)
    fields = [(b, f, c) for b in ALL_BRANDS for f, c in (("Adj Close", "adj_close"), ("Volume", "volume"))]
    wide = long.groupBy("date").agg(*[F.max(F.when(F.col("ticker") == b, F.col(c))).alias(f"{b}|{f}") for b, f, c in fields])
    return prices.WidePrices(wide).read(ALL_BRANDS, START, END)


@query
def csv_roundtrip(spark, sf_dir):
    path = files.shared_folder(spark)
    panels.price_panel(spark, sf_dir).select("ticker", "date", "volume").write.csv(path, header=True)
    return files.read_csv(spark, path, "ticker string, date date, volume double")


def _stated(spark, sf_dir):
    """Order lines as a file of stated returns, in which some cells are letters: C for returned goods, B for
    accepted ones without tax, and n/a as a date where the quantity is 1."""
    lines = panels.read(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_returnflag") == "R", "C").when((F.col("l_returnflag") == "A") & (F.col("l_tax") == 0), "B")
    path = files.shared_folder(spark)
    lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ID"), F.when(F.col("l_quantity") == 1, "n/a").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("DATE"),
        F.coalesce(code, F.col("l_discount").cast("string")).alias("RET"), "l_quantity",
    ).write.csv(path, header=True)
    return path


STATED = "ID long, DATE date, RET double, l_quantity double"


@query
def csv_rejects(spark, sf_dir):
    """Rows of a file with letter codes: how many are good, and how many are kept apart for which cells."""
    checked = files.read_csv_checked(spark, _stated(spark, sf_dir), STATED)
    good = checked.rows.agg(F.lit("good").alias("kind"), F.lit("").alias("code"), F.count("*").alias("n"), F.sum(F.col("RET").cast("decimal(18,2)")).cast("double").alias("total"))
    bad = checked.rejected.groupBy(F.array_join("bad_columns", ",").alias("kind"), F.coalesce(files.number_or_code(F.col("RET"))[1], F.lit("")).alias("code"))
    return good.unionByName(bad.agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("total")))


@query
def csv_lenient(spark, sf_dir):
    """The same file with such cells read as null."""
    rows = files.read_csv(spark, _stated(spark, sf_dir), STATED, on_bad="null")
    return rows.groupBy(F.year("DATE").alias("year")).agg(F.count("*").alias("n"), F.count("RET").alias("n_known"), F.sum(F.col("RET").cast("decimal(18,2)")).cast("double").alias("total"))


@query
def parquet_roundtrip(spark, sf_dir):
    path = files.shared_folder(spark)
    prices.write_prices(panels.price_panel(spark, sf_dir), path)
    return prices.TablePrices(spark, path).read(BRANDS, START, END).select("ticker", "date", "adj_close", "volume")


@query
def bucketed_panels(spark, sf_dir):
    """Both vendors' panels as bucketed tables: their join by ticker and date and a window by ticker shuffle nothing."""
    names = [f"prices_{v}_{uuid4().hex}" for v in "ab"]
    for v, name in zip("ab", names, strict=True):
        own = panels.vendor_prices(spark, sf_dir, v).withColumnRenamed(f"price_{v}", "adj_close")
        prices.write_bucketed(own, name, 8, files.shared_folder(spark))
    a, b = (prices.BucketedPrices(spark, n).read(_all_brands(spark, sf_dir), START, END) for n in names)
    both = a.join(b.withColumnRenamed("adj_close", "other"), ["ticker", "date"])
    return both.withColumn("change", series.returns(P("adj_close"), W())).select("ticker", "date", "adj_close", "other", "change")


@query
def source_fallback(spark, sf_dir):
    panel = panels.price_panel(spark, sf_dir)
    absent = lambda: prices.TablePrices(spark, f"{sf_dir}/absent_prices.parquet")
    return prices.first_usable([absent, lambda: _Panel(panel.limit(0)), lambda: _Panel(panel)], BRANDS, START, END)


@query
def vendor_adjusted(spark, sf_dir):
    lines = panels.read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("datadate")).agg(
        F.max("l_extendedprice").alias("prccd"), F.max("l_discount").alias("ajexdi"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("cshtrd")
    )
    return prices.VendorPrices(lines.withColumn("tic", F.lit("ALL"))).with_volume(["ALL"], START, END)


@query
def rename_dictionary(spark, sf_dir):
    part = panels.read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("(key) Part key (internal)"), F.col("p_brand").alias("(tic) Ticker Symbol"), "p_size"
    )
    renamed, names = files.short_names(part)
    described = "; ".join(f"{k}={v}" for k, v in names.items())
    return renamed.withColumn("described", F.lit(described))


@query
def ticker_remap(spark, sf_dir):
    part = panels.read(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), "p_partkey")
    return files.respelt(part, "ticker", {"Brand#11": "Brand-11", "Brand": "x"}).groupBy("ticker").agg(F.count("*").alias("n"))


def _sheet(spark, sf_dir):
    held = panels.holdings(spark, sf_dir).select(F.col("ticker").alias("k"), F.array(F.lit("x"), F.concat(F.lit(" "), "ticker"), F.round("weight", 4).cast("string")).alias("cells"))
    top = spark.createDataFrame([(" 1", ["Fund of brands", None, None]), (" 2", ["As of", "today", None]), (" 3", ["Name", "Ticker", "Weight"])], "k string, cells array<string>")
    gap = spark.createDataFrame([("Brand#19x", ["inner gap", None, "1"]), ("z1", ["note", " ", None]), ("z2", [None, None, None])], "k string, cells array<string>")
    return files.numbered(top.unionByName(held).unionByName(gap), "k").select("rid", "cells")


@query
def header_detect(spark, sf_dir):
    return files.table_below_header(_sheet(spark, sf_dir))


def _workbook(spark, rows):
    """The path of a workbook file of one sheet with the rows (rid, cells)."""
    path = f"{files.shared_folder(spark)}.xlsx"
    files.write_bytes(spark, path, workbooks.as_workbooks(rows.withColumn("path", F.lit(path))).first().content)
    return path


@query
def workbook_header_detect(spark, sf_dir):
    return files.holdings_sheet(spark, _workbook(spark, _sheet(spark, sf_dir)))


@query
def workbook_plain(spark, sf_dir):
    part = panels.read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("p_size").cast("long")).alias("size"))
    cells = part.select(F.col("p_brand").alias("k"), F.array("p_brand", F.col("n").cast("string"), F.col("size").cast("string")).alias("cells"))
    head = spark.createDataFrame([(" ", ["(tic) Ticker Symbol", "n", "size"])], "k string, cells array<string>")
    sheet = files.numbered(head.unionByName(cells), "k").select("rid", "cells")
    table, _ = files.short_names(files.read_by_suffix(spark, _workbook(spark, sheet)))
    return table.select("tic", F.col("n").try_cast("double").alias("n"), F.col("size").try_cast("double").alias("size"))


@query
def vendor_from_file(spark, sf_dir):
    lines = panels.read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("datadate")).agg(
        F.max("l_extendedprice").cast("double").alias("prccd"), F.max("l_discount").cast("double").alias("ajexdi"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("cshtrd")
    )
    path = f"{files.shared_folder(spark)}.csv"
    lines.withColumn("tic", F.lit(" ALL ")).withColumnRenamed("prccd", "(prccd) Price (close)").write.csv(path, header=True)
    return prices.VendorPrices.open(spark, path).with_volume(["ALL"], START, END)


@query
def vendor_connector(spark, sf_dir):
    path = files.shared_folder(spark)
    panels.price_panel(spark, sf_dir).write.parquet(path)
    return prices.NetworkPrices(spark, path=path).read(ALL_BRANDS, START, END)


@query
def vendor_by_ticker(spark, sf_dir):
    """The frames of all tickers, each of which fetches its own ticker."""
    path = files.shared_folder(spark)
    panel = panels.price_panel(spark, sf_dir)
    panel.write.parquet(path)
    tickers = [r.p_brand for r in panels.read(spark, sf_dir, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    frames = vendor.by_ticker(spark, tickers, START, END, path=path)
    return reduce(DataFrame.unionByName, [frame.select(F.lit(t).alias("ticker"), "*") for t, frame in frames.items()])


@query
def vendor_pushdown(spark, sf_dir):
    """All tickers of a vendor, narrowed by filters that reach its fetches."""
    path = files.shared_folder(spark)
    panels.price_panel(spark, sf_dir, "day").write.parquet(path)
    tickers = [r.p_brand for r in panels.read(spark, sf_dir, "part").select("p_brand").distinct().collect()]
    wanted = (F.col("date") > F.lit("1996-03-31").cast("date")) & (F.col("date") <= F.lit("1997-06-30").cast("date")) & F.col("ticker").startswith("Brand#1")
    rows = vendor.fetched_where(spark, wanted, tickers, "1990-01-01", "2030-01-01", path=path)
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.max("adj_close").alias("high"), F.sum("volume").alias("volume"))


@query
def benchmark_backfill(spark, sf_dir):
    panel = panels.price_panel(spark, sf_dir)
    market = _Panel(panels.benchmark_prices(spark, sf_dir).withColumn("ticker", F.lit("SPY")))
    return prices.with_benchmark(prices.with_benchmark(panel, market), market).select("ticker", "date", "adj_close")


def _universe_pages(spark, sf_dir):
    """A page with a table in a cell of another, spans, entities and end tags left out, over all brands."""
    inner = "<table><tr><th>Symbol<tr><td>not&nbsp;this</table>"
    row = F.concat(F.lit("<tr><td>No.&#32;1<td><br/>&nbsp;<a href='x?a=1&amp;b=2'><b>"), F.replace("p_brand", F.lit("#"), F.lit(" &amp; ")), F.lit(f"</b></a><td>{inner}</td></tr>"))
    rows = F.array_join(F.sort_array(F.collect_set(row)), "\n")
    junk = "<table><tr><td>Symbol of</td></tr></table><script>'<table><tr><td>Symbol</td></tr>'</script>"
    page = F.concat(F.lit(f"<html>{junk}<table class='t'><thead><tr><th>Name</th><th> Symb&#111;l </th><th colspan=2>x</th></tr></thead>"), rows, F.lit(f"</table>{junk}"))
    return panels.read(spark, sf_dir, "part").agg(page.alias("html"))


@query
def universe_by_header(spark, sf_dir):
    return files.universe(_universe_pages(spark, sf_dir), column="Symbol")


@query
def html_spans(spark, sf_dir):
    """A page for each brand, read as a grid: a cell over the rows of a brand's sizes and one over two columns."""
    part = panels.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    cells = F.sort_array(F.collect_list(F.struct("size", F.concat(F.lit("<td>"), "size", F.lit("<td>"), "n").alias("cell"))))
    body = F.array_join(F.transform(cells, lambda c: c["cell"]), "<tr>")
    page = F.concat(F.lit("<table><tr><th rowspan='2'>Brand<th colspan=2>Parts<tr><th>Size<th>N<tr><td rowspan="), F.count("*").cast("string"), F.lit(">&lt;"), "brand", F.lit("&gt;"), body, F.lit("</table>"))
    return html.html_tables(part.groupBy("brand").agg(page.alias("html"))).select("brand", "rid", F.array_join("cells", "|").alias("cells"))


@query
def ingest_prices(spark, sf_dir):
    source = _Panel(panels.price_panel(spark, sf_dir).withColumn("ticker", F.replace("ticker", F.lit("#"), F.lit(" & "))))
    return prices.ingest(_universe_pages(spark, sf_dir), source, files.shared_folder(spark), START, END).select("ticker", "date", "adj_close", "volume", "vwap")


@query
def cache_roundtrip(spark, sf_dir):
    cache = prices.TableCache(spark, files.shared_folder(spark))
    if cache.get("panel") is None:
        cache.set("panel", panels.price_panel(spark, sf_dir).select("ticker", "date", "adj_close"))
    return cache.get("panel")


@query
def cache_snapshots(spark, sf_dir):
    """What a frame reads that was got before the key was set anew, beside what the key holds then."""
    cache = prices.TableCache(spark, files.shared_folder(spark))
    cache.set("volumes", panels.price_panel(spark, sf_dir).select("ticker", "date", "volume"))
    before = cache.get("volumes")
    cache.set("volumes", before.where(F.col("volume") > 100).withColumn("volume", F.col("volume") * 2))
    after = cache.get("volumes").groupBy("ticker").agg(F.count("*").alias("n_after"), F.sum("volume").alias("after"))
    return before.groupBy("ticker").agg(F.count("*").alias("n_before"), F.sum("volume").alias("before")).join(after, "ticker", "left")


@query
def universe_append(spark, sf_dir):
    pages = panels.read(spark, sf_dir, "part").select(
        F.concat(F.lit("<table><tr><th>Symbol</th></tr><tr><td><a href='x'>BR."), F.translate(F.substring("p_brand", 7, 2), "0123456789", "ABCDEFGHIJ"), F.lit("</a></td><td>Name</td></tr></table>")).alias("html")
    )
    return files.universe(pages)


# --- profiling


@query
def profile_nulls(spark, sf_dir):
    wide = align.pivoted(panels.price_panel(spark, sf_dir, "day"), ALL_BRANDS).toDF("date", *[b.replace("#", "_").lower() for b in ALL_BRANDS])
    return stats.null_counts(wide)


@query
def profile_keys(spark, sf_dir):
    """Which key columns the panel offers, and how many values and gaps those have."""
    return stats.key_columns(panels.price_panel(spark, sf_dir), ["ticker", "date", "volume", "cusip"])


@query
def any_missing(spark, sf_dir):
    return stats.any_missing(_sparse(spark, sf_dir).select("ticker", "adj_close"), "ticker")


@query
def profile_topk(spark, sf_dir):
    return stats.top_values(panels.price_panel(spark, sf_dir, "day"), "ticker", 10)


@query
def profile_summary(spark, sf_dir):
    return stats.summary(panels.price_panel(spark, sf_dir, "day"), "date", "ticker")


@query
def completeness(spark, sf_dir):
    return stats.completeness(panels.price_panel(spark, sf_dir, "day"))


@query
def complete_tickers(spark, sf_dir):
    return stats.complete_tickers(panels.price_panel(spark, sf_dir), ["Brand#11"])


# --- alignment


@query
def inner_align(spark, sf_dir):
    market = panels.benchmark_prices(spark, sf_dir).select("date", F.col("adj_close").alias("market"))
    return align.inner_align(panels.price_panel(spark, sf_dir).select("ticker", "date", "adj_close"), market)


@query
def left_align_first(spark, sf_dir):
    return align.align_to_first(panels.price_panel(spark, sf_dir, "day").select("ticker", "date", "adj_close"), BRANDS)


@query
def outer_grid(spark, sf_dir):
    return align.dense_grid(panels.price_panel(spark, sf_dir).select("ticker", "date", "adj_close"))


@query
def drop_empty_dates(spark, sf_dir):
    """Prices of odd months are blanked, and of two brands on all dates."""
    grid = align.dense_grid(panels.price_panel(spark, sf_dir).select("ticker", "date", "adj_close"))
    blank = F.col("ticker").isin(BRANDS[:2]) | (F.month("date") % 2 == 1)
    return align.drop_empty_dates(grid.withColumn("adj_close", F.when(~blank, F.col("adj_close"))))


@query
def anti_left(spark, sf_dir):
    return align.only_in(panels.vendor_prices(spark, sf_dir, "a"), panels.vendor_prices(spark, sf_dir, "b"), ["ticker", "date"])


@query
def anti_right(spark, sf_dir):
    return align.only_in(panels.vendor_prices(spark, sf_dir, "b"), panels.vendor_prices(spark, sf_dir, "a"), ["ticker", "date"])


@query
def semi_dates(spark, sf_dir):
    daily = panels.price_panel(spark, sf_dir, "day").select("ticker", "date", "volume")
    return align.also_in(daily, daily.where(F.col("ticker") == BRANDS[0]), ["date"])


@query
def append_absent(spark, sf_dir):
    part = panels.read(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return align.append_absent(part, spark.createDataFrame([("SPY",), ("Brand#11",)], "ticker string"), "ticker")


@query
def asof_month_end(spark, sf_dir):
    daily = panels.price_panel(spark, sf_dir, "day").select("ticker", "date", "adj_close")
    ends = series.month_ends(F.lit(START).cast("date"), F.lit(END).cast("date"))
    asked = daily.select("ticker").distinct().select("ticker", F.explode(ends).alias("date"))
    return align.as_of(asked, daily, ["ticker"], ["adj_close"])


@query
def asof_next_lines(spark, sf_dir):
    """For every day and brand the first day of trade at or after two weeks later: as-of joins forwards, over time ranges."""
    daily = files.stored(panels.price_panel(spark, sf_dir, "day").select("ticker", "date", "volume"))
    asked = daily.select("ticker", F.date_add("date", 14).alias("date"), F.col("volume").alias("was"))
    return align.as_of(asked, daily, ["ticker"], ["volume"], direction="forward")


@query
def asof_events(spark, sf_dir):
    """The latest order line shipped at or before each event's time 25 years ago, as one series without a key."""
    lines = panels.read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("timestamp").alias("ts")).agg(F.max("l_extendedprice").alias("price"))
    events = panels.read(spark, sf_dir, "events").select("event_id", (F.col("ts").cast("timestamp") - F.expr("INTERVAL 25 YEARS")).alias("ts"))
    found = align.as_of(events, files.stored(lines), [], ["price"], "ts")
    return found.select("event_id", F.date_format("as_of_ts", "yyyy-MM-dd").alias("as_of"), "price")


@query
def order_snapped(spark, sf_dir):
    """Month-end orders on the next week's day of trade."""
    panel = kept_panel(spark, sf_dir)
    return executable(files.stored(_bab(spark, sf_dir).orders(panel)), panel, "snap").select("seq", "date", "side", "ticker")


# --- series


def _weekly(spark, sf_dir, columns):
    return series.with_columns_over(panels.price_panel(spark, sf_dir), columns)


P, W = F.col, series.by_date


@query
def rolling_mean(spark, sf_dir):
    rows = scans.with_rolling(panels.price_panel(spark, sf_dir), {"mean_100": ("avg", P("adj_close"))}, 100)
    return rows.select("ticker", "date", "mean_100").dropna()


@query
def rolling_long(spark, sf_dir):
    """Windows of 1,000 days: as many steps a row as short ones."""
    rows = scans.with_rolling(panels.price_panel(spark, sf_dir, "day"), {"high": ("max", P("adj_close")), "low": ("min", P("adj_close")), "mean": ("avg", P("adj_close"))}, 1000)
    return rows.select("ticker", "date", "high", "low", "mean")


@query
def scan_lines(spark, sf_dir):
    """Running values over all order lines, summed by order and line, as one series of which no task sees the whole."""
    lines = panels.read(spark, sf_dir, "lineitem").groupBy((P("l_orderkey") * 10 + P("l_linenumber")).alias("place")).agg(
        F.sum(P("l_quantity").cast("decimal(18,2)")).alias("quantity"), F.max("l_extendedprice").alias("price"), F.max("l_returnflag").alias("flag")
    )
    out = scans.scan(files.stored(lines), "place", {
        "quantity_so_far": ("sum", P("quantity")), "highest": ("max", P("price")), "last_returned": ("last", F.when(P("flag") == "R", P("price"))), "price_before": ("lag", P("price")),
    })
    return out.select("place", P("quantity_so_far").cast("double").alias("quantity_so_far"), "highest", "last_returned", "price_before")


@query
def rolling_bands(spark, sf_dir):
    return with_bands(panels.price_panel(spark, sf_dir), 125).select("ticker", "date", "high", "low")


def _sparse(spark, sf_dir):
    return align.dense_grid(panels.price_panel(spark, sf_dir, "day").select("ticker", "date", "adj_close", "volume"))


@query
def returns_pad(spark, sf_dir):
    return series.padded_returns(_sparse(spark, sf_dir), "adj_close", "r", "ticker").select("ticker", "date", "r")


@query
def returns_nofill(spark, sf_dir):
    return series.with_columns_over(_sparse(spark, sf_dir), {"r": series.returns(P("adj_close"), W())})


@query
def cum_vwap(spark, sf_dir):
    return _weekly(spark, sf_dir, {"vwap": series.cumulative_vwap(P("adj_close"), P("volume"), W())})


@query
def cum_return(spark, sf_dir):
    r = series.padded_returns(panels.price_panel(spark, sf_dir), "adj_close", "r", "ticker")
    return series.with_columns_over(r.where(P("r").isNotNull()), {"cumulative": series.cumulative_return(P("r"), W())})


@query
def drawdown(spark, sf_dir):
    return _weekly(spark, sf_dir, {"drawdown": series.drawdown(P("adj_close"), W())})


@query
def ffill_bfill(spark, sf_dir):
    forward = series.ffill(P("volume"), W())
    return series.with_columns_over(_sparse(spark, sf_dir), {"filled": F.coalesce(forward, series.next_known(P("volume")))})


@query
def rebase(spark, sf_dir):
    return _weekly(spark, sf_dir, {"multiple": series.rebased(P("adj_close"), W())})


# --- statistics


def _bab(spark, sf_dir):
    return BettingAgainstBeta(files.stored(panels.benchmark_prices(spark, sf_dir)))


@query
def beta_full(spark, sf_dir):
    rows = _bab(spark, sf_dir).joined_returns(kept_panel(spark, sf_dir))[1]
    return rows.groupBy("ticker").agg(F.regr_slope("stock", "market").alias("beta"), F.count("*").alias("n"))


@query
def beta_rolling(spark, sf_dir):
    return _bab(spark, sf_dir).betas(kept_panel(spark, sf_dir))


def _both(spark, sf_dir):
    return _bab(spark, sf_dir).joined_returns(kept_panel(spark, sf_dir))[1]


@query
def pearson(spark, sf_dir):
    return _both(spark, sf_dir).groupBy("ticker").agg(stats.pearson(P("stock"), P("market")).alias("pearson"))


@query
def spearman(spark, sf_dir):
    return stats.spearman(_both(spark, sf_dir), "stock", "market", ["ticker"])


@query
def spearman_lines(spark, sf_dir):
    """Rank correlations over all order lines: ranks without keys, of values with many ties."""
    lines = panels.read(spark, sf_dir, "lineitem")
    pairs = [("l_extendedprice", "l_quantity"), ("l_discount", "l_tax"), ("l_extendedprice", "l_discount")]
    return reduce(DataFrame.unionByName, [stats.spearman(lines.select(a, b), a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "spearman") for a, b in pairs])


def _index(spark, sf_dir):
    return quality.weighted_index(kept_panel(spark, sf_dir), panels.holdings(spark, sf_dir))


@query
def worst_days(spark, sf_dir):
    return quality.worst_days(quality.verification_series(panels.benchmark_prices(spark, sf_dir), _index(spark, sf_dir)))


# --- orders


@query
def orders_mean_reversion(spark, sf_dir):
    return MeanReversion().orders(kept_panel(spark, sf_dir))


@query
def orders_momentum(spark, sf_dir):
    return Momentum().orders(kept_panel(spark, sf_dir))


@query
def orders_bab(spark, sf_dir):
    return _bab(spark, sf_dir).orders(kept_panel(spark, sf_dir))


@query
def orders_weighted(spark, sf_dir):
    return WeightedHold(panels.holdings(spark, sf_dir)).orders(kept_panel(spark, sf_dir))


@query
def orders_simple(spark, sf_dir):
    return STRATEGIES["single"](BRANDS[1]).orders(kept_panel(spark, sf_dir))


@query
def order_prefix(spark, sf_dir):
    panel = kept_panel(spark, sf_dir)
    return executable(MeanReversion().orders(panel), panel).select("portfolio_id", "seq", "date", "side", "ticker")


@query
def order_sorted(spark, sf_dir):
    panel = kept_panel(spark, sf_dir)
    return executable(_bab(spark, sf_dir).orders(panel), panel, "sorted").select("seq", "date", "side", "ticker")


@query
def template_strategy(spark, sf_dir):
    return templates.TemplateStrategy(10).orders(kept_panel(spark, sf_dir))


# --- backtests: every brand is a portfolio of its own, so that the folds run side by side


def _reversion(spark, sf_dir):
    panel = kept_panel(spark, sf_dir)
    return EquityEngine(1_000_000).run(MeanReversion(portfolio=F.col("ticker")).orders(panel), panel), panel


@query
def backtest_values(spark, sf_dir):
    return _reversion(spark, sf_dir)[0].values


@query
def backtest_holdings(spark, sf_dir):
    return _reversion(spark, sf_dir)[0].holdings


@query
def backtest_cash(spark, sf_dir):
    return _reversion(spark, sf_dir)[0].cash


@query
def backtest_pct_sizing(spark, sf_dir):
    panel = kept_panel(spark, sf_dir)
    return EquityEngine(1_000_000).run(Momentum(portfolio=F.col("ticker")).orders(panel), panel).values


@query
def backtest_portfolio(spark, sf_dir):
    """Cash shared by many tickers: betting against beta in one portfolio."""
    panel = kept_panel(spark, sf_dir)
    return EquityEngine(1_000_000, "sorted").run(_bab(spark, sf_dir).orders(panel), panel).cash


@query
def template_engine(spark, sf_dir):
    panel = kept_panel(spark, sf_dir)
    return templates.TemplateEngine(1_000_000).run(templates.TemplateStrategy(1).orders(panel), panel).values


@query
def template_fills(spark, sf_dir):
    """Which of all tickers' orders are filled, in the list's order, with cash for about half of them."""
    panel = kept_panel(spark, sf_dir)
    return templates.TemplateEngine(100_000).run(templates.TemplateStrategy(3).orders(panel), panel).holdings


@query
def metrics_display(spark, sf_dir):
    result, _ = _reversion(spark, sf_dir)
    return stats.displayed(metrics.ExtendedMetrics().compute(result).select("portfolio_id", "cumulative_return", "volatility"), ["cumulative_return"])


@query
def metrics_core(spark, sf_dir):
    result, _ = _reversion(spark, sf_dir)
    return metrics.ExtendedMetrics().compute(result).drop("average_turnover", "daily_turnover")


@query
def metrics_turnover(spark, sf_dir):
    result, panel = _reversion(spark, sf_dir)
    return metrics.ExtendedMetrics().compute(result, panel).select("portfolio_id", "average_turnover", "daily_turnover")


@query
def benchmark_curve(spark, sf_dir):
    market = series.padded_returns(panels.benchmark_prices(spark, sf_dir).withColumn("ticker", F.lit("all")), "adj_close", "r", "ticker")
    return metrics.return_curves(_reversion(spark, sf_dir)[0].values, market.where(P("r").isNotNull()).select("date", "r"))


@query
def final_values(spark, sf_dir):
    return metrics.final_values(_reversion(spark, sf_dir)[0].values)


# --- data quality


@query
def weighted_index(spark, sf_dir):
    return _index(spark, sf_dir)


@query
def verify_index(spark, sf_dir):
    return quality.verify_index(panels.benchmark_prices(spark, sf_dir), _index(spark, sf_dir), 0.01)


def _record(record):
    return record.withColumn("worst_days", F.array_join(F.transform("worst_days", lambda x: F.date_format(x["date"], "yyyy-MM-dd")), ","))


@query
def verify_record(spark, sf_dir):
    return _record(quality.verification_record(panels.benchmark_prices(spark, sf_dir), _index(spark, sf_dir), 0.01))


@query
def verify_nothing(spark, sf_dir):
    """Records of an empty fund and of an index on other dates, beside that of the same two on their own dates."""
    fund, index = panels.benchmark_prices(spark, sf_dir), _index(spark, sf_dir)
    apart = index.withColumn("date", F.date_add("date", 1))
    records = [quality.verification_record(a, b).select("error", "within_threshold", "max_diff", "mean_diff", "spearman", "worst_days") for a, b in ((fund.limit(0), index), (fund, apart), (fund, index))]
    infinite = lambda c: F.when(P(c) == float("inf"), "Infinity").otherwise(F.format_string("%.4f", P(c)))
    return _record(reduce(DataFrame.unionByName, records)).withColumns({c: infinite(c) for c in ("max_diff", "mean_diff")})


@query
def reconcile_returns(spark, sf_dir):
    a = panels.vendor_prices(spark, sf_dir, "a")
    stated = a.withColumn("ret", series.returns(P("price_a"), W())).where(P("ret").isNotNull()).select("ticker", "date", "ret")
    return quality.reconcile_returns(stated, panels.vendor_prices(spark, sf_dir, "b").withColumnRenamed("price_b", "price"))


@query
def reconcile_prices(spark, sf_dir):
    return quality.reconcile(panels.vendor_prices(spark, sf_dir, "a"), panels.vendor_prices(spark, sf_dir, "b"), ["ticker", "date"], P("price_a") - P("price_b"))


def _crsp(spark, sf_dir):
    """Vendor a's prices as security rows: unadjusted, with a factor, and returns as text, C for the first."""
    a = panels.vendor_prices(spark, sf_dir, "a").withColumn("RET", F.coalesce(series.returns(P("price_a"), W()).cast("string"), F.lit("C")))
    factor = F.when(P("date") < F.lit("1998-01-01").cast("date"), 4.0).otherwise(1.0)
    return prices.CrspPrices(files.stored(a.select(P("ticker").alias("TICKER"), P("date").alias("DATE"), (P("price_a") * factor).alias("PRC"), factor.alias("CFACPR"), "RET")))


def _all_brands(spark, sf_dir):
    return [r.p_brand for r in panels.read(spark, sf_dir, "part").select("p_brand").distinct().collect()]


@query
def crsp_prices(spark, sf_dir):
    """PRC / CFACPR against the other vendor's prices."""
    own = _crsp(spark, sf_dir).read(_all_brands(spark, sf_dir), "1990-01-01", "2030-01-01")
    return quality.reconcile(own, panels.vendor_prices(spark, sf_dir, "b"), ["ticker", "date"], P("adj_close") - P("price_b"))


@query
def crsp_returns(spark, sf_dir):
    """Stated returns with letter codes, read leniently, against the other vendor's changes of price."""
    stated = _crsp(spark, sf_dir).returns(_all_brands(spark, sf_dir), "1990-01-01", "2030-01-01", lenient=True)
    return quality.reconcile_returns(stated, panels.vendor_prices(spark, sf_dir, "b").withColumnRenamed("price_b", "price"))


@query
def vendor_compare(spark, sf_dir):
    return quality.compare_prices(panels.vendor_prices(spark, sf_dir, "a"), panels.vendor_prices(spark, sf_dir, "b"), "price_a", "price_b", ["ticker", "date"])


@query
def price_differences(spark, sf_dir):
    return quality.price_differences(panels.vendor_prices(spark, sf_dir, "a"), panels.vendor_prices(spark, sf_dir, "b"), "price_a", "price_b", ["ticker", "date"])


def _two_strategies(spark, sf_dir):
    panel = kept_panel(spark, sf_dir)
    weighted = WeightedHold(panels.holdings(spark, sf_dir), 900_000).orders(panel)
    single = SingleHold(BRANDS[1], 900_000).orders(panel)
    return EquityEngine(1_000_000).run(weighted.unionByName(single), panel).values


@query
def strategy_compare(spark, sf_dir):
    return quality.compare_strategies(_two_strategies(spark, sf_dir), "weighted", "single")


@query
def strategy_curves(spark, sf_dir):
    return quality.strategy_curves(_two_strategies(spark, sf_dir), "weighted", "single")
