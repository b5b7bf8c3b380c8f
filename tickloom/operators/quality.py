"""Data quality: weighted index against a fund, vendor against vendor, strategy against strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scans import scan
from tickloom.functions.series import by_date, ffill, next_known, padded_returns
from tickloom.functions.stats import all_true, pearson, spearman
from tickloom.sources.files import stored

from .align import dense_grid


def weighted_index(panel: DataFrame, holdings: DataFrame) -> DataFrame:
    """date, index_value: prices as multiples of the first, weighted.

    Weights are normalised over the tickers that have prices, each once for every listing with its
    first weight; gaps are filled forward, then back. A ticker whose first price is null or 0 adds
    nothing, and keeps its weight. All 0 if no ticker is priced, weights sum to 0, or there is one
    date. holdings: ticker, weight, optionally rid."""
    listed = holdings if "rid" in holdings.columns else holdings.withColumn("rid", F.lit(0))
    first = listed.groupBy("ticker").agg(F.min_by("weight", "rid").alias("weight"), F.sum("weight").alias("listed"), F.count("*").alias("times"))
    valid = first.join(panel.select("ticker").distinct(), "ticker", "left_semi")
    total = valid.agg(F.sum("listed")).scalar()
    w = by_date()
    rows = dense_grid(panel.select("ticker", "date", "adj_close")).withColumn("filled", ffill(F.col("adj_close"), w))
    rows = rows.withColumn("filled", F.coalesce("filled", next_known(F.col("adj_close"))))
    start = F.first("filled").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("multiple", F.when(start != 0, F.col("filled") / start))
    rows = rows.join(valid, "ticker", "left").withColumn("share", F.try_divide(F.col("weight") * F.col("times"), total))
    sums = rows.groupBy("date").agg(F.coalesce(F.sum(F.col("multiple") * F.col("share")), F.lit(0.0)).alias("index_value"))
    dates = panel.agg(F.count_distinct("date")).scalar()
    return sums.withColumn("index_value", F.when(dates > 1, F.col("index_value")).otherwise(F.lit(0.0)))


def verification_series(fund: DataFrame, index: DataFrame) -> DataFrame:
    """date, fund, index, fund_return, index_return, diff on the dates that both have a value.

    Both series are scanned by ranges of dates, over a table of the dates that match."""
    both = fund.select("date", F.col("adj_close").alias("fund")).join(index.select("date", F.col("index_value").alias("index")), "date").dropna()
    both = scan(stored(both), "date", {
        "fund_0": ("first", F.col("fund")), "index_0": ("first", F.col("index")), "fund_was": ("lag", F.col("fund")), "index_was": ("lag", F.col("index")),
    })
    change = lambda c: F.try_divide(F.try_divide(c, f"{c}_0"), F.try_divide(f"{c}_was", f"{c}_0")) - 1
    rows = both.select("date", *[F.try_divide(c, f"{c}_0").alias(c) for c in ("fund", "index")], *[change(c).alias(f"{c}_return") for c in ("fund", "index")])
    return rows.where(F.col("fund_return").isNotNull() & F.col("index_return").isNotNull()).withColumn("diff", F.abs(F.col("fund_return") - F.col("index_return")))


def verify_index(fund: DataFrame, index: DataFrame, threshold: float = 0.0001) -> DataFrame:
    """One row: the largest and mean absolute difference of returns, whether all are within the
    threshold, both correlations, and missing values of the unaligned inputs."""
    return _verified(stored(verification_series(fund, index)), fund, index, threshold)


def _verified(series: DataFrame, fund: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    stats = series.agg(
        F.max("diff").alias("max_diff"), F.avg("diff").alias("mean_diff"), all_true(F.col("diff") <= threshold).alias("within_threshold"),
        pearson(F.col("fund_return"), F.col("index_return")).alias("pearson"), F.count("*").alias("n_days"),
    )
    return stats.withColumns({
        "spearman": spearman(series, "fund_return", "index_return").scalar(),
        "fund_missing": fund.agg(F.count_if(F.col("adj_close").isNull())).scalar(),
        "index_missing": index.agg(F.count_if(F.col("index_value").isNull())).scalar(),
    })


def worst_days(series: DataFrame, k: int = 5) -> DataFrame:
    """The k days of the largest difference; of ties the first."""
    return series.orderBy(F.desc("diff"), "date").limit(k).select("date", "diff")


def verification_record(fund: DataFrame, index: DataFrame, threshold: float = 0.0001, k: int = 5) -> DataFrame:
    """One row: verify_index's, worst_days (the k largest differences with their dates) and error. Where
    nothing can be compared, error says why, differences are infinite, the rank correlation is 0 and
    the threshold is not met."""
    compared = stored(verification_series(fund, index))
    record = _verified(compared, fund, index, threshold)
    empty = (fund.agg(F.count("*")).scalar() == 0) | (index.agg(F.count("*")).scalar() == 0)
    error = F.when(empty, "empty data").when(F.col("n_days") == 0, "no common dates")
    none = error.isNotNull()
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("diff")).alias("less"), "date", "diff")))
    worst = worst_days(compared, k).agg(F.transform(ranked, lambda x: F.struct(x["date"].alias("date"), x["diff"].alias("diff"))).alias("w"))
    held = lambda c, other: F.when(none, F.lit(other)).otherwise(F.col(c)).alias(c)
    return record.select(
        held("max_diff", float("inf")), held("mean_diff", float("inf")), held("within_threshold", False), held("spearman", 0.0), "pearson", "n_days",
        "fund_missing", "index_missing", worst.scalar().alias("worst_days"), error.alias("error"),
    )


def reconcile(left: DataFrame, right: DataFrame, on: list[str], diff, threshold: float = 1e-4) -> DataFrame:
    """One row of statistics of diff(joined), over all matched rows and over those beyond the
    threshold, and the numbers of rows that only one side has. Null differences are not counted."""
    d = F.col("diff")
    beyond = F.when(F.abs(d) > threshold, d)
    stats = left.join(right, on).withColumn("diff", diff).agg(
        F.avg(d).alias("mean_diff"), F.min(d).alias("min_diff"), F.max(d).alias("max_diff"), F.count("*").alias("n_matched"),
        F.count(beyond).alias("n_beyond"), F.try_divide(F.count(beyond).cast("double"), F.count("*")).alias("share_beyond"),
        F.avg(beyond).alias("mean_beyond"), F.min(beyond).alias("min_beyond"), F.max(beyond).alias("max_beyond"),
    )
    count = lambda a, b: a.join(b, on, "left_anti").agg(F.count("*")).scalar()
    return stats.withColumns({"only_left": count(left, right), "only_right": count(right, left)})


def reconcile_returns(stated: DataFrame, prices: DataFrame, threshold: float = 1e-4, returns_after_merge: bool = True) -> DataFrame:
    """Stated returns (ticker, date, ret) against changes of prices (ticker, date, price); the changes
    are taken over the matched dates, or over all of the prices' own."""
    if returns_after_merge:
        matched = padded_returns(prices.join(stated.select("ticker", "date"), ["ticker", "date"], "left_semi"), "price", "change", "ticker")
        own = prices.join(matched.select("ticker", "date", "change"), ["ticker", "date"], "left")
    else:
        own = padded_returns(prices, "price", "change", "ticker")
    return reconcile(stated, own, ["ticker", "date"], F.col("ret") - F.col("change"), threshold)


def compare_prices(left: DataFrame, right: DataFrame, a: str, b: str, on: list[str]) -> DataFrame:
    """One row: mean and largest percentage difference and the correlation on matched rows."""
    pct = F.try_divide(F.col(a) - F.col(b), F.col(b)) * 100
    return left.join(right, on).agg(
        F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_diff"), F.avg(pct).alias("mean_pct"), F.max(pct).alias("max_pct"),
        pearson(F.col(a), F.col(b)).alias("pearson"), F.count("*").alias("n_matched"),
    )


def price_differences(left: DataFrame, right: DataFrame, a: str, b: str, on: list[str]) -> DataFrame:
    """The keys, diff and pct of matched rows: what a chart of price differences shows."""
    diff = F.col(a) - F.col(b)
    return left.join(right, on).select(*on, diff.alias("diff"), (F.try_divide(diff, F.col(b)) * 100).alias("pct"))


def strategy_returns(values: DataFrame, a: str, b: str) -> DataFrame:
    """date, a, b: two portfolios' daily returns on their common dates."""
    r = padded_returns(values, "portfolio_value", "r", "portfolio_id").where(F.col("r").isNotNull())
    one = lambda p, n: r.where(F.col("portfolio_id") == p).select("date", F.col("r").alias(n))
    return one(a, "a").join(one(b, "b"), "date")


def strategy_curves(values: DataFrame, a: str, b: str) -> DataFrame:
    """date, growth_a, growth_b, diff: both portfolios' growth over their common dates, and the
    difference of the day's returns: what charts of a comparison show."""
    grown = scan(stored(strategy_returns(values, a, b)), "date", {"growth_a": ("product", 1 + F.col("a")), "growth_b": ("product", 1 + F.col("b"))})
    return grown.select("date", "growth_a", "growth_b", (F.col("a") - F.col("b")).alias("diff"))


def compare_strategies(values: DataFrame, a: str, b: str) -> DataFrame:
    """One row for two portfolios' daily returns on common dates: correlation, spreads, final growth."""
    both = stored(strategy_returns(values, a, b))
    return both.agg(
        F.count("*").alias("n_days"), F.stddev_samp("a").alias("std_a"), F.stddev_samp("b").alias("std_b"),
        F.stddev_samp(F.col("a") - F.col("b")).alias("std_diff"),
        (F.product(1 + F.col("a")) - 1).alias("final_a"), (F.product(1 + F.col("b")) - 1).alias("final_b"),
    ).withColumn("spearman", spearman(both, "a", "b").scalar())
