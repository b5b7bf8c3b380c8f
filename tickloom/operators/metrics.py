"""Performance metrics of portfolios, one row for each."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import by_date, cumulative_return, drawdown, padded_returns
from tickloom.functions.stats import mean_or_null

from .execution import BacktestResult

#: Fixed values of the metrics' definitions.
TRADING_DAYS = 252
RISK_FREE = 0.0045


class Metrics(ABC):
    @abstractmethod
    def compute(self, result: BacktestResult, panel: DataFrame | None = None) -> DataFrame: ...


def value_returns(values: DataFrame) -> DataFrame:
    """portfolio_id, date, r: changes of value, gaps filled; the first date has none."""
    out = padded_returns(values, "portfolio_value", "r", "portfolio_id")
    return out.where(F.col("r").isNotNull()).select("portfolio_id", "date", "r")


def return_metrics(returns: DataFrame) -> DataFrame:
    year, excess = F.sqrt(F.lit(float(TRADING_DAYS))), F.col("r") - RISK_FREE / TRADING_DAYS
    return returns.groupBy("portfolio_id").agg(
        F.avg("r").alias("daily_return"),
        (F.coalesce(F.product(1 + F.col("r")), F.lit(1.0)) - 1).alias("cumulative_return"),
        F.avg(F.ln(F.when(F.col("r") > -1, 1 + F.col("r")))).alias("log_return"),
        (F.stddev_samp("r") * year).alias("volatility"),
        (F.try_divide(F.avg(excess), F.stddev_samp(excess)) * year).alias("sharpe_ratio"),
    )


def max_drawdown(values: DataFrame) -> DataFrame:
    down = values.withColumn("drawdown", drawdown(F.col("portfolio_value"), by_date("portfolio_id")))
    return down.groupBy("portfolio_id").agg(F.min("drawdown").alias("max_drawdown"))


def daily_turnover(result: BacktestResult, panel: DataFrame) -> DataFrame:
    """portfolio_id, date, turnover: value traded at the day's prices by the value on the day
    before; 0 where that is unknown or not positive, null where the trade's price is."""
    days = Window.partitionBy("portfolio_id", "ticker").orderBy("date")
    held = result.holdings.join(panel.select("date", "ticker", "adj_close"), ["date", "ticker"], "left")
    held = held.withColumns({
        "was": F.coalesce(F.lag("quantity").over(days), F.lit(0.0)), "was_price": F.lag("adj_close").over(days), "earlier": F.lag("date").over(days).isNotNull(),
    })
    traded = F.abs(F.col("quantity") - F.col("was")) * F.col("adj_close")
    sums = held.groupBy("portfolio_id", "date").agg(
        F.when(F.count(traded) == F.count("*"), F.sum(traded)).alias("traded"),
        F.when(F.count_if(F.col("earlier") & F.col("was_price").isNull()) == 0, F.sum(F.when(F.col("earlier"), F.col("was") * F.col("was_price")).otherwise(F.lit(0.0)))).alias("was_worth"),
        F.lit(True).alias("held"),
    )
    own = Window.partitionBy("portfolio_id").orderBy("date")
    cash = result.cash.withColumns({"was_cash": F.lag("cash").over(own), "n": F.row_number().over(own)}).where("n > 1")
    joined = cash.join(sums, ["portfolio_id", "date"], "left")
    base = F.col("was_cash") + F.when(F.col("held"), F.col("was_worth")).otherwise(F.lit(0.0))
    traded = F.when(F.col("held"), F.col("traded")).otherwise(F.lit(0.0))
    return joined.select("portfolio_id", "date", F.when(base > 0, F.try_divide(traded, base)).otherwise(F.lit(0.0)).alias("turnover"))


class ExtendedMetrics(Metrics):
    """Returns, risk, drawdown and, given the panel, turnover (null with under two dates). By their
    definitions average_turnover is the mean of a day's, and daily_turnover that times a year's days."""

    def compute(self, result: BacktestResult, panel: DataFrame | None = None) -> DataFrame:
        out = max_drawdown(result.values).join(return_metrics(value_returns(result.values)), "portfolio_id", "left")
        out = out.withColumn("cumulative_return", F.coalesce("cumulative_return", F.lit(0.0)))
        if panel is None:
            return out.withColumns({"average_turnover": F.lit(None).cast("double"), "daily_turnover": F.lit(None).cast("double")})
        mean = daily_turnover(result, panel).groupBy("portfolio_id").agg(mean_or_null(F.col("turnover")).alias("average_turnover"))
        return out.join(mean, "portfolio_id", "left").withColumn("daily_turnover", F.col("average_turnover") * TRADING_DAYS)


def return_curves(values: DataFrame, benchmark: DataFrame) -> DataFrame:
    """portfolio_id, date, cumulative, benchmark_cumulative: what a chart of both shows. benchmark:
    date, r; days without one count as no change."""
    both = value_returns(values).join(benchmark.select("date", F.col("r").alias("b")), "date", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    w = by_date("portfolio_id")
    return both.select("portfolio_id", "date", cumulative_return(F.col("r"), w).alias("cumulative"), cumulative_return(F.col("b"), w).alias("benchmark_cumulative"))


def final_values(values: DataFrame) -> DataFrame:
    return values.groupBy("portfolio_id").agg(F.max_by("portfolio_value", "date").alias("final_value"))
