"""Strategies: from a price panel to an order table.

Orders are rows (portfolio_id, seq, date, side, ticker, quantity, sizing). seq is the place in the
order list: tickers in order, then dates; it is computed without a global sort. sizing is
``shares``, or ``pct`` for a fraction of the portfolio's value (BUY) or of the holding (SELL).
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scans import with_rolling, with_rolling_beta
from tickloom.functions.series import by_date, month_ends, padded_returns, returns

#: Orders of one list position at most: dates count days, so tickers are this far apart.
DAYS = 100_000


class Strategy(ABC):
    """Subclass and implement orders(); register the class in STRATEGIES to select it by name.

    ``panel.transform(strategy.orders)`` composes with further DataFrame operations."""

    @abstractmethod
    def orders(self, panel: DataFrame) -> DataFrame:
        """panel: ticker, date, adj_close, one row for each (ticker, date)."""


def day_number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long")


def ticker_major(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """seq by ticker, then date. Only the distinct tickers are ranked in one task."""
    ordinal = panel.select("ticker").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("ticker")))
    return rows.join(ordinal, "ticker").withColumn("seq", F.col("ordinal") * F.lit(DAYS).cast("long") + day_number(F.col("date"))).drop("ordinal")


def order_rows(rows: DataFrame, portfolio: Column) -> DataFrame:
    return rows.select(portfolio.alias("portfolio_id"), "seq", "date", "side", "ticker", "quantity", "sizing")


def reads_as_fraction(quantity: Column) -> Column:
    """The compatible reading of a fractional quantity: one of at most 1 is a fraction."""
    return F.when((quantity > 0) & (quantity <= 1), F.lit("pct")).otherwise(F.lit("shares"))


class MeanReversion(Strategy):
    """Every day with a full window: buy below the moving mean, else sell. Null prices are skipped."""

    def __init__(self, window: int = 100, shares: float = 100, portfolio: Column | None = None) -> None:
        self.window, self.shares, self.portfolio = window, shares, F.lit("mean_reversion") if portfolio is None else portfolio

    def orders(self, panel: DataFrame) -> DataFrame:
        rows = with_rolling(panel, {"mean": ("avg", F.col("adj_close"))}, self.window).where(F.col("mean").isNotNull())
        rows = rows.withColumns({
            "side": F.when(F.col("adj_close") < F.col("mean"), "BUY").otherwise("SELL"),
            "quantity": F.lit(float(self.shares)), "sizing": F.lit("shares"),
        })
        return order_rows(ticker_major(rows, panel), self.portfolio)


def with_bands(panel: DataFrame, window: int) -> DataFrame:
    """panel with high and low of the ``window`` rows before each row, not counting it."""
    return with_rolling(panel, {"high": ("max", F.col("adj_close")), "low": ("min", F.col("adj_close"))}, window, 1)


def latched(rows: DataFrame, enter: Column, leave: Column, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """rows with in_position after each: entered when out, left when in.

    A row that allows only one of both settles the state, one that allows both flips it and one
    that allows neither keeps it; so the state is the last settled one plus the flips since."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    settles, flips = enter != leave, F.sum((enter & leave).cast("int")).over(w)
    out = rows.withColumns({"_settled": F.when(settles, enter.cast("int")), "_flips": flips})
    out = out.withColumns({
        "_state": F.coalesce(F.last("_settled", ignorenulls=True).over(w), F.lit(0)),
        "_before": F.coalesce(F.last(F.when(F.col("_settled").isNotNull(), F.col("_flips")), ignorenulls=True).over(w), F.lit(0)),
    })
    return out.withColumn("in_position", (F.col("_state") + F.col("_flips") - F.col("_before")) % 2).drop("_settled", "_flips", "_state", "_before")


class Momentum(Strategy):
    """Enter near the band's high with a fraction of the portfolio, leave near its low."""

    def __init__(self, window: int = 125, threshold: float = 0.02, fraction: float = 0.3, portfolio: Column | None = None) -> None:
        self.window, self.threshold, self.fraction = window, threshold, fraction
        self.portfolio = F.lit("momentum") if portfolio is None else portfolio

    def orders(self, panel: DataFrame) -> DataFrame:
        rows = with_bands(panel, self.window).dropna(subset=["adj_close", "high", "low"])
        enter = F.col("adj_close") >= F.col("high") * (1 - self.threshold)
        leave = F.col("adj_close") <= F.col("low") * (1 + self.threshold)
        rows = latched(rows, enter, leave)
        changed = F.col("in_position") != F.lag("in_position", 1, 0).over(by_date())
        rows = rows.withColumn("changed", changed).where("changed").withColumns({
            "side": F.when(F.col("in_position") == 1, "BUY").otherwise("SELL"),
            "quantity": F.when(F.col("in_position") == 1, F.lit(self.fraction)).otherwise(F.lit(1.0)), "sizing": F.lit("pct"),
        })
        return order_rows(ticker_major(rows, panel), self.portfolio)


class BettingAgainstBeta(Strategy):
    """At month ends buy the tickers of lowest beta and sell those of highest, each leg weighted by
    the other's mean beta. market: date, adj_close. No orders with under ``least`` betas on a date."""

    def __init__(self, market: DataFrame, lookback: int = 60, start_value: float = 100_000, least: int = 20, decile: float = 0.1) -> None:
        self.market, self.lookback, self.start_value, self.least, self.decile = market, lookback, start_value, least, decile

    def joined_returns(self, panel: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Market returns with gaps filled, and stock returns without, on the market's dates."""
        market = padded_returns(self.market.withColumn("ticker", F.lit("market")), "adj_close", "market", "ticker")
        market = market.where(F.col("market").isNotNull()).select("date", "market")
        stock = panel.withColumn("stock", returns(F.col("adj_close"), by_date())).where(F.col("stock").isNotNull())
        return market, stock.select("ticker", "date", "stock").join(market, "date")

    def betas(self, panel: DataFrame) -> DataFrame:
        """rebalance_date, ticker, beta: the slope over the last ``lookback`` common returns."""
        market, rows = self.joined_returns(panel)
        dates = market.agg(F.sort_array(F.collect_list("date")).alias("d")).select(
            F.struct(F.get("d", F.lit(self.lookback)).alias("first"), F.array_max("d").alias("last"))
        ).scalar()
        w = by_date()
        rows = with_rolling_beta(rows, "stock", "market", self.lookback)
        rows = rows.withColumns({"n": F.row_number().over(w), "following": F.lead("date").over(w)}).withColumn("bounds", dates)
        upto = F.coalesce(F.date_sub("following", 1), F.col("bounds.last"))
        rows = rows.withColumn("rebalance_date", F.explode(month_ends(F.greatest("date", "bounds.first"), F.least(upto, "bounds.last"))))
        return rows.where(F.col("n") >= self.lookback).select("rebalance_date", "ticker", "beta")

    def orders(self, panel: DataFrame) -> DataFrame:
        day = Window.partitionBy("rebalance_date")
        rows = self.betas(panel).withColumn("n_all", F.count("*").over(day)).where((F.col("n_all") >= self.least) & F.col("beta").isNotNull())
        rows = rows.withColumns({
            "low": F.row_number().over(day.orderBy("beta", "ticker")), "high": F.row_number().over(day.orderBy(F.desc("beta"), F.desc("ticker"))),
            "k": F.greatest(F.floor(F.count("*").over(day) * self.decile), F.lit(1)),
        })
        rows = rows.withColumns({
            "mean_low": F.avg(F.when(F.col("low") <= F.col("k"), F.col("beta"))).over(day),
            "mean_high": F.avg(F.when(F.col("high") <= F.col("k"), F.col("beta"))).over(day),
        })
        total = F.col("mean_low") + F.col("mean_high")

        # places of a leg and of a day: further apart where a leg has more orders
        leg_room = rows.agg(F.greatest(F.lit(DAYS // 2), F.max("k") + 1)).scalar()

        def leg(side: str, chosen: str, weight: str) -> DataFrame:
            value = F.try_divide(F.col(weight), total) * self.start_value / F.col("k")
            first = F.lit(0) if side == "BUY" else leg_room
            return rows.where(F.col(chosen) <= F.col("k")).select(
                F.lit("bab").alias("portfolio_id"),
                (day_number(F.col("rebalance_date")) * 2 * leg_room + first + F.col("low")).alias("seq"),
                F.col("rebalance_date").alias("date"), F.lit(side).alias("side"), "ticker",
                F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("double").alias("quantity"), F.lit("shares").alias("sizing"),
            )

        return leg("BUY", "low", "mean_high").unionByName(leg("SELL", "high", "mean_low"))


def first_and_last(panel: DataFrame) -> DataFrame:
    """ticker, first_date, last_date, first_price: on the whole panel's first and last dates."""
    bounds = panel.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()
    rows = panel.withColumn("bounds", bounds)
    return rows.where(F.col("date") == F.col("bounds.first")).select("ticker", F.col("bounds.first").alias("first_date"), F.col("bounds.last").alias("last_date"), F.col("adj_close").alias("first_price"))


def _held(rows: DataFrame, portfolio: str, explicit_sizing: bool) -> DataFrame:
    """Buys on the first date, then sells of the same quantity on the last."""
    sizing = F.lit("shares") if explicit_sizing else reads_as_fraction(F.col("quantity"))
    sides = F.array(
        F.struct(F.lit("BUY").alias("side"), F.col("first_date").alias("date"), F.lit(0).alias("leg")),
        F.struct(F.lit("SELL").alias("side"), F.col("last_date").alias("date"), F.lit(1).alias("leg")),
    )
    rows = rows.where(F.col("quantity") > 0).withColumn("sizing", sizing)
    ordinal, listed = F.row_number().over(Window.orderBy("rid", "ticker")), F.count("*").over(Window.orderBy(F.lit(0)))
    out = rows.withColumns({"ordinal": ordinal, "room": F.greatest(F.lit(DAYS), listed + 1)}).withColumn("s", F.explode(sides)).select("*", "s.side", "s.date")
    return out.select(F.lit(portfolio).alias("portfolio_id"), (F.col("s.leg") * F.col("room") + F.col("ordinal")).alias("seq"), "date", "side", "ticker", "quantity", "sizing")


class WeightedHold(Strategy):
    """Buy and hold by weights, which are normalised over all holdings, priced or not. Of a ticker
    listed twice the first weight counts, once for each listing. holdings: ticker, weight and
    optionally rid, the listing's order."""

    def __init__(self, holdings: DataFrame, cash: float = 100_000, explicit_sizing: bool = False) -> None:
        self.holdings = holdings if "rid" in holdings.columns else holdings.withColumn("rid", F.lit(0))
        self.cash, self.explicit_sizing = cash, explicit_sizing

    def orders(self, panel: DataFrame) -> DataFrame:
        total = self.holdings.agg(F.sum("weight")).scalar()
        first = self.holdings.groupBy("ticker").agg(F.min_by("weight", "rid").alias("weight"))
        rows = self.holdings.select("ticker", "rid").join(first, "ticker").join(first_and_last(panel), "ticker")
        quantity = F.try_divide(F.lit(float(self.cash)) * F.try_divide("weight", total), F.col("first_price"))
        return _held(rows.withColumn("quantity", quantity), "weighted", self.explicit_sizing)


class SingleHold(Strategy):
    """Buy and hold one ticker."""

    def __init__(self, ticker: str, cash: float = 100_000, explicit_sizing: bool = False) -> None:
        self.ticker, self.cash, self.explicit_sizing = ticker, cash, explicit_sizing

    def orders(self, panel: DataFrame) -> DataFrame:
        rows = first_and_last(panel.where(F.col("ticker") == self.ticker)).withColumn("rid", F.lit(0))
        return _held(rows.withColumn("quantity", F.try_divide(F.lit(float(self.cash)), F.col("first_price"))), "single", self.explicit_sizing)


STRATEGIES: dict[str, type[Strategy]] = {
    "mean_reversion": MeanReversion, "momentum": Momentum, "betting_against_beta": BettingAgainstBeta, "weighted": WeightedHold, "single": SingleHold,
}
