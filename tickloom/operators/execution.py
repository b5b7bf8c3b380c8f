"""Backtest execution: which orders run, the fold over cash and holdings, and marking to market.

Orders of whole shares are windows as long as the cash does not bind. From the first order that it
refuses on, the rest is a fold, sequential within a portfolio: its orders and the prices of their
days pass through a task in order, with the cash and the holdings as the only state. Daily holdings
and values are windows and joins over all portfolios.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import by_date, ffill
from tickloom.sources.files import stored

from .align import as_of


@dataclass
class BacktestResult:
    """values: portfolio_id, date, portfolio_value; cash: portfolio_id, date, cash; holdings:
    portfolio_id, date, ticker, quantity, from a ticker's first order on; ledger: executed orders."""

    values: DataFrame
    cash: DataFrame
    holdings: DataFrame
    ledger: DataFrame


class Engine(ABC):
    """Subclass to change execution; run() returns at least values."""

    def __init__(self, initial_cash: float = 100_000) -> None:
        self.initial_cash = initial_cash

    @abstractmethod
    def run(self, orders: DataFrame, panel: DataFrame) -> BacktestResult: ...


#: seq's so many apart fall in different stretches of an order list, which are looked at side by side.
STRETCH = 100_000


def executable(orders: DataFrame, calendar: DataFrame, policy: str = "cursor") -> DataFrame:
    """Orders that come to be executed.

    ``cursor``: the list is read along the calendar, so an order on a day without trade, or dated
    before its predecessor, holds up all that follow. ``sorted``: orders run by date, and only
    those on other days are dropped. ``snap``: orders run by date, those on other days on the next
    day with trade; only those after the last one are dropped.

    A list is never sorted whole: each stretch of it gives its first bad order and its two ends'
    dates, and the least of these, with those between stretches, is where the list stops."""
    known = orders.join(calendar.select("date").distinct().withColumn("trades", F.lit(True)), "date", "left").withColumn("trades", F.coalesce("trades", F.lit(False)))
    if policy == "snap":
        return snapped(orders, calendar)
    if policy == "sorted":
        return known.where("trades").drop("trades")
    cut = known.select("portfolio_id", "seq", "date", "trades", F.floor(F.col("seq") / STRETCH).alias("stretch"))
    earlier = F.lag("date").over(Window.partitionBy("portfolio_id", "stretch").orderBy("seq"))
    bad = ~F.col("trades") | F.coalesce(F.col("date") < F.col("earlier"), F.lit(False)) | F.col("date").isNull()
    parts = cut.withColumn("earlier", earlier).groupBy("portfolio_id", "stretch").agg(
        F.min(F.when(bad, F.col("seq"))).alias("bad"), F.min("seq").alias("head"), F.min_by("date", "seq").alias("head_date"), F.max_by("date", "seq").alias("tail_date")
    )
    before = F.lag("tail_date").over(Window.partitionBy("portfolio_id").orderBy("stretch"))
    back = F.when(F.col("head_date") < F.col("before"), F.col("head"))
    stops = parts.withColumn("before", before).groupBy("portfolio_id").agg(F.min(F.least("bad", back)).alias("stop"))
    return orders.join(stops, "portfolio_id", "left").where("stop IS NULL OR seq < stop").drop("stop")


def snapped(orders: DataFrame, calendar: DataFrame) -> DataFrame:
    """orders with each date moved to the first day of the calendar at or after it; none where there is no such day."""
    asked = orders.select("date").distinct()
    days = as_of(asked, calendar.select("date").distinct(), [], [], direction="forward").where(F.col("as_of_date").isNotNull())
    moved = orders.join(days, "date").withColumn("date", F.col("as_of_date"))
    return moved.select(orders.columns)


class Book:
    """One portfolio's cash and holdings while its orders run.

    Orders at a null price: a BUY is not filled, and a SELL makes the cash unknown from then on. A
    fraction of an unknown value buys nothing."""

    def __init__(self, cash: float) -> None:
        self.cash, self.held, self.date, self.prices, self.opening = cash, {}, None, {}, None

    def open(self, date: object) -> None:
        self.date, self.prices, self.opening = date, {}, None

    def execute(self, side: str, ticker: str, quantity: float, sizing: str, price: float) -> float | None:
        """The change of the holding; None if the order is not filled."""
        if self.opening is None:
            self.opening = self.cash + sum(n * self.prices.get(t, float("nan")) for t, n in self.held.items())
        if side == "BUY":
            if sizing == "pct":
                if not price or price != price or self.opening != self.opening:
                    return None
                quantity = self.opening * quantity // price
            return self._fill(ticker, quantity, price) if self.cash >= price * quantity else None
        held = self.held.get(ticker, 0.0)
        return self._fill(ticker, -min(float(int(held * quantity)) if sizing == "pct" else quantity, held), price)

    def _fill(self, ticker: str, change: float, price: float) -> float:
        self.cash -= price * change
        self.held[ticker] = self.held.get(ticker, 0.0) + change
        return change


def priced(orders: DataFrame, panel: DataFrame) -> DataFrame:
    """orders with the price of their ticker and day as adj_close, null where there is none."""
    known = panel.select("date", "ticker", "adj_close").where(F.col("adj_close").isNotNull())
    return orders.join(known, ["date", "ticker"], "left").withColumn("amount", F.col("quantity").cast("double"))


def unbound(orders: DataFrame, initial_cash: float) -> DataFrame:
    """Priced orders with what they would do if cash never bound: change, held and cash after each, and
    ``stops`` where that is no longer known: at a BUY that the cash would refuse, and at orders that
    windows can't say exactly (fractions of a portfolio or a holding, quantities that are not whole,
    sales at an unknown price).

    A holding is a running sum that sales can't take below 0: the sum less its least value so far.
    Quantities are whole numbers, so the sums are exact, and cash is summed in the fold's order."""
    known = F.col("adj_close").isNotNull()
    buy = F.col("side") == "BUY"
    flow = F.when(~buy, -F.col("amount")).when(known, F.col("amount")).otherwise(F.lit(0.0))
    of_ticker = Window.partitionBy("portfolio_id", "ticker").orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = orders.withColumn("total", F.sum(flow).over(of_ticker))
    rows = rows.withColumn("held", F.col("total") - F.least(F.lit(0.0), F.min("total").over(of_ticker)))
    last = Window.partitionBy("portfolio_id", "ticker").orderBy("date", "seq")
    rows = rows.withColumn("change", F.col("held") - F.lag("held", 1, 0.0).over(last)).drop("total")
    of_book = Window.partitionBy("portfolio_id").orderBy("date", "seq")
    paid = F.coalesce(F.col("change") * F.col("adj_close"), F.lit(0.0))
    # the first row's flow starts from the initial cash, as the fold does
    flows = rows.withColumn("flow", F.when(F.row_number().over(of_book) == 1, F.lit(float(initial_cash)) - paid).otherwise(-paid))
    flows = flows.withColumn("cash", F.sum("flow").over(of_book.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("cash", 1, float(initial_cash)).over(of_book)
    vague = (F.col("sizing") == "pct") | (F.col("amount") != F.floor("amount")) | ~F.col("amount").between(0, 2**40) | F.col("amount").isNull() | (~buy & ~known)
    refused = buy & known & (before < F.col("adj_close") * F.col("amount"))
    return flows.withColumn("stops", vague | refused).drop("flow")


def events(orders: DataFrame, panel: DataFrame, initial_cash: float) -> tuple[DataFrame, DataFrame]:
    """What orders did as long as the cash did not bind, and what the fold reads of the rest.

    The first is all of a portfolio's executed orders before its first row that ``stops``. The fold
    reads the orders from there on, led by rows without a date that hold the cash and holdings at
    that point. Only BUYs of a fraction need the portfolio's value: the orders of their days are
    led by the prices of the tickers that the portfolio trades. A portfolio that never stops sends
    nothing to the fold."""
    rows = stored(unbound(priced(orders, panel), initial_cash))
    at = F.struct("date", "seq")
    stops = rows.where("stops").groupBy("portfolio_id").agg(F.min(at).alias("stop"))
    rows = rows.join(stops, "portfolio_id", "left")
    done = rows.where(F.col("stop").isNull() | (at < F.col("stop")))
    rest = rows.where(at >= F.col("stop"))
    settled = done.where((F.col("side") != "BUY") | F.col("adj_close").isNotNull()).select("portfolio_id", "seq", "date", "ticker", "change", "cash")

    columns = ["portfolio_id", "date", "seq", "ticker", "side", "amount", "sizing", "adj_close"]
    started = done.where(F.col("stop").isNotNull())
    held = started.groupBy("portfolio_id", "ticker").agg(F.max_by("held", at).alias("amount")).withColumn("side", F.lit("HELD"))
    cash = started.groupBy("portfolio_id").agg(F.max_by("cash", at).alias("amount")).withColumns({"side": F.lit("CASH"), "ticker": F.lit(None).cast("string")})
    state = held.unionByName(cash).withColumns({"date": F.lit(None).cast("date"), "seq": F.lit(-1).cast("long"), "sizing": F.lit(None).cast("string"), "adj_close": F.lit(None).cast("double")})
    # prices are joined to the traded tickers before the days: no row is made for a ticker that a portfolio never had
    known = panel.select("date", "ticker", "adj_close").where(F.col("adj_close").isNotNull())
    days = rest.where("sizing = 'pct' AND side = 'BUY'").select("portfolio_id", "date").distinct()
    traded = orders.select("portfolio_id", "ticker").distinct()
    prices = traded.join(known, "ticker").join(days, ["portfolio_id", "date"], "left_semi")
    prices = prices.withColumns({"seq": F.lit(-1).cast("long"), "side": F.lit(None).cast("string"), "amount": F.lit(None).cast("double"), "sizing": F.lit(None).cast("string")})
    return settled, state.select(columns).unionByName(prices.select(columns)).unionByName(rest.select(columns))


def fold(orders: DataFrame, panel: DataFrame, initial_cash: float) -> DataFrame:
    """portfolio_id, seq, date, ticker, change, cash: what each executed order did, by date, then seq. Windows
    do it up to the first order that the cash refuses; from there on a task reads its portfolios'
    events sorted, batch by batch."""
    names = ["portfolio_id", "seq", "date", "ticker", "change", "cash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, portfolio, first = Book(initial_cash), None, True
        for batch in batches:
            out: list[tuple] = []
            for owner, date, seq, ticker, side, amount, sizing, price in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if first or owner != portfolio:
                    book, portfolio, first = Book(initial_cash), owner, False
                if side == "CASH":
                    book.cash = amount
                    continue
                if side == "HELD":
                    book.held[ticker] = amount
                    continue
                if date != book.date:
                    book.open(date)
                if side is None:
                    book.prices[ticker] = price
                elif (change := book.execute(side, ticker, amount, sizing, float("nan") if price is None else price)) is not None:
                    out.append((owner, seq, date, ticker, change, book.cash))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.date32(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    settled, left = events(orders, panel, initial_cash)
    ordered = left.repartition("portfolio_id").sortWithinPartitions("portfolio_id", "date", "seq")
    return settled.unionByName(ordered.mapInArrow(run, "portfolio_id string, seq long, date date, ticker string, change double, cash double"))


class EquityEngine(Engine):
    """Long only, no costs: a BUY is filled whole or not at all, a SELL up to what is held."""

    def __init__(self, initial_cash: float = 100_000, policy: str = "cursor", null_price: str = "propagate") -> None:
        super().__init__(initial_cash)
        self.policy, self.null_price = policy, null_price

    def run(self, orders: DataFrame, panel: DataFrame) -> BacktestResult:
        """A null price of a ticker held makes that day's value null; ``null_price='ffill'`` uses the last price."""
        if self.null_price == "ffill":
            panel = panel.withColumn("adj_close", ffill(F.col("adj_close"), by_date()))
        calendar = panel.agg(F.sort_array(F.collect_set("date"))).scalar()
        # cash and holdings both read the ledger: the fold runs once
        ledger = stored(fold(executable(orders, panel, self.policy), panel, self.initial_cash))

        daily = ledger.groupBy("portfolio_id", "ticker", "date").agg(F.sum("change").alias("change"))
        spans = daily.groupBy("portfolio_id", "ticker").agg(F.min("date").alias("first_date"))
        grid = spans.withColumn("date", F.explode(calendar)).where("date >= first_date").drop("first_date")
        held = Window.partitionBy("portfolio_id", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        holdings = grid.join(daily, ["portfolio_id", "ticker", "date"], "left").withColumn("quantity", F.sum(F.coalesce("change", F.lit(0.0))).over(held)).drop("change")

        last_cash = ledger.groupBy("portfolio_id", "date").agg(F.max_by("cash", "seq").alias("cash"))
        portfolios = orders.select("portfolio_id").distinct().withColumn("date", F.explode(calendar))
        cash = portfolios.join(last_cash, ["portfolio_id", "date"], "left")
        cash = cash.withColumn("cash", F.coalesce(ffill(F.col("cash"), by_date("portfolio_id")), F.lit(float(self.initial_cash))))
        cash = cash.withColumn("cash", F.when(~F.isnan("cash"), F.col("cash")))

        priced = holdings.join(panel.select("date", "ticker", "adj_close"), ["date", "ticker"], "left")
        worth = priced.groupBy("portfolio_id", "date").agg(
            F.when(F.count("adj_close") == F.count("*"), F.sum(F.col("quantity") * F.col("adj_close"))).alias("worth"), F.lit(True).alias("held")
        )
        values = cash.join(worth, ["portfolio_id", "date"], "left").select(
            "portfolio_id", "date", (F.col("cash") + F.when(F.col("held"), F.col("worth")).otherwise(F.lit(0.0))).alias("portfolio_value")
        )
        return BacktestResult(values, cash, holdings, ledger)
