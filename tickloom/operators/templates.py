"""Templates to copy: a strategy and an engine with the least that each needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.files import stored

from .execution import BacktestResult, Engine, fold
from .strategies import Strategy, order_rows, ticker_major


class TemplateStrategy(Strategy):
    """Buys ``shares`` of every ticker on its first date. Change the rows that orders() keeps and their
    side, quantity and sizing; order_rows() and ticker_major() give what all strategies share. Use:

    ``STRATEGIES["mine"] = TemplateStrategy`` or ``panel.transform(TemplateStrategy().orders)``.
    """

    def __init__(self, shares: float = 1.0) -> None:
        self.shares = shares

    def orders(self, panel: DataFrame) -> DataFrame:
        rows = panel.where(F.col("adj_close").isNotNull()).groupBy("ticker").agg(F.min("date").alias("date"))
        rows = rows.withColumns({"side": F.lit("BUY"), "quantity": F.lit(float(self.shares)), "sizing": F.lit("shares")})
        return order_rows(ticker_major(rows, panel), F.lit("template"))


class TemplateEngine(Engine):
    """Executes all orders by date and reports the cash left after each order day as the value. Override
    run() to price holdings or charge costs; fold() gives the executed orders of all portfolios."""

    def run(self, orders: DataFrame, panel: DataFrame) -> BacktestResult:
        ledger = stored(fold(orders, panel, self.initial_cash))
        cash = ledger.groupBy("portfolio_id", "date").agg(F.max_by("cash", "seq").alias("cash"))
        return BacktestResult(cash.withColumnRenamed("cash", "portfolio_value"), cash, ledger.select("portfolio_id", "date", "ticker", F.col("change").alias("quantity")), ledger)
