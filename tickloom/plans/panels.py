"""Price panels, a benchmark, holdings and two vendors' prices derived from order-line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumn("date", F.to_date(F.date_trunc(unit, "l_shipdate")))
    brands = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    return lines.join(brands, "l_partkey")


def _price(amount: str | Column) -> Column:
    quantity = F.sum(F.col("l_quantity").cast(MONEY)).cast("double")
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.sum(amount.cast(MONEY)).cast("double") / quantity


def price_panel(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """ticker, date, adj_close, volume: a brand's mean unit price by week or day; sums are exact decimals."""
    return _lines(spark, sf_dir, unit).groupBy("ticker", "date").agg(
        _price("l_extendedprice").alias("adj_close"), F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("volume")
    )


def benchmark_prices(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """date, adj_close over all brands. Lines of unknown parts count for no brand, nor here."""
    return _lines(spark, sf_dir, unit).groupBy("date").agg(_price("l_extendedprice").alias("adj_close"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, weight in percent: a brand's share of all parts."""
    part = read(spark, sf_dir, "part")
    total = part.agg(F.count("*")).scalar()
    return part.groupBy(F.col("p_brand").alias("ticker")).agg(F.count("*").alias("n")).select("ticker", (F.lit(100.0) * F.col("n") / total).alias("weight"))


def vendor_prices(spark: SparkSession, sf_dir: str, vendor: str) -> DataFrame:
    """Two vendors' weekly prices, which differ in the lines they see and, for b, in discounts."""
    lines = _lines(spark, sf_dir, "week")
    if vendor == "a":
        own, amount = lines.where("l_returnflag <> 'A'"), F.col("l_extendedprice").cast(MONEY)
    else:
        own, amount = lines.where("l_returnflag <> 'N'"), F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast(MONEY))
    quantity = F.sum(F.col("l_quantity").cast(MONEY)).cast("double")
    return own.groupBy("ticker", "date").agg((F.sum(amount.cast("decimal(18,4)")).cast("double") / quantity).alias(f"price_{vendor}"))
