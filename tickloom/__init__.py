"""Backtesting, market-data-quality and corpus-preparation operators on Spark DataFrames."""
