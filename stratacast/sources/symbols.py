"""Ticker and vendor-symbol spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticker_to_symbol(ticker: Column) -> Column:
    """`aapl.us` -> `AAPL`."""
    return F.upper(F.regexp_replace(ticker, r"(?i)\.us$", ""))


def symbol_to_ticker(symbol: Column) -> Column:
    """`aapl` -> `AAPL.US`."""
    return F.concat(F.upper(symbol), F.lit(".US"))


def company_key(ticker: Column) -> Column:
    """Join key for company lookups: no market suffix, share classes dotted."""
    return F.replace(ticker_to_symbol(ticker), F.lit("-"), F.lit("."))
