"""Daily bars from transaction tables, and bars of longer intervals.

Open and close are the prices of the first and last transaction in a stated
total order. Every aggregate here combines partially before the shuffle, so a
series or a day with very many transactions costs its shuffle one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacast.schemas import BAR_COLUMNS

INTERVALS = {"d": "day", "w": "week", "m": "month"}


def transactions_to_bars(
    df: DataFrame,
    unique_id: Column,
    day: Column,
    price: Column,
    size: Column,
    order: Sequence[str],
) -> DataFrame:
    """One bar per (unique_id, day)."""
    ranked = df.select(
        unique_id.alias("unique_id"),
        day.cast("date").alias("ds"),
        price.alias("_price"),
        size.cast("double").alias("_size"),
        F.struct(*order, price.alias("_price")).alias("_at"),
    )
    return ranked.groupBy("unique_id", "ds").agg(
        F.min("_at")["_price"].alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max("_at")["_price"].alias("close"),
        F.sum("_size").alias("volume"),
    )


def _tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in names]


LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
]


def _named(bars: DataFrame, nation: DataFrame) -> DataFrame:
    """Bars keyed by nation number to bars keyed by nation name.

    The dimension joins after the aggregation, when a row stands for a whole
    day of trades and the fact rows were grouped on an integer.
    """
    named = bars.join(nation, F.col("unique_id") == F.col("n_nationkey"))
    return named.withColumn("unique_id", F.upper("n_name"))


def nation_bars(spark: SparkSession, folder: str, with_sector: bool = False) -> DataFrame:
    """Line items as trades of their supplier's nation; the region is the sector."""
    lines, supplier, nation, region = _tables(spark, folder, "lineitem", "supplier", "nation", "region")
    bars = _named(transactions_to_bars(
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")),
        F.col("s_nationkey"), F.col("l_shipdate"),
        F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), LINE_ORDER,
    ), nation)
    if not with_sector:
        return bars.select(*BAR_COLUMNS)
    return bars.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        *BAR_COLUMNS, F.col("r_name").alias("sector")
    )


def brand_bars(spark: SparkSession, folder: str) -> DataFrame:
    lines, part = _tables(spark, folder, "lineitem", "part")
    return transactions_to_bars(
        lines.join(part, F.col("l_partkey") == F.col("p_partkey")),
        F.upper("p_brand"), F.col("l_shipdate"),
        F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), LINE_ORDER,
    )


def order_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as trades of their customer's nation; volume counts orders."""
    orders, customer, nation = _tables(spark, folder, "orders", "customer", "nation")
    return _named(transactions_to_bars(
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey")),
        F.col("c_nationkey"), F.col("o_orderdate"), F.col("o_totalprice"), F.lit(1.0), ["o_orderkey"],
    ), nation).select(*BAR_COLUMNS)


def event_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Events as ticks of their type; volume counts events."""
    (events,) = _tables(spark, folder, "events")
    return transactions_to_bars(
        events, F.upper("event_type"), F.col("ts"), F.col("value"), F.lit(1.0), ["ts", "event_id"],
    )


def nation_directory(spark: SparkSession, folder: str) -> DataFrame:
    """Company-style dimension: ticker, name, sector."""
    nation, region = _tables(spark, folder, "nation", "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.upper("n_name").alias("ticker"), F.initcap("n_name").alias("name"), F.col("r_name").alias("sector")
    )


def resample_bars(bars: DataFrame, interval: str) -> DataFrame:
    """Daily bars to weekly (`w`, Monday-dated) or monthly (`m`) bars; `d` keeps days."""
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}; expected one of {sorted(INTERVALS)}")
    period = F.date_trunc(INTERVALS[interval], F.col("ds")).cast("date")
    return bars.groupBy("unique_id", period.alias("ds")).agg(
        F.min_by("open", F.col("ds")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.col("ds")).alias("close"),
        F.sum("volume").alias("volume"),
    )
