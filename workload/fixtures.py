"""Inputs the queries share, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacast.functions.series import in_order, lagged
from stratacast.operators.future import future_per_series
from stratacast.operators.splits import cv_windows
from stratacast.plans.design import Design
from stratacast.plans.training import training_frame
from stratacast.schemas import LagSpec
from stratacast.sources.bars import nation_bars, nation_directory
from stratacast.sources.scratch import new_folder
from stratacast.sources.tables import load_table, save_table

SIMPLE = ["naive", "mean5"]
NO_LAGS = LagSpec((), (), (), (), (), (), ())
TWO_LAGS = Design(lag_spec=LagSpec((1, 5), (), (), (), (), (), ()), exogenous=(), technical_shift=0)
ONE_LAG = Design(lag_spec=LagSpec((1,), (), (), (), (), (), ()), exogenous=(), technical_shift=0)
MONTH_END = Design(lag_spec=NO_LAGS, exogenous=("is_month_end",), technical_shift=0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sectors(spark: SparkSession, folder: str) -> DataFrame:
    return nation_directory(spark, folder).select(F.col("ticker").alias("unique_id"), "sector")


def training(spark: SparkSession, folder: str, target_type: str = "log_return") -> DataFrame:
    return training_frame(nation_bars(spark, folder), sectors(spark, folder), target_type, unique=True)


def stored(frame: DataFrame, label: str) -> DataFrame:
    """`frame` written and read back, for queries that pass over it more than once."""
    path = new_folder(frame.sparkSession, label)
    save_table(frame, path)
    return load_table(frame.sparkSession, path)


def stored_training(spark: SparkSession, folder: str) -> DataFrame:
    return stored(training(spark, folder), "training")


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Uncleansed bars: one per line item, with text in a price column and zero volumes."""
    lines, supplier, nation = (table(spark, folder, t) for t in ("lineitem", "supplier", "nation"))
    joined = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    price = F.col("l_extendedprice") / F.col("l_quantity")
    reopened = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    return joined.select(
        F.lower("n_name").alias("unique_id"),
        F.col("l_shipdate").alias("ds"),
        F.when(reopened, F.col("l_returnflag")).otherwise(price.cast("string")).alias("open"),
        (price * (1 + F.col("l_tax"))).alias("high"),
        (price * (1 - F.col("l_discount"))).alias("low"),
        price.alias("close"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")).alias("volume"),
    )


def simple_fit(panel: DataFrame) -> DataFrame:
    """In-sample columns of two stand-in models: last value, and mean of the last five."""
    return panel.select(
        "unique_id", "ds", "y", "close",
        lagged("y", 1).alias("naive"),
        F.avg("y").over(in_order().rowsBetween(-5, -1)).alias("mean5"),
    )


def simple_ahead(panel: DataFrame) -> DataFrame:
    """Future columns of the two stand-in models."""
    last = panel.groupBy("unique_id").agg(
        F.max_by("y", F.col("ds")).alias("_last"), F.avg("y").alias("mean5")
    )
    return future_per_series(panel, 14).join(last, "unique_id").withColumn(
        "naive", F.col("_last") / F.col("step")
    ).select("unique_id", "ds", "step", *SIMPLE)


def simple_cv(panel: DataFrame) -> DataFrame:
    fitted = simple_fit(panel)
    return cv_windows(fitted, 2, 14, 7).filter("role = 'test'")


def universe(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("position"), F.concat(F.lower("c_name"), F.lit(".us")).alias("ticker")
    )


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in credit; the others stand for tickers that the company list does not know."""
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.filter("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.upper("c_name").alias("ticker"), F.col("c_name").alias("name"), F.col("n_name").alias("sector")
    )


def customer_days(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.upper("c_name"), F.lit(".US")).alias("unique_id"),
        F.col("o_orderdate").cast("date").alias("ds"),
        F.col("o_totalprice").alias("close"),
    )
