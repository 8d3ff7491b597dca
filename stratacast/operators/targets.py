"""Targets from closes, and prices back from predicted targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacast.functions.series import so_far, lagged
from stratacast.schemas import check_target_type


def target(target_type: str, close: Column | str = "close") -> Column:
    """The target of each row; the first row of a series has return 0."""
    check_target_type(target_type)
    close = F.col(close) if isinstance(close, str) else close
    if target_type == "price":
        return close
    before = lagged(close, 1)
    change = F.ln(close / before) if target_type == "log_return" else close / before - 1
    return F.coalesce(change, F.lit(0.0))


def add_target(df: DataFrame, target_type: str = "log_return") -> DataFrame:
    return df.withColumn("y", target(target_type))


def last_prices(df: DataFrame) -> DataFrame:
    """(unique_id, last_price, last_ds) by date, not by row order."""
    return df.groupBy("unique_id").agg(
        F.max_by("close", F.col("ds")).alias("last_price"), F.max("ds").alias("last_ds")
    )


def running_product(factor: Column) -> Column:
    """Product of `factor` from the start of the series.

    Spark has no product window. Logs of magnitudes are summed; signs and
    zeros are counted, because a return below -1 makes a factor negative.
    """
    zeros = F.count_if(factor == 0).over(so_far())
    negatives = F.count_if(factor < 0).over(so_far())
    size = F.exp(F.sum(F.ln(F.when(factor != 0, F.abs(factor)))).over(so_far()))
    signed = F.when(negatives % 2 == 1, -size).otherwise(size)
    return F.when(factor.isNull(), None).when(zeros > 0, 0.0).otherwise(F.coalesce(signed, F.lit(1.0)))


def path_price(target_type: str, predicted: Column, base: Column) -> Column:
    """Price path of a forecast: `base` compounded by the predictions so far."""
    check_target_type(target_type)
    if target_type == "price":
        return predicted
    if target_type == "log_return":
        grown = F.when(predicted.isNotNull(), F.exp(F.sum(predicted).over(so_far())))
    else:
        grown = running_product(1 + predicted)
    return base * grown


def reconstruct_prices(
    predictions: DataFrame,
    prices: DataFrame,
    models: Sequence[str],
    target_type: str,
    default_price: float = 1.0,
) -> DataFrame:
    """Turn every model's predicted targets along the horizon into prices."""
    if check_target_type(target_type) == "price":
        return predictions
    based = predictions.join(
        prices.select("unique_id", F.col("last_price").alias("_base")), "unique_id", "left"
    ).withColumn("_base", F.coalesce("_base", F.lit(default_price)))
    paths = {m: path_price(target_type, F.col(m), F.col("_base")) for m in models}
    return based.withColumns(paths).drop("_base")


def one_step_price(target_type: str, predicted: Column, base: Column) -> Column:
    check_target_type(target_type)
    if target_type == "price":
        return predicted
    return base * (F.exp(predicted) if target_type == "log_return" else 1 + predicted)


def reconstruct_fitted_prices(
    fitted: DataFrame,
    history: DataFrame,
    models: Sequence[str],
    target_type: str,
    default_price: float = 1.0,
) -> DataFrame:
    """In-sample predictions as prices, each from the close observed the day before."""
    if check_target_type(target_type) == "price":
        return fitted
    bases = history.select(
        "unique_id", "ds",
        F.coalesce(lagged("close", 1), F.col("close")).alias("_base"),
    )
    based = fitted.join(bases, ["unique_id", "ds"], "left").withColumn(
        "_base", F.coalesce("_base", F.lit(default_price))
    )
    prices = {m: one_step_price(target_type, F.col(m), F.col("_base")) for m in models}
    return based.withColumns(prices).drop("_base")
