"""Per-series target transforms and their inverses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacast.functions.series import whole, so_far, lagged


def usable_std(std: Column) -> Column:
    return F.when(std > 0, std).otherwise(1.0)


def difference(df: DataFrame, column: str = "y", out: str = "z") -> DataFrame:
    """First difference along each series; the first row is NULL."""
    return df.withColumn(out, F.col(column) - lagged(column, 1))


def undifference_path(changes: DataFrame, last_values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Predicted changes along a horizon to levels; `last_values` is (unique_id, last_value)."""
    based = changes.join(last_values.select("unique_id", F.col("last_value").alias("_last")), "unique_id")
    levels = {c: F.col("_last") + F.sum(c).over(so_far()) for c in columns}
    return based.withColumns(levels).drop("_last")


def undifference_fitted(changes: DataFrame, history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """In-sample changes to levels, each from the value observed the day before."""
    before = history.select("unique_id", "ds", lagged("y", 1).alias("_before"))
    based = changes.join(before, ["unique_id", "ds"], "left")
    return based.withColumns({c: F.col(c) + F.col("_before") for c in columns}).drop("_before")


def scaler_stats(df: DataFrame, column: str = "y") -> DataFrame:
    """(unique_id, mean, std) with population std; a flat series has std 1."""
    return df.groupBy("unique_id").agg(
        F.avg(column).alias("mean"), usable_std(F.stddev_pop(column)).alias("std")
    )


def scale(df: DataFrame, stats: DataFrame, column: str = "y", out: str = "z") -> DataFrame:
    """Standardise with stored statistics, e.g. those a model was trained with."""
    return (
        df.join(stats, "unique_id")
        .withColumn(out, (F.col(column) - F.col("mean")) / F.col("std")).drop("mean", "std")
    )


def scale_in_place(df: DataFrame, column: str = "y", out: str = "z") -> DataFrame:
    """Standardise and keep `mean` and `std` on every row, with no extra shuffle."""
    return df.withColumns({
        "mean": F.avg(column).over(whole()),
        "std": usable_std(F.stddev_pop(column).over(whole())),
    }).withColumn(out, (F.col(column) - F.col("mean")) / F.col("std"))


def unscale(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    based = df.join(stats, "unique_id")
    return based.withColumns({c: F.col(c) * F.col("std") + F.col("mean") for c in columns}).drop("mean", "std")
