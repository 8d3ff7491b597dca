"""Holdout and rolling-origin splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.functions.series import whole, rank_from_end


def holdout_split(df: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last `horizon` rows of each series are the test."""
    ranked = df.withColumn("_age", rank_from_end())
    return (
        ranked.filter(F.col("_age") > horizon).drop("_age"),
        ranked.filter(F.col("_age") <= horizon).drop("_age"),
    )


def window_offsets(n_windows: int, step_size: int) -> list[int]:
    """Rows left out after each window's test rows, oldest window first."""
    return [(n_windows - 1 - i) * step_size for i in range(n_windows)]


def cv_window(df: DataFrame, offset: int, horizon: int) -> DataFrame:
    """One window: rows up to its end, with `role` train or test and `cutoff`."""
    ranked = df.withColumn("_age", rank_from_end()).filter(F.col("_age") > offset)
    is_train = F.col("_age") > offset + horizon
    return (
        ranked.withColumn("role", F.when(is_train, "train").otherwise("test"))
        .withColumn("cutoff", F.max(F.when(is_train, F.col("ds"))).over(whole()))
        .drop("_age")
    )


def cv_windows(df: DataFrame, n_windows: int, horizon: int, step_size: int) -> DataFrame:
    """Every window's rows, with `window`, `role` and `cutoff`.

    Windows overlap, so a row appears once per window it belongs to: each row
    is fanned out to its own windows rather than joined to a window table.
    """
    offsets = window_offsets(n_windows, step_size)
    age = F.col("_age")
    ranked = df.withColumn("_age", rank_from_end()).withColumns({
        f"_cutoff{i}": F.max(F.when(age > off + horizon, F.col("ds"))).over(whole())
        for i, off in enumerate(offsets)
    })
    entries = [
        F.struct(
            F.lit(i).alias("window"),
            F.when(age > off + horizon, "train").when(age > off, "test").alias("role"),
            F.col(f"_cutoff{i}").alias("cutoff"),
        )
        for i, off in enumerate(offsets)
    ]
    fanned = ranked.withColumn("_entry", F.explode(F.array(*entries)))
    return (
        fanned.select(*df.columns, "_entry.window", "_entry.role", "_entry.cutoff")
        .filter("role is not null")
    )
