"""Rows to be predicted, and what is known about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.functions.calendar import add_calendar_features, next_business_days
from stratacast.schemas import TECHNICAL_COLUMNS

# What a technical feature is worth when its series has no state.
TECHNICAL_DEFAULTS = {c: 1.0 if c == "volume_ma_ratio" else 0.0 for c in TECHNICAL_COLUMNS}


def future_from_date(ids: DataFrame, last_date, horizon: int) -> DataFrame:
    """The next business days after one common date, with calendar features."""
    days = next_business_days(F.lit(last_date).cast("date"), horizon)
    return add_calendar_features(ids.select("unique_id", F.explode(days).alias("ds")))


def future_per_series(history: DataFrame, horizon: int) -> DataFrame:
    """The next business days after each series' own end; `step` counts from 1."""
    ends = history.groupBy("unique_id").agg(F.max("ds").alias("_last"))
    return ends.select(
        "unique_id", F.posexplode(next_business_days(F.col("_last"), horizon)).alias("step", "ds")
    ).withColumn("step", F.col("step") + 1)


def missing_future(history: DataFrame, supplied: DataFrame, horizon: int) -> DataFrame:
    """Future rows a forecast needs that `supplied` does not have."""
    needed = future_per_series(history, horizon).select("unique_id", "ds")
    return needed.join(supplied.select("unique_id", "ds"), ["unique_id", "ds"], "left_anti")


def require_future(history: DataFrame, supplied: DataFrame, horizon: int) -> None:
    count = missing_future(history, supplied, horizon).count()
    if count:
        raise ValueError(f"missing future exogenous rows: {count}")


def latest_technical(training: DataFrame) -> DataFrame:
    """Each series' technical features on its last day."""
    known = [c for c in TECHNICAL_COLUMNS if c in training.columns]
    return (
        training.groupBy("unique_id").agg(F.max_by(F.struct(*known), F.col("ds")).alias("_state"))
        .select("unique_id", *(F.col("_state")[c].alias(c) for c in known))
    )


def hold_technical(future: DataFrame, training: DataFrame) -> DataFrame:
    """Freeze the last technical state over the horizon."""
    known = [c for c in TECHNICAL_COLUMNS if c in training.columns]
    if not known:
        return future
    held = future.join(latest_technical(training), "unique_id", "left")
    return held.withColumns({c: F.coalesce(c, F.lit(TECHNICAL_DEFAULTS[c])) for c in known})
