"""The model matrix: what the regressors see for every panel row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacast.functions.calendar import (
    add_calendar_features, add_date_features, next_business_days,
)
from stratacast.functions.series import lagged
from stratacast.operators.future import TECHNICAL_DEFAULTS
from stratacast.operators.lags import add_lag_features, drop_warm_up, feature_matrix
from stratacast.operators.scaling import scale_in_place
from stratacast.schemas import (
    CALENDAR_COLUMNS, DATE_FEATURES, MODEL_STATICS, TECHNICAL_COLUMNS, LagSpec, Settings,
)


@dataclass(frozen=True)
class Design:
    """Which columns enter the feature vector, in order: lags, then exogenous ones."""

    lag_spec: LagSpec = LagSpec()
    exogenous: tuple[str, ...] = (
        *DATE_FEATURES, *CALENDAR_COLUMNS, *TECHNICAL_COLUMNS, *MODEL_STATICS,
    )
    target_type: str = "log_return"
    technical_shift: int = 1

    @classmethod
    def of(cls, settings: Settings) -> Design:
        return cls(
            lag_spec=settings.lag_spec, target_type=settings.target_type,
            technical_shift=settings.technical_shift,
        )

    @property
    def differenced(self) -> bool:
        """Prices are modelled as day-to-day changes."""
        return self.target_type == "price"

    @property
    def features(self) -> list[str]:
        return [*self.lag_spec.names, *self.exogenous]

    @property
    def warm_up(self) -> int:
        return self.lag_spec.lookback + (1 if self.differenced else 0)


def shifted_technical(df: DataFrame, design: Design) -> DataFrame:
    """Technical features as known `technical_shift` rows earlier.

    At shift 0 they include the close being predicted.
    """
    named = [c for c in TECHNICAL_COLUMNS if c in design.exogenous and c in df.columns]
    if not design.technical_shift or not named:
        return df
    return df.withColumns({c: lagged(c, design.technical_shift) for c in named})


def transformed_panel(panel: DataFrame, design: Design) -> DataFrame:
    """Add the scaled model-space target `z`, with `mean`, `std` and `_before` to invert it.

    `_before` is the previous target value, used only for differenced prices.
    """
    df = panel
    if design.differenced:
        df = df.withColumn("_before", lagged("y", 1)).withColumn("_d", F.col("y") - F.col("_before"))
        return scale_in_place(df.filter("_before is not null"), "_d", "z").drop("_d")
    return scale_in_place(df.withColumn("_before", F.lit(0.0)), "y", "z")


def inverted(z: Column, design: Design) -> Column:
    """A model-space value back to the target's space, one step ahead of `_before`."""
    value = z * F.col("std") + F.col("mean")
    return value + F.col("_before") if design.differenced else value


def with_model_features(panel: DataFrame, design: Design) -> DataFrame:
    """Panel rows with every feature and `z`, warm-up rows removed; no shuffle is added."""
    dated = shifted_technical(add_date_features(panel), design)
    featured = add_lag_features(transformed_panel(dated, design), design.lag_spec, "z")
    return drop_warm_up(featured, design.lag_spec)


def training_matrix(panel: DataFrame, design: Design) -> DataFrame:
    """(unique_id, ds, features, label)."""
    return feature_matrix(with_model_features(panel, design), design.features, "z")


def held_columns(df: DataFrame, design: Design) -> list[str]:
    """Technical and static inputs of the model that `df` has: forecasts keep their last values."""
    return [c for c in (*TECHNICAL_COLUMNS, *MODEL_STATICS) if c in design.exogenous and c in df.columns]


def series_ends(history: DataFrame, design: Design) -> DataFrame:
    """One row per series: last_ds, last_price, and the last day's technical and static values."""
    held = held_columns(history, design)
    price = ["close"] if "close" in history.columns else []
    last = F.max_by(F.struct(F.lit(0), *price, *held), F.col("ds"))
    ends = history.groupBy("unique_id").agg(F.max("ds").alias("last_ds"), last.alias("_last"))
    return ends.select(
        "unique_id", "last_ds",
        *(F.col("_last")[c].alias("last_price") for c in price),
        *(F.col("_last")[c].alias(c) for c in held),
    )


def future_rows(ends: DataFrame, horizon: int, design: Design) -> DataFrame:
    """The next business days of each series with all exogenous values.

    Calendar and date features follow from the day; technical ones stay as on
    the last day. The history is read once, in `series_ends`, and no join follows.
    """
    held = {
        c: F.coalesce(c, F.lit(TECHNICAL_DEFAULTS[c])) for c in TECHNICAL_COLUMNS if c in ends.columns
    }
    days = F.explode(next_business_days(F.col("last_ds"), horizon)).alias("ds")
    rows = ends.select(*(c for c in ends.columns if c not in ("last_ds", "last_price")), days)
    return add_date_features(add_calendar_features(rows.withColumns(held) if held else rows))
