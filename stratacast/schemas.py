"""Column layouts and run settings shared by every module."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import types as T

KEYS = ["unique_id", "ds"]
PRICES = ["open", "high", "low", "close"]
BAR_VALUES = [*PRICES, "volume"]
BAR_COLUMNS = [*KEYS, *BAR_VALUES]
STATIC_COLUMNS = ["sector", "asset_class", "sector_code", "asset_class_code"]
CALENDAR_COLUMNS = [
    "is_weekend", "is_month_start", "is_month_end", "week_of_year", "month_sin", "month_cos",
]
TECHNICAL_COLUMNS = [
    "volatility_5d", "volatility_20d", "momentum_5d", "momentum_20d", "range_pct", "volume_ma_ratio",
]
DATE_FEATURES = ["dayofweek", "month", "quarter", "week_of_month"]
MODEL_STATICS = ["sector_code", "asset_class_code"]
MODEL_FRAME_COLUMNS = [*KEYS, "y", *MODEL_STATICS, *CALENDAR_COLUMNS, *TECHNICAL_COLUMNS]

RAW_BARS = T.StructType(
    [T.StructField("unique_id", T.StringType()), T.StructField("ds", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_VALUES]
)
PREDICTION_RECORD = T.StructType([
    T.StructField("unique_id", T.StringType()),
    T.StructField("ds", T.DateType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

TargetType = Literal["price", "log_return", "percent_return"]
TARGET_TYPES = ("price", "log_return", "percent_return")


def check_target_type(target_type: str) -> str:
    if target_type not in TARGET_TYPES:
        raise ValueError(f"unknown target type {target_type!r}; expected one of {TARGET_TYPES}")
    return target_type


@dataclass(frozen=True)
class LagSpec:
    """Which history features a model sees; every tuple entry is one feature."""

    lags: tuple[int, ...] = (1, 2, 3, 5, 7, 14, 21)
    expanding_mean: tuple[int, ...] = (1,)
    expanding_std: tuple[int, ...] = (1,)
    rolling_mean: tuple[tuple[int, int], ...] = ((5, 5), (10, 10), (21, 21))
    rolling_std: tuple[tuple[int, int], ...] = ((5, 5), (21, 21))
    ewm: tuple[tuple[int, float], ...] = ((10, 0.2),)
    seasonal_mean: tuple[tuple[int, int, int], ...] = ((21, 5, 4),)

    @property
    def names(self) -> list[str]:
        return (
            [f"lag{k}" for k in self.lags]
            + [f"expandingmean_lag{k}" for k in self.expanding_mean]
            + [f"expandingstd_lag{k}" for k in self.expanding_std]
            + [f"rollingmean_lag{k}_{w}" for k, w in self.rolling_mean]
            + [f"rollingstd_lag{k}_{w}" for k, w in self.rolling_std]
            + [ewm_name(k, a) for k, a in self.ewm]
            + [f"seasonalrollingmean_lag{k}_{s}_{w}" for k, s, w in self.seasonal_mean]
        )

    @property
    def lookback(self) -> int:
        """Rows of history needed before every feature is defined."""
        return max(
            [0, *self.lags, *self.expanding_mean]
            + [k + 1 for k in self.expanding_std]
            + [k + w - 1 for k, w in (*self.rolling_mean, *self.rolling_std)]
            + [k for k, _ in self.ewm]
            + [k + s * (w - 1) for k, s, w in self.seasonal_mean]
        )


def ewm_name(lag: int, alpha: float) -> str:
    # a dot in a column name means field access in Spark
    return f"exponentiallyweightedmean_lag{lag}_{str(alpha).replace('.', '_')}"


@dataclass(frozen=True)
class Settings:
    horizon: int = 14
    cv_windows: int = 2
    cv_step_size: int = 7
    levels: tuple[int, ...] = (80, 95)
    keep_last_n: int = 450
    enable_prediction_intervals: bool = False
    random_state: int = 42
    target_type: str = "log_return"
    technical_shift: int = 1
    lag_spec: LagSpec = field(default_factory=LagSpec)
