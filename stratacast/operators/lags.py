"""History features of the target, for training (windows over the panel)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacast.functions.series import in_order, add_ewm, full_window, lagged, newest
from stratacast.schemas import MODEL_FRAME_COLUMNS, LagSpec, ewm_name


def _until(lag: int):
    return in_order().rowsBetween(Window.unboundedPreceding, -lag)


def seasonal_mean(column: str, lag: int, season: int, window: int) -> Column:
    """Mean of `window` values one season apart, NULL unless all are present."""
    return reduce(add, [lagged(column, lag + season * i) for i in range(window)]) / window


def add_lag_features(df: DataFrame, spec: LagSpec = LagSpec(), column: str = "y") -> DataFrame:
    """All features of `spec`; adds no shuffle to a panel partitioned by series."""
    smoothed = {}
    for lag, alpha in spec.ewm:
        state = f"_ewm_{str(alpha).replace('.', '_')}"
        if state not in df.columns:
            df = add_ewm(df, column, alpha, state)
        smoothed[ewm_name(lag, alpha)] = (state, lag)
    features = {f"lag{k}": lagged(column, k) for k in spec.lags}
    features |= {f"expandingmean_lag{k}": F.avg(column).over(_until(k)) for k in spec.expanding_mean}
    features |= {f"expandingstd_lag{k}": F.stddev_samp(column).over(_until(k)) for k in spec.expanding_std}
    features |= {f"rollingmean_lag{k}_{w}": full_window(F.avg, column, w, k) for k, w in spec.rolling_mean}
    features |= {
        f"rollingstd_lag{k}_{w}": full_window(F.stddev_samp, column, w, k) for k, w in spec.rolling_std
    }
    features |= {name: lagged(state, lag) for name, (state, lag) in smoothed.items()}
    features |= {
        f"seasonalrollingmean_lag{k}_{s}_{w}": seasonal_mean(column, k, s, w)
        for k, s, w in spec.seasonal_mean
    }
    return df.withColumns(features).drop(*{state for state, _ in smoothed.values()})


def drop_warm_up(df: DataFrame, spec: LagSpec = LagSpec()) -> DataFrame:
    return df.dropna(subset=spec.names) if spec.names else df


def keep_last(df: DataFrame, n: int) -> DataFrame:
    """The newest `n` rows per series, the history kept for later prediction."""
    return newest(df, n)


def model_frame(df: DataFrame) -> DataFrame:
    """Only the columns models know, where present."""
    return df.select([c for c in MODEL_FRAME_COLUMNS if c in df.columns])


def feature_matrix(df: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    """(unique_id, ds, features VECTOR, label); a missing value raises."""
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    return assembler.transform(df).select(
        "unique_id", "ds", "features", F.col(label).cast("double").alias("label")
    )
