"""Combining, clipping and cleaning model columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratacast.schemas import check_target_type

ENSEMBLE = "ensemble_mean"
PERCENT_FLOOR = -0.999999


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the present values of a row, NULL when none is."""
    total = reduce(add, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    present = reduce(add, [F.col(c).isNotNull().cast("int") for c in columns])
    return total / F.nullif(present, F.lit(0))


def add_ensemble(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Add the mean of the models present; one model alone makes no ensemble."""
    available = [m for m in models if m in df.columns]
    return df.withColumn(ENSEMBLE, row_mean(available)) if len(available) > 1 else df


def with_ensemble(models: Sequence[str]) -> list[str]:
    return [*models, ENSEMBLE] if len(models) > 1 else list(models)


def fill_missing_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL and NaN to 0 in numeric columns."""
    numeric = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    names = [c for c in (columns or numeric) if c in numeric]
    fractional = (T.DoubleType, T.FloatType)
    filled = {
        c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)) if isinstance(numeric[c], fractional) else F.col(c), F.lit(0))
        for c in names
    }
    return df.withColumns({c: v.cast(numeric[c]) for c, v in filled.items()})


def clip_prediction(target_type: str, predicted: Column) -> Column:
    """Prices stay at or above 0, percent returns above -1, log returns free."""
    check_target_type(target_type)
    if target_type == "log_return":
        return predicted
    floor = 0.0 if target_type == "price" else PERCENT_FLOOR
    return F.when(predicted.isNotNull(), F.greatest(predicted, F.lit(floor)))
