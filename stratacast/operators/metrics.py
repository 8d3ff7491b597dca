"""Forecast errors per model. Rows with a missing side are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _paired(y: Column, p: Column, value: Column) -> Column:
    return F.when(y.isNotNull() & p.isNotNull(), value)


def smape(y: Column, p: Column) -> Column:
    """Aggregate: mean of |y-p| over the mean magnitude, in percent; 0/0 divides by 1."""
    scale = (F.abs(y) + F.abs(p)) / 2
    return F.avg(_paired(y, p, F.abs(y - p) / F.when(scale == 0, 1.0).otherwise(scale))) * 100


def wape(y: Column, p: Column) -> Column:
    """Aggregate: total |y-p| over total |y|, in percent; 0 when the target is all zero."""
    total = F.sum(_paired(y, p, F.abs(y)))
    return F.when(total == 0, 0.0).otherwise(
        F.sum(_paired(y, p, F.abs(y - p))) / F.nullif(total, F.lit(0.0)) * 100
    )


def mape(y: Column, p: Column) -> Column:
    """Aggregate: mean of |(y-p)/y|; rows with y = 0 are left out."""
    return F.avg(F.abs((y - p) / F.nullif(y, F.lit(0.0))))


def long_predictions(df: DataFrame, models: Sequence[str], keep: Sequence[str] = ("unique_id", "ds")) -> DataFrame:
    """One (model_name, value) row per prediction; other columns are dropped."""
    return df.select(*keep, *models).unpivot(list(keep), list(models), "model_name", "value")


def summarize_cv(cv: DataFrame, models: Sequence[str]) -> DataFrame:
    """(model, smape, wape), best first; one pass for all models."""
    pairs = long_predictions(cv, models, keep=["y"])
    y, p = F.col("y"), F.col("value")
    return (
        pairs.groupBy(F.col("model_name").alias("model"))
        .agg(smape(y, p).alias("smape"), wape(y, p).alias("wape"))
        .orderBy(F.col("smape").asc_nulls_last(), "model")
    )


def best_model(summary: DataFrame) -> DataFrame:
    """One row: the model with the lowest smape, NULL when there is none."""
    scored = summary.filter("smape is not null")
    return scored.agg(F.min_by("model", F.struct("smape", "model")).alias("best_model"))
