"""Conformal prediction intervals from cross-validation residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bound_names(model: str, levels: Sequence[int]) -> list[str]:
    return [f"{model}-{side}-{level}" for level in levels for side in ("lo", "hi")]


def quantile_of(ordered: Column, q: float) -> Column:
    """Linear-interpolation quantile of an ascending array."""
    place = (F.size(ordered) - 1) * F.lit(q)
    below = F.floor(place).cast("int")
    low = F.get(ordered, below)
    high = F.coalesce(F.get(ordered, below + 1), low)
    return low + (high - low) * (place - below)


def calibration_residuals(cv: DataFrame, models: Sequence[str]) -> DataFrame:
    """(unique_id, step, one array of |y - prediction| per model).

    `cv` has one row per series, cutoff and date. An array holds one value
    per calibration window, so its length is the number of windows.
    """
    step = F.row_number().over(Window.partitionBy("unique_id", "cutoff").orderBy("ds"))
    stepped = cv.withColumn("step", step)
    return stepped.groupBy("unique_id", "step").agg(
        *(F.collect_list(F.abs(F.col("y") - F.col(m))).alias(f"_res_{m}") for m in models)
    )


def add_intervals(
    forecast: DataFrame, residuals: DataFrame | None, models: Sequence[str], levels: Sequence[int]
) -> DataFrame:
    """Add `{model}-lo-{L}` and `{model}-hi-{L}`; series without residuals get NULL.

    Bounds are quantiles of the prediction plus and minus each residual.
    """
    if residuals is None:
        none = F.lit(None).cast("double")
        return forecast.withColumns({b: none for m in models for b in bound_names(m, levels)})
    step = F.row_number().over(Window.partitionBy("unique_id").orderBy("ds"))
    joined = forecast.withColumn("step", step).join(residuals, ["unique_id", "step"], "left")
    bounds = {}
    for m in models:
        errors, point = F.col(f"_res_{m}"), F.col(m)
        reach = F.array_sort(
            F.concat(F.transform(errors, lambda e: point - e), F.transform(errors, lambda e: point + e))
        )
        for level in levels:
            for side, sign in (("lo", -1), ("hi", 1)):
                q = (1 + sign * level / 100) / 2
                bounds[f"{m}-{side}-{level}"] = F.when(F.size(errors) > 0, quantile_of(reach, q))
    return joined.withColumns(bounds).drop("step", *(f"_res_{m}" for m in models))


def calibration_rows_needed(warm_up: int, n_windows: int, horizon: int) -> int:
    """Rows a series needs before its intervals can be calibrated."""
    return warm_up + n_windows * horizon + 1


def series_with_intervals(history: DataFrame, warm_up: int, n_windows: int, horizon: int) -> DataFrame:
    """(unique_id, rows, intervals_enabled)."""
    needed = calibration_rows_needed(warm_up, n_windows, horizon)
    return history.groupBy("unique_id").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "intervals_enabled", F.col("rows") >= needed
    )
