"""Multi-step forecasts that feed each prediction back as history.

A state table holds, per series, the few numbers and the short tail of history
from which the next row's features follow. The horizon loop runs over that
table in Arrow batches of many series at once: it never shuffles, and its cost
depends on the number of series, not on the length of their histories. (The
same loop as a chain of projections works too, but planning tens of nested
projections per model took longer than running them.)
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratacast.functions.series import add_ewm, lagged, rank_from_end
from stratacast.operators.ensemble import PERCENT_FLOOR
from stratacast.plans.design import Design, held_columns, transformed_panel
from stratacast.plans.scorers import Scorer, portable
from stratacast.schemas import LagSpec, ewm_name


def series_state(panel: DataFrame, design: Design = Design()) -> DataFrame:
    """One row per series: what is needed to predict its next days.

    unique_id, last_ds, n, total, squares (of z), mean, std, level (last y),
    hist (last z values, oldest first, at most the lookback long) and one
    smoothed value per exponential feature; from a panel that has them also
    last_price and the last day's technical and static values, so that prices
    can be forecast from the state alone.
    """
    spec = design.lag_spec
    price = [F.col("close").alias("last_price")] if "close" in panel.columns else []
    held = held_columns(panel, design)
    ends = [*(["last_price"] if price else []), *held]
    df = transformed_panel(panel.select("unique_id", "ds", "y", *price, *held), design)
    smoothed = {}
    for lag, alpha in spec.ewm:
        name = ewm_name(lag, alpha)
        raw = f"_s{len(smoothed)}"
        df = add_ewm(df, "z", alpha, raw)
        # the value the next row's feature takes: `lag` rows before it
        df = df.withColumn(raw, lagged(raw, lag - 1))
        smoothed[name] = raw
    tail = F.collect_list(F.when(F.col("_age") <= max(spec.lookback, 1), F.struct("ds", "z", "_r")))
    # the scaled series in its own units: y, or its day-to-day change for prices
    df = df.withColumn("_r", F.col("y") - F.col("_before"))
    state = (
        df.withColumn("_age", rank_from_end()).groupBy("unique_id").agg(
            F.max("ds").alias("last_ds"),
            F.count("z").alias("n"),
            F.sum("z").alias("total"),
            F.sum(F.col("z") * F.col("z")).alias("squares"),
            F.first("mean").alias("mean"),
            F.first("std").alias("std"),
            F.max_by("y", F.col("ds")).alias("level"),
            F.transform(F.array_sort(tail), lambda e: e["z"]).alias("hist"),
            *(F.max_by(raw, F.col("ds")).alias(name) for name, raw in smoothed.items()),
            # raw moments and tail, from which `advance_state` goes on with new rows alone
            F.count("_r").alias("raw_n"),
            F.avg("_r").alias("raw_mean"),
            F.sum((F.col("_r") - F.col("mean")) * (F.col("_r") - F.col("mean"))).alias("raw_m2"),
            F.transform(F.array_sort(tail), lambda e: e["_r"]).alias("raw_tail"),
            *([F.max_by(F.struct(*ends), F.col("ds")).alias("_end")] if ends else []),
        )
    )
    return state.withColumns({c: F.col("_end")[c] for c in ends}).drop("_end") if ends else state


def ends_of(state: DataFrame, design: Design) -> DataFrame:
    """The part of a state from which future rows and price paths follow, as `series_ends` gives it."""
    price = ["last_price"] if "last_price" in state.columns else []
    return state.select("unique_id", "last_ds", *price, *held_columns(state, design))


def with_future(state: DataFrame, future: DataFrame, design: Design) -> DataFrame:
    """Attach each series' future days and exogenous values, in date order.

    The arrays hold one entry per step of the horizon.
    """
    values = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in design.exogenous))
    entry = F.struct(F.unix_date("ds").alias("day"), values.cast("array<double>").alias("x"))
    rows = future.groupBy("unique_id").agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    return state.join(rows, "unique_id", "left").withColumns({
        "days": F.col("_rows.day"), "exogenous": F.flatten(F.col("_rows.x")),
    }).drop("_rows")


def unforecastable(state: DataFrame, future: DataFrame, horizon: int) -> DataFrame:
    """(unique_id, future_rows): series of `state` whose future is not exactly `horizon` rows."""
    rows = future.groupBy("unique_id").agg(F.count(F.lit(1)).alias("future_rows"))
    return state.select("unique_id").join(rows, "unique_id", "left").select(
        "unique_id", F.coalesce("future_rows", F.lit(0)).alias("future_rows")
    ).filter(F.col("future_rows") != horizon)


def right_aligned(arrays: pd.Series, width: int) -> np.ndarray:
    """Ragged arrays as one matrix, newest value in the last column, NaN before the first."""
    lengths = arrays.str.len().to_numpy()
    out = np.full((len(arrays), width), np.nan)
    out[np.arange(width) >= width - lengths[:, None]] = np.concatenate(arrays.to_list())
    return out


def next_features(spec: LagSpec, hist: np.ndarray, n, total, squares, smoothed: Mapping) -> np.ndarray:
    """Features of the row after `hist`, one row per series, in the order of `spec.names`."""
    if any(k != 1 for k in (*spec.expanding_mean, *spec.expanding_std)):
        raise ValueError("recursive forecasts support expanding features of lag 1 only")
    width = hist.shape[1]

    def window(lag: int, rows: int) -> np.ndarray:
        return hist[:, width - (lag + rows - 1): width - lag + 1]

    spread = np.sqrt(np.maximum(squares - total * total / n, 0.0) / np.where(n > 1, n - 1, np.nan))
    columns = [hist[:, -k] for k in spec.lags]
    columns += [total / n for _ in spec.expanding_mean]
    columns += [spread for _ in spec.expanding_std]
    columns += [window(k, w).mean(axis=1) for k, w in spec.rolling_mean]
    columns += [window(k, w).std(axis=1, ddof=1) for k, w in spec.rolling_std]
    columns += [smoothed[ewm_name(k, a)] for k, a in spec.ewm]
    columns += [
        np.mean([hist[:, -(k + s * i)] for i in range(w)], axis=0) for k, s, w in spec.seasonal_mean
    ]
    return np.column_stack(columns) if columns else np.empty((len(hist), 0))


FLOORS = {"price": 0.0, "percent_return": PERCENT_FLOOR, "log_return": -np.inf}


def _path(scorer: Scorer, batch: pd.DataFrame, exogenous: np.ndarray, design: Design) -> np.ndarray:
    """One model's predictions for a batch of series, (series x horizon), in target space."""
    spec = design.lag_spec
    hist = right_aligned(batch["hist"], max(spec.lookback, 1))
    n, total, squares, mean, std, level = (
        batch[c].to_numpy(float) for c in ("n", "total", "squares", "mean", "std", "level")
    )
    smoothed = {ewm_name(k, a): batch[ewm_name(k, a)].to_numpy(float) for k, a in spec.ewm}
    path = np.empty(exogenous.shape[:2])
    for step in range(path.shape[1]):
        lags = next_features(spec, hist, n, total, squares, smoothed)
        raw = scorer.predict(np.nan_to_num(np.hstack([lags, exogenous[:, step]]), nan=0.0))
        change = raw * std + mean
        value = np.maximum(change + level if design.differenced else change, FLOORS[design.target_type])
        z = ((value - level if design.differenced else value) - mean) / std
        hist = np.hstack([hist[:, 1:], z[:, None]])
        n, total, squares, level = n + 1, total + z, squares + z * z, value
        for lag, alpha in spec.ewm:
            name = ewm_name(lag, alpha)
            entering = hist[:, -lag]
            moved = (1.0 - alpha) * smoothed[name] + alpha * entering
            smoothed[name] = np.where(np.isnan(moved), entering, moved)
        path[:, step] = value
    return path


def forecast_targets(
    state: DataFrame,
    future: DataFrame,
    models: Mapping[str, Model | Scorer],
    horizon: int,
    design: Design = Design(),
) -> DataFrame:
    """(unique_id, ds, step, one column per model) in target space.

    Each model follows its own path. `future` must hold `horizon` rows for
    each series of `state`; the job fails on a series that has more or fewer,
    and names it (`unforecastable` lists them all). Trained weights travel to
    the tasks as a broadcast, whose size is set by the models alone.
    """
    shared = state.sparkSession.sparkContext.broadcast({m: portable(model) for m, model in models.items()})
    width = len(design.exogenous)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            known = np.stack(batch["exogenous"]).reshape(len(batch), horizon, width)
            out = {
                "unique_id": np.repeat(batch["unique_id"].to_numpy(), horizon),
                "day": np.concatenate(batch["days"].to_list()),
                "step": np.tile(np.arange(1, horizon + 1), len(batch)),
            }
            for name, scorer in shared.value.items():
                out[name] = _path(scorer, batch, known, design).ravel()
            yield pd.DataFrame(out)

    schema = T.StructType(
        [T.StructField("unique_id", T.StringType()), T.StructField("day", T.IntegerType()),
         T.StructField("step", T.IntegerType())]
        + [T.StructField(m, T.DoubleType()) for m in models]
    )
    given = F.coalesce(F.size("days"), F.lit(0))
    given = F.when(given < 0, 0).otherwise(given)
    refusal = F.raise_error(F.concat(
        F.lit("series "), F.coalesce("unique_id", F.lit("NULL")), F.lit(" has "), given.cast("string"),
        F.lit(f" future rows; the horizon is {horizon}"),
    )).cast("array<int>")
    ready = with_future(state, future, design)
    ready = ready.withColumn("days", F.when(given == horizon, F.col("days")).otherwise(refusal))
    return ready.mapInPandas(walk, schema).select(
        "unique_id", F.date_from_unix_date("day").alias("ds"), "step", *models
    )
