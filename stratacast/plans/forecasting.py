"""Forecasts for requested series, from history and trained models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame

from stratacast.operators.ensemble import add_ensemble
from stratacast.operators.intervals import add_intervals
from stratacast.operators.targets import reconstruct_prices
from stratacast.plans.design import Design, future_rows, series_ends
from stratacast.plans.recursive import ends_of, forecast_targets, series_state
from stratacast.sources.tables import restrict_universe


def unseen_without_history(requested: DataFrame, history: DataFrame) -> DataFrame:
    """Requested ids that have no rows at all."""
    wanted = requested.select("unique_id").distinct()
    return wanted.join(history.select("unique_id").distinct(), "unique_id", "left_anti")


def require_history(requested: DataFrame, history: DataFrame) -> None:
    """Raise, naming up to ten ids, when a requested series has no history."""
    absent = [r["unique_id"] for r in unseen_without_history(requested, history).orderBy("unique_id").take(10)]
    if absent:
        raise ValueError(f"cannot forecast series without history: {', '.join(absent)}")


def forecast(
    history: DataFrame | None,
    models: Mapping[str, Model],
    horizon: int = 14,
    ids: Sequence[str] | DataFrame | None = None,
    design: Design = Design(),
    return_prices: bool = True,
    residuals: DataFrame | None = None,
    levels: Sequence[int] = (80, 95),
    future: DataFrame | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """Wide forecasts with the ensemble, and intervals when `residuals` are given.

    Series are independent once the weights are fixed, so the id filter runs
    first. Series never trained on need only history; an id in `ids` without
    any raises. `future` replaces the held exogenous rows; a series that it
    gives more or fewer than `horizon` rows fails the job. A stored `state`
    (`series_state` of a full panel, loaded or refreshed) takes the history's
    place: one row per series is then all that is read.
    """
    known = history if state is None else state
    if ids is not None:
        asked = ids
        if not isinstance(ids, DataFrame):
            asked = known.sparkSession.createDataFrame([(i,) for i in ids], "unique_id string")
        require_history(asked, known)
        known = restrict_universe(known, ids)
    if state is None:
        ends, known = series_ends(known, design), series_state(known, design)
    else:
        ends = ends_of(known, design)
    rows = future_rows(ends, horizon, design) if future is None else future
    wide = forecast_targets(known, rows, models, horizon, design).drop("step")
    names = list(models)
    if return_prices:
        wide = reconstruct_prices(wide, ends, names, design.target_type)
    if residuals is not None:
        wide = add_intervals(wide, residuals, names, levels)
    return add_ensemble(wide, names)
