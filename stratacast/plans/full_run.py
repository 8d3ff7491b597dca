"""The whole run: prepare, fit, validate, forecast, save, summarise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacast.operators.cleanse import quality_report, validate_rows
from stratacast.operators.metrics import best_model, summarize_cv
from stratacast.operators.ensemble import with_ensemble
from stratacast.plans.crossval import calibrate, cross_validate, short_series
from stratacast.plans.design import Design
from stratacast.plans.fitting import fit, fitted_values
from stratacast.plans.forecasting import forecast
from stratacast.plans.models import FACTORIES
from stratacast.plans.persistence import save_models
from stratacast.plans.recursive import series_state
from stratacast.plans.training import training_frame
from stratacast.schemas import Settings
from stratacast.sources.tables import load_table, save_report, save_table


@dataclass(frozen=True)
class RunResult:
    summary: DataFrame
    cv_summary: DataFrame
    forecasts: DataFrame


def full_run(
    spark: SparkSession,
    raw: DataFrame,
    sectors: DataFrame | None,
    folder: str,
    models: Sequence[str] = tuple(FACTORIES),
    settings: Settings = Settings(),
    overrides: Mapping[str, Mapping] | None = None,
) -> RunResult:
    """Every stage's table is written to `folder`, and later stages read it back.

    Reading back cuts the lineage: a lost executor costs a re-read, not a
    recomputation of the run so far. Where no series is long enough to calibrate
    intervals the run goes on without them, and `intervals` in the summary says
    so; `short_series` lists what cross-validation leaves out.
    """
    design = Design.of(settings)
    save_table(training_frame(raw, sectors, settings.target_type), f"{folder}/training")
    training = load_table(spark, f"{folder}/training")
    validate_rows(training)
    save_report(quality_report(training, settings.target_type), f"{folder}/quality")

    fitted = fit(training, models, design, settings.random_state, overrides)
    save_table(fitted_values(training, fitted, design), f"{folder}/fitted")

    cv, _ = cross_validate(
        training, models, settings.cv_windows, settings.horizon, settings.cv_step_size, design,
        settings.random_state, overrides,
    )
    save_table(cv, f"{folder}/cv")
    save_report(
        short_series(training, design, settings.cv_windows, settings.horizon, settings.cv_step_size), f"{folder}/short_series"
    )
    cv = load_table(spark, f"{folder}/cv")
    save_table(summarize_cv(cv, with_ensemble(models)), f"{folder}/cv_summary")
    cv_summary = load_table(spark, f"{folder}/cv_summary")

    residuals = None
    if settings.enable_prediction_intervals:
        residuals = calibrate(
            training, models, settings.horizon, design=design, seed=settings.random_state, overrides=overrides,
        )
    if residuals is not None:
        save_table(residuals, f"{folder}/residuals")
        residuals = load_table(spark, f"{folder}/residuals")

    codes = training.select("sector", "sector_code").distinct()
    save_models(spark, f"{folder}/model", fitted, design, series_state(training, design), codes)
    # the stored state holds all a forecast needs: the history is not read again
    state = load_table(spark, f"{folder}/model/state")
    save_table(
        forecast(None, fitted, settings.horizon, design=design, residuals=residuals, levels=settings.levels, state=state),
        f"{folder}/forecasts",
    )
    forecasts = load_table(spark, f"{folder}/forecasts")

    counts = {
        name: load_table(spark, f"{folder}/{table}").count()
        for name, table in (("fitted_rows", "fitted"), ("cv_rows", "cv"), ("forecast_rows", "forecasts"))
    }
    summary = training.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("unique_id").alias("series")
    ).withColumns({
        **{name: F.lit(n).cast("bigint") for name, n in counts.items()},
        "intervals": F.lit(residuals is not None),
        "best_model": F.lit(best_model(cv_summary).first()[0]),
        "model_path": F.lit(f"{folder}/model"),
    })
    save_report(summary, f"{folder}/run_summary")
    return RunResult(summary, cv_summary, forecasts)
