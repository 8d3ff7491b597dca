"""Reporting queries over the training frame, predictions and companies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.functions.series import newest
from stratacast.operators.ensemble import ENSEMBLE, add_ensemble, with_ensemble
from stratacast.operators.metrics import long_predictions
from stratacast.operators.targets import reconstruct_fitted_prices
from stratacast.schemas import PREDICTION_RECORD
from stratacast.sources.symbols import company_key, ticker_to_symbol
from stratacast.sources.tables import restrict_universe


def prediction_records(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Wide predictions to (unique_id, ds, model_name, value); bounds are left out."""
    long = long_predictions(df, models)
    return long.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTION_RECORD))


def history(training: DataFrame, ids=None, last_n: int = 60) -> DataFrame:
    """The last closes of each wanted series."""
    wanted = restrict_universe(training.select("unique_id", "ds", "close"), ids)
    return newest(wanted, last_n).withColumnRenamed("close", "value")


def backtest(
    fitted: DataFrame,
    training: DataFrame,
    models: Sequence[str],
    target_type: str,
    ids=None,
    last_n: int = 50,
) -> DataFrame:
    """The last in-sample predictions of each wanted series as price records."""
    recent = newest(restrict_universe(fitted.select("unique_id", "ds", *models), ids), last_n)
    closes = restrict_universe(training.select("unique_id", "ds", "close"), ids)
    prices = reconstruct_fitted_prices(recent, closes, models, target_type)
    return prediction_records(add_ensemble(prices, models), with_ensemble(models))


def available_series(training: DataFrame | None, configured: DataFrame | None = None) -> DataFrame:
    """Sorted ids with data, or the configured (position, ticker) list when there is none.

    `training` should be a stored table: whether it holds a row is asked first, which
    behind an aggregation would run all of it.
    """
    if training is not None and not training.isEmpty():
        return training.select("unique_id").distinct().orderBy("unique_id")
    if configured is None:
        raise ValueError("neither training data nor configured tickers given")
    named = configured.groupBy("ticker").agg(F.min("position").alias("_at")).orderBy("_at")
    return named.select(F.upper("ticker").alias("unique_id"))


def _described(universe: DataFrame, companies: DataFrame) -> DataFrame:
    """Universe tickers with symbol, name and sector, by normalised ticker."""
    listed = universe.select(
        F.upper("ticker").alias("ticker"),
        ticker_to_symbol(F.col("ticker")).alias("symbol"),
        company_key(F.col("ticker")).alias("_key"),
    )
    known = companies.select(company_key(F.col("ticker")).alias("_key"), "name", "sector")
    return listed.join(known, "_key", "left").select(
        "ticker", "symbol",
        F.coalesce("name", "symbol").alias("name"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"),
    )


def companies_with_data(universe: DataFrame, companies: DataFrame, training: DataFrame) -> DataFrame:
    described = _described(universe, companies)
    traded = training.select(F.col("unique_id").alias("ticker")).distinct()
    return described.join(traded, "ticker", "left_semi").withColumn("has_data", F.lit(True))


def all_companies(universe: DataFrame, companies: DataFrame, training: DataFrame) -> DataFrame:
    """Every universe ticker, flagged by whether it has data."""
    traded = training.select(F.col("unique_id").alias("ticker"), F.lit(True).alias("has_data")).distinct()
    return _described(universe, companies).join(traded, "ticker", "left").withColumn(
        "has_data", F.coalesce("has_data", F.lit(False))
    )


def company_counts(listing: DataFrame) -> DataFrame:
    return listing.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("has_data").alias("available")
    )


def company_info(tickers: DataFrame, companies: DataFrame) -> DataFrame:
    """Look tickers up in any spelling; unknown ones have NULL name and sector."""
    asked = tickers.select("ticker", company_key(F.col("ticker")).alias("_key"))
    known = companies.select(company_key(F.col("ticker")).alias("_key"), "name", "sector")
    return asked.join(known, "_key", "left").drop("_key")


def sectors(listing: DataFrame) -> DataFrame:
    return listing.select("sector").distinct().orderBy("sector")


def search_companies(listing: DataFrame, sector: str = "", text: str = "") -> DataFrame:
    """Sector equality and case-insensitive substring; blanks match all."""
    if sector:
        listing = listing.filter(F.col("sector") == sector)
    needle = text.strip().lower()
    if needle:
        hit = F.lit(False)
        for column in ("ticker", "name", "symbol"):
            hit = hit | F.lower(column).contains(needle)
        listing = listing.filter(hit)
    return listing


def data_statistics(training: DataFrame) -> DataFrame:
    return training.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("unique_id").alias("companies"),
        F.min("ds").alias("start"),
        F.max("ds").alias("end"),
    )


def run_summary(training: DataFrame, models: Sequence[str]) -> DataFrame:
    names = F.array_sort(F.array(*(F.lit(m) for m in models)))
    return data_statistics(training).withColumnRenamed("companies", "unique_series").withColumn(
        "trained_models", names
    )


def training_subset(training: DataFrame, ids: DataFrame | Sequence[str]) -> DataFrame:
    """Rows of the wanted series of a stored table; raises when none of them has data."""
    subset = restrict_universe(training, ids)
    if subset.isEmpty():
        raise ValueError("no training data for the requested series")
    return subset


def aligned_lines(
    actual: DataFrame,
    fitted: DataFrame,
    forecast: DataFrame,
    models: Sequence[str] = (ENSEMBLE,),
    model: str | None = None,
) -> DataFrame:
    """(unique_id, ds, actual, predicted, forecast) on the union of dates.

    Inputs are (unique_id, ds, value) history and long prediction records of `models`.
    Without `model` the lines are the ensemble's, or the first model's where there is
    none. The forecast line starts on the last actual of the newest history date, so it
    joins up with the actual line when drawn. The lines meet in one aggregate; `actual`
    and `forecast` are read more than once, so pass stored tables.
    """
    if model is None:
        model = ENSEMBLE if ENSEMBLE in models else models[0]
    lines = ("actual", "predicted", "forecast")

    def as_line(name: str, rows: DataFrame) -> DataFrame:
        values = (F.col("value") if line == name else F.lit(None).cast("double") for line in lines)
        return rows.select("unique_id", "ds", *(v.alias(line) for v, line in zip(values, lines)))

    past, ahead = (df.filter(F.col("model_name") == model) for df in (fitted, forecast))
    last_day = actual.agg(F.max("ds").alias("ds"))
    forecasted = ahead.select("unique_id").distinct()
    anchors = actual.join(last_day, "ds", "left_semi").join(forecasted, "unique_id", "left_semi")
    rows = as_line("actual", actual).union(as_line("predicted", past))
    rows = rows.union(as_line("forecast", ahead)).union(as_line("forecast", anchors))
    return rows.groupBy("unique_id", "ds").agg(*(F.max(line).alias(line) for line in lines))
