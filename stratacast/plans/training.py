"""From raw bars to the training frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.functions.calendar import add_calendar_features, is_business_day
from stratacast.operators.cleanse import deduplicate, traded_rows, validate_rows
from stratacast.operators.regular import regularize
from stratacast.operators.statics import (
    UNKNOWN_SECTOR, add_asset_class, add_sample_weight, add_sector, add_sector_code,
)
from stratacast.operators.targets import add_target
from stratacast.operators.technical import add_technical_features


def panel_series(rows: DataFrame) -> DataFrame:
    """Ids that have at least one business day between their first and last row."""
    spans = rows.groupBy("unique_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    on_weekday = is_business_day(F.col("a")) | is_business_day(F.col("b"))
    # two weekend days more than a day apart have a Monday to Friday between them
    return spans.filter(on_weekday | (F.datediff("b", "a") > 1)).select("unique_id")


def series_sectors(
    series: DataFrame, sectors: DataFrame | None, codes: DataFrame | None = None
) -> DataFrame:
    """(unique_id, sector, sector_code) for every series of the panel."""
    if sectors is None:
        named = series.withColumn("sector", F.lit(UNKNOWN_SECTOR))
    else:
        named = add_sector(series, sectors)
    return add_sector_code(named, codes).select("unique_id", "sector", "sector_code")


def training_frame(
    raw: DataFrame,
    sectors: DataFrame | None = None,
    target_type: str = "log_return",
    codes: DataFrame | None = None,
    unique: bool = False,
    validate: bool = False,
) -> DataFrame:
    """Cleansed, regular panel with target, statics, calendar and technical features.

    `sectors` is (unique_id, sector). `codes` is a saved (sector, sector_code)
    mapping; without it codes rank the sectors present. The series are found by
    a column-pruned aggregate over the input, so sector work is done on one row
    per series and joins the facts on the key they are already shuffled by.
    `unique` says that no (unique_id, day) repeats, which saves the shuffle
    that removes copies. All later steps share one shuffle by series.
    """
    rows = traded_rows(raw)
    panel = regularize(rows if unique else deduplicate(rows))
    panel = panel.join(series_sectors(panel_series(rows), sectors, codes), "unique_id", "left")
    # statics join before the panel is sorted: a join would undo the windows' sort
    valued = add_sample_weight(add_target(add_asset_class(panel), target_type))
    full = add_calendar_features(add_technical_features(valued))
    if validate:
        validate_rows(full)
    return full
