"""Typing, filtering, deduplication and validation of bar rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratacast.schemas import BAR_VALUES, KEYS


def normalize_keys(df: DataFrame) -> DataFrame:
    """Dates without time of day (bad ones raise) and upper-case ids.

    A missing id becomes a blank one, which row validation rejects; ids that
    are never NULL also spare every later join a null filter.
    """
    return df.withColumns({
        "unique_id": F.upper(F.coalesce(F.col("unique_id").cast("string"), F.lit(""))),
        "ds": F.col("ds").cast("date"),
    })


def coerce_numeric(df: DataFrame, columns: Sequence[str] = tuple(BAR_VALUES)) -> DataFrame:
    """Columns to DOUBLE; text that is no number, and NaN, become NULL."""
    def as_number(name: str) -> Column:
        number = F.col(name).try_cast("double")
        return F.when(~F.isnan(number), number)

    return df.withColumns({name: as_number(name) for name in columns})


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["ds", *BAR_VALUES])


def keep_traded(df: DataFrame) -> DataFrame:
    return df.filter((F.col("close") > 0) & (F.col("volume") > 0))


def deduplicate(
    df: DataFrame, order_by: Sequence[str] = tuple(BAR_VALUES), keys: Sequence[str] = tuple(KEYS)
) -> DataFrame:
    """One row per key: the smallest by `order_by`, then by the other columns.

    Written as an aggregate rather than a row_number window, so copies collapse
    on the map side and a key with very many copies never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order_by, *(c for c in rest if c not in order_by)]
    return (
        df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_kept"))
        .select(*keys, *(F.col("_kept")[c].alias(c) for c in rest))
    )


def traded_rows(df: DataFrame) -> DataFrame:
    """Raw rows of any bar source, typed, complete and traded, copies still in."""
    return keep_traded(drop_incomplete(coerce_numeric(normalize_keys(df))))


def cleanse(df: DataFrame) -> DataFrame:
    """Raw rows of any bar source to unique, complete, traded daily bars."""
    return deduplicate(traded_rows(df))


def _filled(name: str) -> Column:
    return F.length(F.trim(F.col(name))) > 0


def _flag(name: str) -> Column:
    return F.col(name).isin(0, 1)


def row_rules() -> dict[str, Column]:
    """What a training row must satisfy, by rule name."""
    rules = {f"{c}_filled": _filled(c) for c in ("unique_id", "sector", "asset_class")}
    rules["ds_present"] = F.col("ds").isNotNull()
    rules["y_present"] = F.col("y").isNotNull()
    for c in (*BAR_VALUES, "sample_weight", "sector_code", "asset_class_code"):
        rules[f"{c}_positive"] = F.col(c) > 0
    for c in ("is_weekend", "is_month_start", "is_month_end"):
        rules[f"{c}_flag"] = _flag(c)
    rules["week_of_year_range"] = F.col("week_of_year").between(1, 53)
    # a rule that evaluates to NULL is a rule not met
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def violations(df: DataFrame) -> DataFrame:
    """Rows that break a rule, with the broken rules' names in `broken`."""
    broken = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in row_rules().items())))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def rule_counts(df: DataFrame) -> DataFrame:
    """One row: how many rows break each rule."""
    return df.agg(*(F.count_if(~ok).alias(name) for name, ok in row_rules().items()))


def validate_rows(df: DataFrame) -> None:
    """Raise on an empty frame or on any bad row."""
    all_met = F.lit(True)
    for ok in row_rules().values():
        all_met = all_met & ok
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~all_met).alias("bad")).first()
    if seen["rows"] == 0:
        raise ValueError("training frame is empty")
    if seen["bad"]:
        raise ValueError(f"row validation failed for {seen['bad']} rows")


def quality_report(df: DataFrame, target_type: str) -> DataFrame:
    """One row: rows, series, start, end, missing_rate, target_type."""
    def missing(field: T.StructField) -> Column:
        absent = F.col(field.name).isNull()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            absent = absent | F.isnan(field.name)
        return F.avg(F.when(absent, 1.0).otherwise(0.0))

    rates = [missing(f) for f in df.schema.fields]
    total = rates[0]
    for rate in rates[1:]:
        total = total + rate
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("unique_id").alias("series"),
        F.min("ds").alias("start"),
        F.max("ds").alias("end"),
        (total / len(rates)).alias("missing_rate"),
        F.lit(target_type).alias("target_type"),
    )
