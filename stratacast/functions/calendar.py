"""Business-day arithmetic and calendar features as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacast.schemas import CALENDAR_COLUMNS, DATE_FEATURES


def is_business_day(day: Column) -> Column:
    return F.weekday(day) < 5


def business_days(first: Column, last: Column) -> Column:
    """Array of the Mondays to Fridays in [first, last]; NULL when first > last."""
    days = F.filter(F.sequence(first, last), is_business_day)
    return F.when(first <= last, days)


def next_business_days(day: Column, count: int) -> Column:
    """Array of the `count` business days strictly after `day`."""
    # seven days per five business days, plus a weekend at either end
    reach = 7 * ((count + 4) // 5) + 3
    ahead = F.sequence(F.date_add(day, 1), F.date_add(day, reach))
    return F.slice(F.filter(ahead, is_business_day), 1, count)


def calendar_columns(ds: Column) -> dict[str, Column]:
    angle = F.month(ds) * F.lit(2 * math.pi) / F.lit(12.0)
    built = [
        (F.weekday(ds) >= 5).cast("int"),
        (F.dayofmonth(ds) == 1).cast("int"),
        (ds.cast("date") == F.last_day(ds)).cast("int"),
        F.weekofyear(ds),
        F.sin(angle),
        F.cos(angle),
    ]
    return dict(zip(CALENDAR_COLUMNS, built))


def week_of_month(ds: Column) -> Column:
    return (F.floor((F.dayofmonth(ds) - 1) / 7) + 1).cast("int")


def date_feature_columns(ds: Column) -> dict[str, Column]:
    built = [F.weekday(ds), F.month(ds), F.quarter(ds), week_of_month(ds)]
    return dict(zip(DATE_FEATURES, built))


def add_calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar_columns(F.col("ds")))


def add_date_features(df: DataFrame) -> DataFrame:
    return df.withColumns(date_feature_columns(F.col("ds")))
