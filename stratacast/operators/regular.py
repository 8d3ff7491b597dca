"""Align irregular daily bars to a business-day calendar.

Instead of building a calendar table and joining the bars to it, each bar is
stretched over the days up to the next bar of its series. One window pass and
one explode give the aligned panel, with no join and no second shuffle.
Input bars must be unique per (unique_id, ds), as `cleanse` leaves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacast.functions.calendar import business_days, is_business_day
from stratacast.functions.series import whole, in_order, so_far
from stratacast.schemas import KEYS, PRICES


def _stretched(bars: DataFrame) -> DataFrame:
    """Every business day of every series with the bar in force; `_from` is that bar's day.

    The calendar runs from the first to the last bar, weekend bars included,
    but weekend bars lend no values. Days before the first weekday bar take
    that bar (back-fill). A series with weekend bars only gets null values.
    """
    values = [c for c in bars.columns if c not in KEYS]
    ds = F.col("ds")
    weekday = is_business_day(ds)
    marked = bars.withColumns({
        "_start": F.min("ds").over(whole()),
        "_end": F.max("ds").over(whole()),
        "_weekdays": F.count_if(weekday).over(whole()),
        "_nth": F.row_number().over(in_order()),
    })
    carriers = marked.filter(weekday | ((F.col("_weekdays") == 0) & (F.col("_nth") == 1)))
    begin = F.when(F.lag("ds").over(in_order()).isNull(), F.col("_start")).otherwise(ds)
    until = F.coalesce(F.date_sub(F.lead("ds").over(in_order()), 1), F.col("_end"))
    spans = carriers.withColumns({"_begin": begin, "_until": until})
    kept = [F.when(weekday, F.col(c)).alias(c) for c in values]
    return spans.select(
        "unique_id",
        ds.alias("_from"),
        *kept,
        F.explode(business_days(F.col("_begin"), F.col("_until"))).alias("ds"),
    ).select("unique_id", "ds", "_from", *values)


def business_calendar(bars: DataFrame) -> DataFrame:
    """Bars on the business-day calendar; days without a bar have NULL values."""
    values = [c for c in bars.columns if c not in KEYS]
    observed = F.col("ds") == F.col("_from")
    return _stretched(bars).select(*KEYS, *(F.when(observed, F.col(c)).alias(c) for c in values))


def filled(column: str) -> Column:
    """Forward fill, then back fill.

    After the forward fill only a leading gap is left, so the first non-null
    value of the series is its back fill.
    """
    return F.coalesce(
        F.last(column, ignorenulls=True).over(so_far()),
        F.first(column, ignorenulls=True).over(whole()),
    )


def fill_prices(panel: DataFrame) -> DataFrame:
    return panel.withColumns({c: filled(c) for c in PRICES})


def whole_volume(volume: Column) -> Column:
    """Missing volume is 1, at least 1, rounded half to even."""
    return F.bround(F.greatest(F.coalesce(volume, F.lit(1.0)), F.lit(1.0))).cast("bigint")


def fill_volume(panel: DataFrame) -> DataFrame:
    return panel.withColumn("volume", filled("volume")).withColumn("volume", whole_volume(F.col("volume")))


def regularize(bars: DataFrame) -> DataFrame:
    """Calendar, price fill and volume fill in one pass, for complete bars."""
    panel = _stretched(bars).drop("_from")
    return panel.withColumn("volume", whole_volume(F.col("volume")))
