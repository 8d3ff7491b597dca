"""Window building blocks over one series in date order.

A series holds at most one row per calendar day once bars are deduplicated, so
its length is bounded by its date span no matter how large the input is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order() -> WindowSpec:
    return Window.partitionBy("unique_id").orderBy("ds")


def so_far() -> WindowSpec:
    """From the first row of a series to the current one."""
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    """All rows of a series; ordered, so it shares the sort of the other windows."""
    return in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def lagged(column: Column | str, n: int) -> Column:
    return F.lag(column, n).over(in_order())


def full_window(aggregate, column: Column | str, rows: int, lag: int = 0) -> Column:
    """`aggregate` of `rows` values ending `lag` rows back, NULL unless all are present."""
    frame = in_order().rowsBetween(-(lag + rows - 1), -lag)
    return F.when(F.count(column).over(frame) == rows, aggregate(column).over(frame))


def rank_from_end() -> Column:
    """1 for the newest row of a series; reuses the ascending sort."""
    return F.count(F.lit(1)).over(whole()) - F.row_number().over(in_order()) + 1


def newest(df: DataFrame, n: int) -> DataFrame:
    """The last `n` rows of each series."""
    return (
        df.withColumn("_age", F.row_number().over(Window.partitionBy("unique_id").orderBy(F.desc("ds"))))
        .filter(F.col("_age") <= n).drop("_age")
    )


TAPS = 16


def add_ewm(df: DataFrame, column: str, alpha: float, out: str) -> DataFrame:
    """s_0 = x_0, s_t = alpha*x_t + (1-alpha)*s_{t-1}, along each series.

    Spark has no recursive window, so the weighted sum is built from fixed-offset
    lags in stages: stage 1 sums TAPS neighbouring terms, stage 2 sums TAPS of
    those sums TAPS rows apart, and so on until the remaining weight is below
    double precision. Each stage is one pass with constant work per row.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie strictly between 0 and 1")
    keep = 1.0 - alpha
    # the first value has weight 1 instead of alpha
    first = F.row_number().over(in_order()) == 1
    df = df.withColumn(out, F.when(first, F.col(column)).otherwise(alpha * F.col(column)))
    stride = 1
    while keep ** stride > 1e-18:
        terms = F.col(out)
        for tap in range(1, TAPS):
            earlier = F.coalesce(lagged(out, tap * stride), F.lit(0.0))
            terms = terms + F.lit(keep ** (tap * stride)) * earlier
        df = df.withColumn(out, terms)
        stride *= TAPS
    return df
