"""Technical features of a regular panel; windows must be full to count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.functions.series import full_window, lagged

RATIO_BOUNDS = (0.1, 10.0)


def add_technical_features(df: DataFrame) -> DataFrame:
    close, zero = F.col("close"), F.lit(0.0)
    with_returns = df.withColumn("_ret", F.ln(close / lagged("close", 1)))
    low, high = RATIO_BOUNDS
    ratio = F.col("volume") / full_window(F.avg, "volume", 20)
    features = {
        f"volatility_{n}d": F.coalesce(full_window(F.stddev_samp, "_ret", n), zero) for n in (5, 20)
    }
    features |= {
        f"momentum_{n}d": F.coalesce(close / lagged("close", n) - 1, zero) for n in (5, 20)
    }
    features["range_pct"] = F.coalesce((F.col("high") - F.col("low")) / close, zero)
    features["volume_ma_ratio"] = F.least(
        F.greatest(F.coalesce(ratio, F.lit(1.0)), F.lit(low)), F.lit(high)
    )
    return with_returns.withColumns(features).drop("_ret")
