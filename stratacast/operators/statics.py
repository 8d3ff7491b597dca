"""Per-series attributes: sector, codes, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacast.functions.series import whole
from stratacast.schemas import STATIC_COLUMNS

UNKNOWN_SECTOR = "Unknown"
WEIGHT_FLOOR = 0.05


def add_sector(df: DataFrame, sectors: DataFrame) -> DataFrame:
    """Look up `sector` by series; `sectors` has unique (unique_id, sector) rows.

    The join is on unique_id, the panel's own partitioning, so a sector that
    holds most of the rows causes no skew.
    """
    found = df.join(sectors.select("unique_id", "sector"), "unique_id", "left")
    return found.withColumn("sector", F.coalesce("sector", F.lit(UNKNOWN_SECTOR)))


def add_asset_class(df: DataFrame, asset_class: str = "equity", code: int = 1) -> DataFrame:
    return df.withColumns({"asset_class": F.lit(asset_class), "asset_class_code": F.lit(code)})


def sector_codes(df: DataFrame) -> DataFrame:
    """(sector, sector_code): 1-based rank of each sector name present.

    Names are made distinct before ranking, so the single-partition window
    ranks one short row per sector, never fact rows.
    """
    present = df.select("sector").distinct()
    return present.select(
        "sector", F.dense_rank().over(Window.orderBy("sector")).alias("sector_code")
    )


def add_sector_code(df: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Attach codes; pass a saved mapping to score with a trained model's codes."""
    codes = sector_codes(df) if codes is None else codes
    return df.join(codes, "sector", "left")


def add_sample_weight(df: DataFrame) -> DataFrame:
    largest = F.max("volume").over(whole())
    share = F.col("volume") / F.when(largest == 0, 1).otherwise(largest)
    return df.withColumn("sample_weight", F.greatest(share, F.lit(WEIGHT_FLOOR)))


def static_features(training: DataFrame) -> DataFrame:
    return training.select("unique_id", *STATIC_COLUMNS).distinct()
