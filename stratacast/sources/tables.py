"""Table scans and sinks, and the restrictions that should reach the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite `path`, keeping the partitioning the plan already has."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_report(df: DataFrame, path: str) -> None:
    """JSON lines, one report row per line; dates are written as ISO text."""
    df.write.mode("overwrite").json(path)


def combine(frames: Iterable[DataFrame], ordered: bool = False) -> DataFrame:
    """Union stored bar frames by column name; raises if no frame holds a row.

    The check reads up to one row of each scan; a frame behind an aggregation would be
    computed for it, so write such frames first.

    `ordered` adds a global (range-partitioned) sort, needed only when the
    result is written for people to read.
    """
    frames = list(frames)
    combined = reduce(lambda a, b: a.unionByName(b), frames) if frames else None
    if combined is None or combined.isEmpty():
        raise ValueError("no source delivered any rows")
    return combined.orderBy("unique_id", "ds") if ordered else combined


def restrict_dates(df: DataFrame, start=None, end=None) -> DataFrame:
    """Keep start <= ds < end; either bound may be open."""
    if start is not None:
        df = df.filter(F.col("ds") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("ds") < F.lit(end))
    return df


def restrict_universe(df: DataFrame, ids: DataFrame | Sequence[str] | None) -> DataFrame:
    """Keep the wanted series; an empty list (or None) means all of them.

    A list becomes a pushed-down IN filter. A DataFrame with a `unique_id`
    column of any size becomes a semi join, whose strategy Spark picks by size.
    """
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select("unique_id"), "unique_id", "left_semi")
    return df.filter(F.col("unique_id").isin(list(ids))) if ids else df
