"""Shared pieces: intermediate tables, connected components, the train/held-out rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster shares; a temporary one only where one machine does all the work."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="llm-")


class Scratch:
    """Tables written for one operator call, so that no later step repeats earlier work."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        """Write `frame` and return it as read back; `name` is for `drop`."""
        path = self.path(name)
        self.paths[name] = path
        schema = frame.schema
        frame.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no returned DataFrame reads."""
        for name in names:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def held_out() -> Column:
    """Rows no label or language may be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _stars(edges: DataFrame) -> bool:
    """Whether every x has one y, and no y is an x: then y is the smallest node x can reach."""
    ends = edges.select(F.col("x").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("y"), F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.agg(F.coalesce(F.max((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))), F.lit(False))).first()[0]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of `edges` (x, y): the smallest node it can reach.

    Alternates the large-star and small-star steps, which shorten paths without ever
    putting a component into one row, until only stars are left; each step is written out,
    which cuts its lineage. Edges that are stars already (labels of an earlier call) take no step.
    """
    current = edges.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    held = f"edges-{uuid.uuid4().hex}"
    current = scratch.save(current, held)
    while not _stars(current):
        both = current.union(current.select("y", "x"))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("x"), F.col("low").alias("y"))
        large = large.union(low.filter("low < x").select("x", F.col("low").alias("y"))).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("low"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("low").alias("y"))
        after = small.union(low.select("x", F.col("low").alias("y"))).filter("x <> y").distinct()
        name = f"edges-{uuid.uuid4().hex}"
        current = scratch.save(after, name)
        scratch.drop(held)
        held = name
    nodes = current.select(F.col("x").alias("node"), F.col("y").alias("label"))
    return nodes.union(current.select("y", "y").distinct())
