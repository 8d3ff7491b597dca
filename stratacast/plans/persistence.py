"""Saving and loading trained models with the tables they need."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.ml import Model
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession

from stratacast.plans.design import Design
from stratacast.schemas import LagSpec

READERS = {c.__name__: c for c in (GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel)}


@dataclass(frozen=True)
class SavedModels:
    models: Mapping[str, Model]
    design: Design
    state: DataFrame
    sector_codes: DataFrame


def save_models(
    spark: SparkSession,
    folder: str,
    models: Mapping[str, Model],
    design: Design,
    state: DataFrame,
    sector_codes: DataFrame,
) -> str:
    """One folder: each model, the state and sector tables, and a manifest."""
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/models/{name}")
    state.write.mode("overwrite").parquet(f"{folder}/state")
    sector_codes.write.mode("overwrite").parquet(f"{folder}/sector_codes")
    manifest = {"models": {n: type(m).__name__ for n, m in models.items()}, "design": asdict(design)}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{folder}/manifest")
    return folder


def _tuples(value):
    return tuple(_tuples(v) for v in value) if isinstance(value, list) else value


def load_models(spark: SparkSession, folder: str) -> SavedModels:
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    design = {k: _tuples(v) for k, v in manifest["design"].items() if k != "lag_spec"}
    spec = LagSpec(**{k: _tuples(v) for k, v in manifest["design"]["lag_spec"].items()})
    return SavedModels(
        {n: READERS[kind].load(f"{folder}/models/{n}") for n, kind in manifest["models"].items()},
        Design(lag_spec=spec, **design),
        spark.read.parquet(f"{folder}/state"),
        spark.read.parquet(f"{folder}/sector_codes"),
    )
