"""Fitting global models and predicting in sample."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.operators.ensemble import clip_prediction, fill_missing_features
from stratacast.plans.design import Design, inverted, training_matrix, with_model_features
from stratacast.plans.models import build, label_stats

SPILLING = StorageLevel.MEMORY_AND_DISK
#: Rows of a panel that are worth a task of their own.
TASK_ROWS = 50_000


def _sized(panel: DataFrame) -> DataFrame:
    """`panel` by series in as many partitions as its rows call for, two a core at least.

    Else the features' shuffle deals them out by the session's setting: trees pass over the
    partitions some 200 times a fit, and each empty one costs a task. Never more than by the setting.
    """
    session = panel.sparkSession
    least = 2 * session.sparkContext.defaultParallelism
    most = int(session.conf.get("spark.sql.shuffle.partitions"))
    if most <= least:
        return panel
    wanted = max(least, math.ceil(panel.count() / TASK_ROWS))
    return panel.repartition(wanted, "unique_id") if wanted < most else panel


def fit(
    panel: DataFrame,
    models: Sequence[str],
    design: Design = Design(),
    seed: int = 42,
    overrides: Mapping[str, Mapping] | None = None,
    weight_col: str | None = None,
) -> dict[str, Model]:
    """One pooled fit per model over all series.

    The assembled matrix is computed once and kept, on disk where memory runs
    out, across the fits; a lost block is recomputed from the panel.
    """
    matrix = training_matrix(_sized(panel), design)
    if weight_col:
        weights = panel.select("unique_id", "ds", F.col(weight_col).alias("weight"))
        matrix = matrix.join(weights, ["unique_id", "ds"])
    matrix = matrix.drop("unique_id", "ds").persist(SPILLING)
    try:
        stats = label_stats(matrix, "weight" if weight_col else None)
        fitted = {}
        for name in models:
            estimator = build(name, stats, seed, overrides)
            if weight_col:
                estimator = estimator.setWeightCol("weight")
            fitted[name] = estimator.fit(matrix)
        return fitted
    finally:
        matrix.unpersist()


def score(df: DataFrame, models: Mapping[str, Model]) -> DataFrame:
    """Add one model-space prediction column per model to rows with `features`."""
    for name, model in models.items():
        df = model.transform(df).withColumnRenamed(model.getPredictionCol(), name)
    return df


def fitted_values(panel: DataFrame, models: Mapping[str, Model], design: Design = Design()) -> DataFrame:
    """One-step predictions for every row past the warm-up, in target space.

    Any series with history will do, trained on or not: the statistics that
    scale it come from its own rows.
    """
    featured = fill_missing_features(with_model_features(panel, design), design.features)
    assembled = VectorAssembler(inputCols=design.features, outputCol="features").transform(featured)
    scored = score(assembled, models)
    values = [clip_prediction(design.target_type, inverted(F.col(m), design)).alias(m) for m in models]
    return scored.select("unique_id", "ds", *values)
