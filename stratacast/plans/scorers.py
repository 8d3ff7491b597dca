"""Trained Spark ML regressors as arrays that tasks can evaluate.

Needed only where a prediction becomes the input of the next one; everywhere
else models score through `transform`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
from pyspark.ml import Model
from pyspark.ml.regression import LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratacast.sources.scratch import new_folder


class Scorer(Protocol):
    def predict(self, x: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class LinearScorer:
    weights: np.ndarray
    intercept: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept


@dataclass(frozen=True)
class TreeScorer:
    """Nodes of all trees in one table; a leaf has feature -1 and points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        while (self.feature[at] >= 0).any():
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.value[at] @ self.weights


def first_trees(scorer: TreeScorer, count: int) -> TreeScorer:
    """The sum of the first trees only: what boosting had after `count` rounds."""
    return replace(scorer, roots=scorer.roots[:count], weights=scorer.weights[:count])


def _tree_scorer(model: Model) -> TreeScorer:
    """Read the node table Spark saves with a model; its size is set by trees and depth."""
    spark = SparkSession.active()
    folder = new_folder(spark, "model")
    model.write().save(folder)
    nodes = (
        spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
        .select(
            "treeID", "id", "prediction", "leftChild", "rightChild",
            F.col("split.featureIndex").alias("feature"),
            F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        )
        .orderBy("treeID", "id").toPandas()
    )
    # node ids count from 0 in each tree
    starts = np.flatnonzero(nodes["id"].to_numpy() == 0)
    offsets = starts[nodes["treeID"].to_numpy()]
    own = np.arange(len(nodes))
    leaf = nodes["leftChild"].to_numpy() < 0
    weights = np.array(model.treeWeights)
    if isinstance(model, RandomForestRegressionModel):
        weights = weights / weights.sum()
    return TreeScorer(
        np.where(leaf, -1, nodes["feature"]),
        nodes["threshold"].fillna(0.0).to_numpy(),
        np.where(leaf, own, nodes["leftChild"] + offsets),
        np.where(leaf, own, nodes["rightChild"] + offsets),
        nodes["prediction"].to_numpy(),
        starts,
        weights,
    )


def portable(model: Model | Scorer) -> Scorer:
    """The scorer of a trained model; a scorer is returned as it is."""
    if isinstance(model, LinearRegressionModel):
        return LinearScorer(model.coefficients.toArray(), model.intercept)
    return _tree_scorer(model) if hasattr(model, "treeWeights") else model
