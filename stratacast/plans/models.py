"""Regressors by name, as factories of Spark ML estimators.

`hgb`, `lgbm` and `xgb` are presets of Spark's gradient-boosted trees with the
row and column sampling, leaf size and round count those names stand for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacast.plans.gram import GramRegression, HuberRegression

# Hyper-parameters of the model zoo.
RIDGE_ALPHA = 1.0
ENET_ALPHA, ENET_L1_RATIO = 0.01, 0.5
HUBER_ALPHA, HUBER_L1_RATIO, HUBER_EPSILON = 1e-4, 0.15, 0.1
LEARNING_RATE = 0.03
BOOST_DEPTH = 6


@dataclass(frozen=True)
class LabelStats:
    """Row count (or sum of weights) and label spread, which turn penalties into Spark's units."""

    rows: float
    spread: float


def label_stats(matrix: DataFrame, weight_col: str | None = None) -> LabelStats:
    """With weights: their sum, and the weighted population deviation of the label."""
    if weight_col is None:
        seen = matrix.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("s")).first()
    else:
        weight, label = F.col(weight_col), F.col("label")
        total = F.sum(weight)
        center = F.sum(weight * label) / total
        square = F.sum(weight * label * label) / total
        seen = matrix.agg(total.alias("n"), F.sqrt(F.greatest(square - center * center, F.lit(0.0))).alias("s")).first()
    if not seen["n"]:
        raise ValueError("no training rows: every series is shorter than the warm-up")
    return LabelStats(seen["n"], seen["s"] or 1.0)


def ridge(seed: int, stats: LabelStats, **overrides) -> Estimator:
    """sum (y - b0 - x b)^2 + alpha |b|^2, solved exactly from the Gram aggregate."""
    return GramRegression(**{"alpha": RIDGE_ALPHA, "l1_ratio": 0.0, **overrides})


def elastic_net(seed: int, stats: LabelStats, **overrides) -> Estimator:
    """Squares / 2n + alpha (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2), by coordinate descent."""
    return GramRegression(**{"alpha": ENET_ALPHA, "l1_ratio": ENET_L1_RATIO, **overrides})


def huber(seed: int, stats: LabelStats, **overrides) -> Estimator:
    """Huber loss (epsilon 0.1) with an elastic-net penalty, the optimum of the reference's SGD setting."""
    return HuberRegression(**{"alpha": HUBER_ALPHA, "l1_ratio": HUBER_L1_RATIO, "epsilon": HUBER_EPSILON, **overrides})


def random_forest(seed: int, stats: LabelStats, **overrides) -> Estimator:
    return RandomForestRegressor(**{
        "numTrees": 150, "maxDepth": 10, "minInstancesPerNode": 5,
        "featureSubsetStrategy": "sqrt", "seed": seed, **overrides,
    })


def _boosted(**preset) -> Callable[..., Estimator]:
    def build(seed: int, stats: LabelStats, **overrides) -> Estimator:
        return GBTRegressor(**{
            "stepSize": LEARNING_RATE, "maxDepth": BOOST_DEPTH, "seed": seed, **preset, **overrides,
        })
    return build


FACTORIES: dict[str, Callable[..., Estimator]] = {
    "ridge": ridge,
    "enet": elastic_net,
    "sgd": huber,
    "rf": random_forest,
    "gb": _boosted(maxIter=200, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="0.8"),
    "hgb": _boosted(maxIter=250, minInstancesPerNode=25, maxBins=255),
    "lgbm": _boosted(maxIter=200, minInstancesPerNode=20, subsamplingRate=0.7, featureSubsetStrategy="0.7"),
    "xgb": _boosted(maxIter=200, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="0.7"),
}
COMPLEXITY: dict[str, tuple[str, ...]] = {
    "simple": ("ridge", "enet", "sgd"),
    "moderate": ("rf",),
    "complex": ("gb", "hgb", "lgbm", "xgb"),
}


def models_of(complexity: str) -> list[str]:
    if complexity not in COMPLEXITY:
        raise ValueError(f"unknown complexity {complexity!r}; expected one of {sorted(COMPLEXITY)}")
    return list(COMPLEXITY[complexity])


def build(
    name: str, stats: LabelStats, seed: int = 42, overrides: Mapping[str, Mapping] | None = None
) -> Estimator:
    """The estimator called `name`; `overrides[name]` replaces its parameters."""
    if name not in FACTORIES:
        raise ValueError(f"unknown model {name!r}; expected one of {sorted(FACTORIES)}")
    return FACTORIES[name](seed, stats, **dict((overrides or {}).get(name, {})))
