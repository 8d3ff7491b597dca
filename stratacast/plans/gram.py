"""Linear fits from one aggregate of the weighted, centred Gram matrix.

Two passes over the assembled matrix: the weighted means, then the centred cross
products X'WX, X'Wy, as dense products of Arrow batches in the tasks, whose sums Spark
adds up. What reaches the driver is p x p numbers however many rows there are, and the system is
solved there exactly: ridge by one linear solve, elastic net by coordinate descent on
the same matrix. A column without variance has a zero row in X'WX and gets weight 0.
The result is a Spark `LinearRegressionModel`, so it scores, saves and loads as any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Coordinate descent stops when no weight moves by more than this (relative), or after
#: so many sweeps; the second is a guard that raises, not a cut.
TOLERANCE, SWEEPS = 1e-15, 200_000


def width(matrix: DataFrame, column: str = "features") -> int:
    """Length of the feature vectors, from the assembler's metadata, else from a row."""
    meta = matrix.schema[column].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    return len(matrix.select(column).first()[0])


def _sums(rows: DataFrame, p: int, shift_x: np.ndarray, shift_y: float, reweight=None, squares: bool = True):
    """(sum w, sum w dy, sum w dx, dx' w dx, dx' w dy) of rows (x, y, w) about the shift.

    Each partition multiplies its batches as dense matrices and gives its sums as one
    array; Spark adds the arrays up by place, so p x p numbers reach the driver. (An
    aggregate of one expression a cell has some 660 of them, too many to be compiled:
    it took ten seconds a pass on 44,000 rows.) Rows without weight count nowhere, a
    missing y adds nothing to the sums that hold it.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + p + (p * p + p if squares else 0))
        seen = False
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            known, weighted = (batch.column(i).is_valid().to_numpy(zero_copy_only=False) for i in (1, 2))
            if reweight is not None:
                weighted = weighted & known
            if not weighted.all():
                x, y, w, known = x[weighted], y[weighted], w[weighted], known[weighted]
            if not len(w):
                continue
            seen = True
            if reweight is not None:
                w = reweight(x, y, w)
            dx, dy = x - shift_x, np.where(known, y - shift_y, 0.0)
            total[0] += w.sum()
            total[1] += w @ dy
            total[2:2 + p] += w @ dx
            if squares:
                heavy = dx * w[:, None]
                total[2 + p:2 + p + p * p] += (heavy.T @ dx).ravel()
                total[2 + p + p * p:] += heavy.T @ dy
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    partial = rows.mapInArrow(add, "sums array<double>").select(F.posexplode("sums").alias("place", "value"))
    added = partial.groupBy("place").agg(F.sum("value").alias("value")).collect()
    if not added:
        raise ValueError("no training rows: every series is shorter than the warm-up")
    total = np.zeros(len(added))
    for place, value in added:
        total[place] = value
    gram = total[2 + p:2 + p + p * p].reshape(p, p) if squares else None
    return total[0], total[1], total[2:2 + p], gram, total[2 + p + p * p:]


def moments(matrix: DataFrame, weight_col: str | None = None, features: str = "features", label: str = "label",
            reweight=None, shift: tuple | None = None):
    """(total weight, means of x, mean of y, X'WX centred, X'Wy centred) of `matrix`.

    `reweight(x, y, w)`, on numpy arrays of many rows, replaces the weights.
    With `shift` (means of x and y near the true ones), one pass of sums about the shift
    instead of two; the centring is then corrected on the driver.
    """
    p = width(matrix, features)
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = matrix.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
    if shift is None:
        n, sum_y, sum_x, *_ = _sums(rows, p, np.zeros(p), 0.0, reweight, squares=False)
        if not n:
            raise ValueError("no training rows: every series is shorter than the warm-up")
        mean_x, mean_y = sum_x / n, sum_y / n
        *_, gram, cross = _sums(rows, p, mean_x, mean_y, reweight)
        return float(n), mean_x, float(mean_y), gram, cross
    n, sum_y, sum_x, gram, cross = _sums(rows, p, *shift, reweight)
    off_x, off_y = sum_x / n, sum_y / n
    gram, cross = gram - n * np.outer(off_x, off_x), cross - n * off_x * off_y
    return float(n), shift[0] + off_x, float(shift[1] + off_y), gram, cross


def ridge_weights(gram: np.ndarray, cross: np.ndarray, alpha: float) -> np.ndarray:
    """argmin |y - Xb|^2 + alpha |b|^2 on centred data; columns without variance get 0."""
    live = np.diag(gram) > 0
    out = np.zeros(len(cross))
    if live.any():
        sub = gram[np.ix_(live, live)] + alpha * np.eye(int(live.sum()))
        out[live] = np.linalg.solve(sub, cross[live])
    return out


def elastic_net_weights(gram: np.ndarray, cross: np.ndarray, n: float, alpha: float, l1_ratio: float,
                        start: np.ndarray | None = None) -> np.ndarray:
    """argmin |y - Xb|^2 / 2n + alpha l1_ratio |b|_1 + alpha (1 - l1_ratio) |b|^2 / 2, from `start`."""
    cov, cor = gram / n, cross / n
    lasso, square = alpha * l1_ratio, alpha * (1 - l1_ratio)
    beta = np.zeros(len(cross)) if start is None else np.array(start, float)
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(len(beta)):
            if cov[j, j] <= 0 and square <= 0:
                continue
            rest = cor[j] - cov[j] @ beta + cov[j, j] * beta[j]
            new = np.sign(rest) * max(abs(rest) - lasso, 0.0) / (cov[j, j] + square)
            moved = max(moved, abs(new - beta[j]))
            beta[j] = new
        if moved <= TOLERANCE * (1.0 + np.abs(beta).max()):
            return beta
    raise RuntimeError(f"coordinate descent did not settle in {SWEEPS} sweeps")


def _huber_weights(beta: np.ndarray, intercept: float, epsilon: float):
    """Weights of the next reweighting step: min(1, epsilon / |r|) times the rows' own."""

    def reweight(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return w * (epsilon / np.maximum(np.abs(y - (x @ beta + intercept)), epsilon))

    return reweight


class GramRegression(Estimator):
    """Ridge (l1_ratio 0) or elastic net, fitted from the Gram aggregate.

    Ridge: sum_i w_i (y_i - b0 - x_i b)^2 + alpha |b|^2. Elastic net: the same squares
    divided by 2 sum_i w_i, plus alpha (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2).
    The intercept is not penalised.
    """

    def __init__(self, alpha: float, l1_ratio: float = 0.0, weight_col: str | None = None):
        super().__init__()
        self.alpha, self.l1_ratio, self.weight_col = alpha, l1_ratio, weight_col

    def setWeightCol(self, name: str) -> GramRegression:  # noqa: N802  (Spark's name)
        self.weight_col = name
        return self

    def copy(self, extra=None) -> GramRegression:
        return GramRegression(self.alpha, self.l1_ratio, self.weight_col)

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        n, mean_x, mean_y, gram, cross = moments(dataset, self.weight_col)
        if self.l1_ratio:
            beta = elastic_net_weights(gram, cross, n, self.alpha, self.l1_ratio)
        else:
            beta = ridge_weights(gram, cross, self.alpha)
        intercept = float(mean_y - mean_x @ beta)
        return linear_model(dataset.sparkSession, beta, intercept, self.uid)


class HuberRegression(Estimator):
    """Huber loss with an elastic-net penalty, by iteratively reweighted least squares.

    Minimises sum_i h(y_i - b0 - x_i b) / n + alpha (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2),
    h(r) = r^2 / 2 within `epsilon`, epsilon |r| - epsilon^2 / 2 beyond. Each step weights
    rows by min(1, epsilon / |r|) from the last fit (a majoriser of the loss, so the
    objective never rises), aggregates the weighted Gram matrix in one pass and solves the
    penalised weighted least squares on the driver by coordinate descent.
    """

    def __init__(self, alpha: float, l1_ratio: float, epsilon: float, max_iter: int = 500, tol: float = 1e-12,
                 weight_col: str | None = None):
        super().__init__()
        self.alpha, self.l1_ratio, self.epsilon = alpha, l1_ratio, epsilon
        self.max_iter, self.tol, self.weight_col = max_iter, tol, weight_col

    def setWeightCol(self, name: str) -> HuberRegression:  # noqa: N802  (Spark's name)
        self.weight_col = name
        return self

    def copy(self, extra=None) -> HuberRegression:
        return HuberRegression(self.alpha, self.l1_ratio, self.epsilon, self.max_iter, self.tol, self.weight_col)

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        rows = float(dataset.count()) if self.weight_col is None else None
        base = None
        beta, intercept, shift, steps = None, 0.0, None, 0
        for _ in range(self.max_iter):
            reweight = None if beta is None else _huber_weights(beta, intercept, self.epsilon)
            n, mean_x, mean_y, gram, cross = moments(dataset, self.weight_col, reweight=reweight, shift=shift)
            shift = (mean_x, mean_y)
            steps += 1
            if base is None:
                base = rows if rows is not None else n
            new = elastic_net_weights(gram, cross, base, self.alpha, self.l1_ratio, start=beta)
            new_intercept = float(mean_y - mean_x @ new)
            moved = 0.0 if beta is None else max(np.abs(new - beta).max(initial=0.0), abs(new_intercept - intercept))
            settled = beta is not None and moved <= self.tol * (1.0 + np.abs(new).max(initial=0.0) + abs(new_intercept))
            beta, intercept = new, new_intercept
            if settled:
                break
        else:
            raise RuntimeError(f"reweighting did not settle in {self.max_iter} steps")
        self.steps = steps
        return linear_model(dataset.sparkSession, beta, intercept, self.uid)


def linear_model(spark, beta: np.ndarray, intercept: float, uid: str) -> LinearRegressionModel:
    """A Spark `LinearRegressionModel` with these weights (features in, prediction out)."""
    jvm = spark.sparkContext._jvm
    vector = _py2java(spark.sparkContext, Vectors.dense([float(b) for b in beta]))
    return LinearRegressionModel(jvm.org.apache.spark.ml.regression.LinearRegressionModel(uid, vector, intercept))
