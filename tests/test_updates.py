"""Incremental state: going on from the state equals a rebuild, without reading history."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacast.plans import recursive
from stratacast.plans.design import Design
from stratacast.plans.training import training_frame
from stratacast.streaming.updates import merge_observations, refresh_state


@pytest.fixture(scope="module")
def frame(spark, raw_bars, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("update") / "training")
    training_frame(raw_bars).write.parquet(path)
    return spark.read.parquet(path)


def compare(got, want):
    got = got.toPandas().set_index("unique_id").sort_index()
    want = want.toPandas().set_index("unique_id").sort_index()
    assert list(got.columns) == list(want.columns) and list(got.index) == list(want.index)
    for column in want.columns:
        for a, b in zip(got[column], want[column]):
            if isinstance(b, (list, np.ndarray)):
                assert np.allclose(np.asarray(a, float), np.asarray(b, float), atol=1e-9), column
            elif isinstance(b, float) or isinstance(a, float):
                assert (a is None and b is None) or np.isclose(a, b, atol=1e-9, equal_nan=True), (column, a, b)
            else:
                assert a == b, column


@pytest.mark.parametrize("target", ["log_return", "price"])
@pytest.mark.parametrize("new_days", [1, 3, 30])
def test_going_on_equals_a_rebuild(spark, frame, tmp_path, target, new_days):
    design = Design(target_type=target)
    panel = frame.withColumn("y", F.col("close")) if target == "price" else frame
    days = sorted(r.ds for r in panel.select("ds").distinct().collect())
    cut = days[-new_days - 1]
    history = panel.filter(F.col("ds") <= cut)
    latest = panel.filter((F.col("ds") > cut) & (F.col("unique_id") != "FINN.US"))
    stored = str(tmp_path / "state")
    recursive.series_state(history, design).write.parquet(stored)
    state = spark.read.parquet(stored)
    history_path = str(tmp_path / "history")
    history.write.parquet(history_path)
    history = spark.read.parquet(history_path)
    refreshed = refresh_state(state, history, latest, design)
    plan = refreshed._jdf.queryExecution().executedPlan().toString()
    assert history_path not in plan  # nothing of the history is read
    compare(refreshed, recursive.series_state(merge_observations(history, latest), design))


def test_late_and_replaced_days_rebuild_their_series(spark, frame):
    history = frame.select("unique_id", "ds", "y")
    days = sorted(r.ds for r in history.select("ds").distinct().collect())
    late = history.filter((F.col("unique_id") == "ABEL.US") & (F.col("ds") == days[-5])).withColumn("y", F.lit(0.5))
    after = history.filter((F.col("unique_id") == "MORN.US") & (F.col("ds") == days[-1]))
    base = history.filter(~((F.col("unique_id") == "MORN.US") & (F.col("ds") == days[-1])))
    state = recursive.series_state(base)
    latest = late.unionByName(after)
    compare(refresh_state(state, base, latest), recursive.series_state(merge_observations(base, latest)))
