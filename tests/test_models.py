import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratacast.operators import lags, scaling, splits
from stratacast.operators.future import future_per_series, hold_technical, require_future
from stratacast.plans import crossval, fitting, forecasting, persistence, recursive
from stratacast.plans.design import (
    Design, future_rows, series_ends, training_matrix, with_model_features,
)
from stratacast.plans.full_run import full_run
from stratacast.plans.gram import moments
from stratacast.plans.models import FACTORIES, build, label_stats, models_of
from stratacast.plans.scorers import LinearScorer, first_trees, portable
from stratacast.plans.training import training_frame
from stratacast.schemas import CALENDAR_COLUMNS, MODEL_STATICS, TECHNICAL_COLUMNS, LagSpec, Settings
from stratacast.streaming.updates import merge_observations, refresh_state

SMALL = {"rf": {"numTrees": 4, "maxDepth": 4}, "gb": {"maxIter": 3, "maxDepth": 3}, "lgbm": {"maxDepth": 2}}
PAIR = Design(lag_spec=LagSpec((1, 5), (), (), (), (), (), ()), exogenous=(), technical_shift=0)


@pytest.fixture(scope="module")
def panel(spark, raw_bars, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "training")
    training_frame(raw_bars).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def models(panel):
    return fitting.fit(panel, ["ridge", "rf", "gb"], overrides=SMALL)


def test_lag_features_match_pandas(panel):
    got = lags.add_lag_features(panel.select("unique_id", "ds", "y")).orderBy("unique_id", "ds").toPandas()
    for _, g in got.groupby("unique_id"):
        y = g["y"]
        assert np.allclose(g["lag7"], y.shift(7), equal_nan=True)
        assert np.allclose(g["expandingmean_lag1"], y.shift(1).expanding().mean(), equal_nan=True)
        assert np.allclose(g["expandingstd_lag1"], y.shift(1).expanding().std(), equal_nan=True)
        assert np.allclose(g["rollingmean_lag10_10"], y.shift(10).rolling(10).mean(), equal_nan=True)
        assert np.allclose(g["rollingstd_lag21_21"], y.shift(21).rolling(21).std(), equal_nan=True)
        smooth = y.ewm(alpha=0.2, adjust=False).mean().shift(10)
        assert np.allclose(g["exponentiallyweightedmean_lag10_0_2"], smooth, atol=1e-15, equal_nan=True)
        season = sum(y.shift(21 + 5 * i) for i in range(4)) / 4
        assert np.allclose(g["seasonalrollingmean_lag21_5_4"], season, equal_nan=True)


def test_exponential_mean_is_exact_on_a_long_series(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    days = pd.bdate_range("2000-01-03", periods=3000)
    df = spark.createDataFrame(pd.DataFrame({"unique_id": "A", "ds": days.date, "y": x}))
    for alpha in (0.2, 0.02, 0.9):
        from stratacast.functions.series import add_ewm
        got = add_ewm(df, "y", alpha, "s").orderBy("ds").toPandas()["s"]
        assert np.allclose(got, pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), atol=1e-13)


def test_warm_up_removes_41_rows_per_series(panel):
    assert LagSpec().lookback == 41
    assert with_model_features(panel, Design()).count() == 570 - 3 * 41


def test_features_add_no_shuffle_and_no_python(spark, raw_bars):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from stratacast.operators.cleanse import cleanse
        from stratacast.operators.regular import regularize
        from stratacast.operators.targets import add_target
        from stratacast.operators.technical import add_technical_features
        base = regularize(cleanse(raw_bars))
        full = lags.add_lag_features(add_technical_features(add_target(base)))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (base, full)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plans[0].count("Exchange") == plans[1].count("Exchange") == 2
    assert "Python" not in plans[1] and "SinglePartition" not in plans[1]


def test_scaling_round_trip_and_flat_series(spark):
    rows = [("A", dt.date(2024, 1, d), float(v)) for d, v in ((1, 1), (2, 2), (3, 6))] + [
        ("B", dt.date(2024, 1, d), 4.0) for d in (1, 2)]
    df = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    stats = scaling.scaler_stats(df)
    scaled = scaling.scale(df, stats)
    assert {r["z"] for r in scaled.filter("unique_id = 'B'").collect()} == {0.0}
    back = scaling.unscale(scaled, stats, ["z"]).filter("abs(z - y) > 1e-12")
    assert back.count() == 0


def ridge_problem(panel, design):
    m = training_matrix(panel, design).toPandas()
    x, y = np.stack([v.toArray() for v in m["features"]]), m["label"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    return xc, yc, np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)


def test_ridge_equals_the_closed_form(panel):
    # the fixture's panel has one sector, one asset class and no weekends
    constant = {"is_weekend", "sector_code", "asset_class_code"}
    design = Design(exogenous=tuple(c for c in Design().exogenous if c not in constant))
    model = fitting.fit(panel, ["ridge"], design)["ridge"]
    assert np.allclose(model.coefficients.toArray(), ridge_problem(panel, design)[2], atol=1e-9)


def test_ridge_with_constant_features_reaches_the_optimum(panel):
    """Constant features make the solver iterate: same optimum, fewer exact digits."""
    xc, yc, best = ridge_problem(panel, Design())
    got = fitting.fit(panel, ["ridge"])["ridge"].coefficients.toArray()

    def objective(w):
        return ((yc - xc @ w) ** 2).sum() + (w ** 2).sum()

    assert objective(got) == pytest.approx(objective(best), rel=1e-9)
    assert np.allclose(xc @ got, xc @ best, atol=1e-4)


def test_moments_of_wide_matrices_with_gaps(spark):
    """As one aggregate expression a cell these would be 5,150 expressions."""
    rng, p = np.random.default_rng(3), 100
    x, y, w = rng.normal(5, 2, (300, p)), rng.normal(size=300), rng.uniform(0.5, 2, 300)
    rows = [(DenseVector(a), None if i == 7 else float(b), None if i == 9 else float(c))
            for i, (a, b, c) in enumerate(zip(x, y, w))]
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType()),
                           T.StructField("weight", T.DoubleType())])
    matrix = spark.createDataFrame(rows, schema)
    started = time.monotonic()
    n, mean_x, mean_y, gram, cross = moments(matrix, "weight")
    assert time.monotonic() - started < 30
    kept = np.arange(300) != 9
    known = kept & (np.arange(300) != 7)
    assert np.isclose(n, w[kept].sum()) and np.isclose(mean_y, (w * y)[known].sum() / n)
    assert np.allclose(mean_x, (w[:, None] * x)[kept].sum(axis=0) / n)
    dx = x - mean_x
    assert np.allclose(gram, (dx * w[:, None])[kept].T @ dx[kept], rtol=1e-10)
    with pytest.raises(ValueError, match="no training rows"):
        moments(matrix.filter("weight is null"), "weight")


def test_elastic_net_minimises_its_objective(panel):
    model = fitting.fit(panel, ["enet"])["enet"]
    m = training_matrix(panel, Design()).toPandas()
    x, y = np.stack([v.toArray() for v in m["features"]]), m["label"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.zeros(x.shape[1])
    for _ in range(2000):
        for j in range(len(w)):
            c = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / len(y)
            w[j] = np.sign(c) * max(abs(c) - 0.005, 0) / (xc[:, j] @ xc[:, j] / len(y) + 0.005)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-6)


def test_registry(panel):
    assert models_of("simple") == ["ridge", "enet", "sgd"]
    with pytest.raises(ValueError):
        models_of("huge")
    stats = label_stats(training_matrix(panel, PAIR))
    for name in FACTORIES:
        assert build(name, stats) is not None
    with pytest.raises(ValueError):
        build("oracle", stats)
    with pytest.raises(ValueError, match="no training rows"):
        fitting.fit(panel.filter("ds < '2023-01-20'"), ["ridge"])


def test_task_side_scoring_equals_transform(panel, models):
    matrix = training_matrix(panel, Design())
    x = np.stack([v.toArray() for v in matrix.toPandas()["features"]])
    for model in models.values():
        expected = model.transform(matrix).toPandas()["prediction"].to_numpy()
        assert np.allclose(portable(model).predict(x), expected, atol=1e-10)


def test_first_step_features_equal_the_windows_of_an_appended_row(panel):
    design = Design(exogenous=(), technical_shift=0)
    state = recursive.series_state(panel, design).orderBy("unique_id").toPandas()
    hist = recursive.right_aligned(state["hist"], 41)
    n, total, squares = (state[c].to_numpy(float) for c in ("n", "total", "squares"))
    smoothed = {"exponentiallyweightedmean_lag10_0_2": state["exponentiallyweightedmean_lag10_0_2"].to_numpy()}
    got = recursive.next_features(LagSpec(), hist, n, total, squares, smoothed)
    scaled = scaling.scale_in_place(panel.select("unique_id", "ds", "y"))
    last = scaled.groupBy("unique_id").agg(F.date_add(F.max("ds"), 1).alias("ds"), F.lit(0.0).alias("z"))
    longer = scaled.select("unique_id", "ds", "z").unionByName(last)
    windows = lags.add_lag_features(longer, LagSpec(), "z").join(last.select("unique_id", "ds"), ["unique_id", "ds"])
    expected = windows.orderBy("unique_id").select(*LagSpec().names).toPandas().to_numpy()
    assert np.allclose(got, expected, atol=1e-10)


def numpy_path(y, scorer, horizon, spec_lags):
    mean, std = y.mean(), y.std()
    z = list((y - mean) / std)
    for _ in range(horizon):
        z.append(float(scorer.predict(np.array([[z[-k] for k in spec_lags]]))[0]))
    return np.array(z[-horizon:]) * std + mean


def test_recursion_equals_a_plain_loop(panel):
    ar = LinearScorer(np.array([0.5, 0.2]), 0.1)
    got = recursive.forecast_targets(
        recursive.series_state(panel, PAIR), future_per_series(panel, 14), {"ar": ar}, 14, PAIR
    ).orderBy("unique_id", "step").toPandas()
    history = panel.orderBy("unique_id", "ds").toPandas()
    for uid, g in history.groupby("unique_id"):
        expected = numpy_path(g["y"].to_numpy(), ar, 14, (1, 5))
        assert np.allclose(got[got["unique_id"] == uid]["ar"], expected, atol=1e-12)


def test_price_target_is_modelled_as_changes(spark, raw_bars):
    prices = training_frame(raw_bars, target_type="price")
    design = Design(lag_spec=PAIR.lag_spec, exogenous=(), target_type="price", technical_shift=0)
    flat = LinearScorer(np.array([0.0, 0.0]))
    got = forecasting.forecast(prices, {"flat": flat}, 3, design=design).orderBy("unique_id", "ds").toPandas()
    history = prices.orderBy("unique_id", "ds").toPandas()
    for uid, g in history.groupby("unique_id"):
        drift = g["y"].diff().dropna().mean()
        assert np.allclose(got[got["unique_id"] == uid]["flat"], g["y"].iloc[-1] + drift * np.arange(1, 4))
    falling = forecasting.forecast(prices, {"f": LinearScorer(np.zeros(2), -1e6)}, 3, design=design).toPandas()
    assert (falling["f"] == 0.0).all()
    model = fitting.fit(prices, ["ridge"], design)
    fitted = fitting.fitted_values(prices, model, design).toPandas()
    assert len(fitted) == 570 - 3 * 6 and (fitted["ridge"] > 0).all()


def test_forecast_shape_ids_and_ensemble(panel, models):
    wide = forecasting.forecast(panel, models, 3, ids=["ABEL.US", "MORN.US"]).toPandas()
    assert len(wide) == 6
    assert np.allclose(wide["ensemble_mean"], wide[["ridge", "rf", "gb"]].mean(axis=1))
    assert (wide["ensemble_mean"] > 20).all()
    everyone = forecasting.forecast(panel, models, 3).toPandas().set_index(["unique_id", "ds"])
    assert np.allclose(everyone.loc[["ABEL.US", "MORN.US"]].sort_index(), wide.set_index(["unique_id", "ds"]).sort_index())


def test_requested_series_need_history(spark, panel):
    asked = spark.createDataFrame([("ABEL.US",), ("NEW.US",)], "unique_id string")
    with pytest.raises(ValueError, match="NEW.US"):
        forecasting.require_history(asked, panel)
    with pytest.raises(ValueError, match="NEW.US"):
        forecasting.forecast(panel, {}, 3, ids=["ABEL.US", "NEW.US"])


def test_a_future_of_another_length_fails_and_names_the_series(panel):
    design = Design(lag_spec=LagSpec((1,), (), (), (), (), (), ()), exogenous=(), technical_shift=0)
    state, future = recursive.series_state(panel, design), future_per_series(panel, 3)
    scorer = {"flat": LinearScorer(np.zeros(1), 0.0)}
    short = future.filter("unique_id <> 'MORN.US' or step < 3")
    none = future.filter("unique_id <> 'MORN.US'")
    for given, rows in ((short, 2), (none, 0), (future_per_series(panel, 4).filter("step < 4 or unique_id = 'MORN.US'"), 4)):
        with pytest.raises(Exception, match=f"series MORN.US has {rows} future rows"):
            recursive.forecast_targets(state, given, scorer, 3, design).collect()
        listed = recursive.unforecastable(state, given, 3).collect()
        assert [tuple(r) for r in listed] == [("MORN.US", rows)]
    assert recursive.forecast_targets(state, future, scorer, 3, design).count() == 9


def test_weighted_ridge_against_the_closed_form(panel):
    weighted = panel.withColumn("w", F.when(F.col("unique_id") == "ABEL.US", 0.05).otherwise(0.3))
    model = fitting.fit(weighted, ["ridge"], PAIR, weight_col="w")["ridge"]
    rows = training_matrix(weighted, PAIR).join(weighted.select("unique_id", "ds", "w"), ["unique_id", "ds"]).collect()
    x = np.array([r["features"].toArray() for r in rows])
    y, w = np.array([r["label"] for r in rows]), np.array([r["w"] for r in rows])
    xc, yc = x - np.average(x, axis=0, weights=w), y - np.average(y, weights=w)
    want = np.linalg.solve((xc.T * w) @ xc + np.eye(x.shape[1]), (xc.T * w) @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-6)


def test_series_end_on_their_own_dates(spark, panel):
    shorter = panel.filter("unique_id <> 'ABEL.US' or ds < '2023-09-18'")
    with pytest.raises(ValueError, match="missing future exogenous rows: 6"):
        require_future(shorter, future_per_series(panel, 14), 14)
    require_future(shorter, future_per_series(shorter, 14), 14)
    starts = future_per_series(shorter, 14).groupBy("unique_id").agg(F.min("ds").alias("ds")).collect()
    assert {r["ds"] for r in starts if r["unique_id"] == "ABEL.US"} == {dt.date(2023, 9, 18)}


def test_future_rows_equal_the_separate_operators(panel):
    design = Design()
    rows = future_rows(series_ends(panel, design), 14, design)
    joined = hold_technical(future_per_series(panel, 14), panel)
    order = ["unique_id", "ds"]
    a = rows.orderBy(*order).select(*order, *TECHNICAL_COLUMNS).toPandas()
    b = joined.orderBy(*order).select(*order, *TECHNICAL_COLUMNS).toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert rows.filter("week_of_year is null or sector_code is null or quarter is null").count() == 0


def test_short_history_forecasts_with_zero_filled_features(panel, models):
    few = panel.filter("ds < '2023-01-10'")
    wide = forecasting.forecast(few, models, 4).toPandas()
    assert len(wide) == 12 and wide.notna().all().all()


def test_cross_validation_counts_and_cutoffs(panel):
    cv, folds = crossval.cross_validate(panel, ["ridge", "gb"], design=PAIR, overrides=SMALL, with_fitted=True)
    pdf = cv.toPandas()
    assert len(pdf) == 3 * 14 * 2 and pdf["cutoff"].nunique() == 2
    assert (pdf["ds"] > pdf["cutoff"]).all() and pdf.notna().all().all()
    assert {r["fold"]: r["n"] for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {
        0: 3 * (190 - 21 - 5), 1: 3 * (190 - 14 - 5)}


def test_windows_agree_with_their_fanned_out_form(panel):
    fanned = splits.cv_windows(panel, 2, 14, 7)
    for i, offset in enumerate(splits.window_offsets(2, 7)):
        one = splits.cv_window(panel, offset, 14).select("unique_id", "ds", "role", "cutoff")
        many = fanned.filter(F.col("window") == i).select("unique_id", "ds", "role", "cutoff")
        assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_short_series_are_listed(panel):
    mixed = panel.filter("unique_id <> 'ABEL.US' or ds < '2023-02-01'")
    rows = crossval.short_series(mixed, Design(), 2, 14, 7).collect()
    assert [(r["unique_id"], r["trainable"]) for r in rows] == [("ABEL.US", False)]


def test_intervals_bracket_and_fall_back(panel):
    mixed = panel.filter("unique_id <> 'ABEL.US' or ds < '2023-01-20'")
    residuals = crossval.calibrate(mixed, ["ridge"], 5, design=PAIR)
    model = fitting.fit(mixed, ["ridge"], PAIR)
    wide = forecasting.forecast(mixed, model, 5, design=PAIR, residuals=residuals).toPandas().set_index("unique_id")
    short, rest = wide.loc["ABEL.US"], wide.drop("ABEL.US")
    assert short["ridge-lo-80"].isna().all() and short["ridge"].notna().all()
    assert (rest["ridge-lo-95"] <= rest["ridge-lo-80"]).all() and (rest["ridge-lo-80"] <= rest["ridge"]).all()
    assert (rest["ridge"] <= rest["ridge-hi-80"]).all() and (rest["ridge-hi-80"] <= rest["ridge-hi-95"]).all()


def test_update_touches_only_given_series(panel):
    history = panel.select("unique_id", "ds", "y")
    day = history.agg(F.max("ds")).first()[0]
    latest = history.filter((F.col("unique_id") == "ABEL.US") & (F.col("ds") == day)).withColumn("y", F.lit(0.5))
    merged = merge_observations(history, latest)
    assert merged.count() == 570
    assert merged.filter("y = 0.5").count() == 1
    state = recursive.series_state(history)
    fresh = refresh_state(state, history, latest).toPandas().set_index("unique_id")
    old = state.toPandas().set_index("unique_id")
    assert fresh.loc["ABEL.US", "level"] == 0.5 and fresh.loc["MORN.US", "mean"] == old.loc["MORN.US", "mean"]
    with pytest.raises(RuntimeError):
        refresh_state(None, history, latest)


def test_saved_models_forecast_the_same(spark, panel, models, tmp_path):
    design = Design()
    folder = persistence.save_models(
        spark, str(tmp_path / "m"), models, design, recursive.series_state(panel, design),
        panel.select("sector", "sector_code").distinct(),
    )
    saved = persistence.load_models(spark, folder)
    assert saved.design == design and set(saved.models) == set(models)
    future = future_rows(series_ends(panel, design), 3, design)
    a = recursive.forecast_targets(saved.state, future, saved.models, 3, saved.design).toPandas()
    b = recursive.forecast_targets(recursive.series_state(panel, design), future, models, 3, design).toPandas()
    order = ["unique_id", "step"]
    pd.testing.assert_frame_equal(a.sort_values(order, ignore_index=True), b.sort_values(order, ignore_index=True))


def test_fitted_values_cover_series_not_trained_on(panel):
    trained = fitting.fit(panel.filter("unique_id <> 'FINN.US'"), ["ridge"])
    assert fitting.fitted_values(panel, trained).filter("unique_id = 'FINN.US'").count() == 190 - 41


def test_boosting_rounds(panel):
    ranking, ahead = crossval.select_boosting_rounds(panel, rounds=(1, 2), overrides={"maxDepth": 2})
    assert ranking.count() == 2 and ahead.count() == 3 * 5


def test_every_round_count_is_scored(panel):
    """Each count up to the last is ranked, with the error of a cross-validation by that many rounds."""
    ranking, _ = crossval.select_boosting_rounds(panel, overrides={"maxDepth": 1})
    found = {r["rounds"]: r["mape"] for r in ranking.collect()}
    assert sorted(found) == list(range(1, 26)) and list(found.values()) == sorted(found.values())
    lean = crossval.selection_design(panel, Design())
    for count in (1, 13):
        cv, _ = crossval.cross_validate(
            panel, ["lgbm"], 2, 5, 5, lean, overrides={"lgbm": {"maxDepth": 1, "maxIter": count}}
        )
        seen = cv.toPandas()
        errors = ((seen["y"] - seen["lgbm"]) / seen["y"]).abs()
        assert found[count] == pytest.approx(errors.groupby(seen["cutoff"]).mean().mean())


def test_boosting_rounds_see_the_whole_model_frame(panel):
    lean = crossval.selection_design(panel, Design())
    wanted = {"dayofweek", "month", *CALENDAR_COLUMNS, *TECHNICAL_COLUMNS, *MODEL_STATICS}
    assert sorted(lean.exogenous) == sorted(wanted) and lean.technical_shift == Design().technical_shift
    fewer = panel.drop("volatility_5d", "week_of_year")
    assert set(lean.exogenous) - set(crossval.selection_design(fewer, Design()).exogenous) == {"volatility_5d", "week_of_year"}
    # a technical column that gives the next day's direction away, and its last value either way
    following = F.lead("y").over(Window.partitionBy("unique_id").orderBy("ds"))
    settings = {"maxDepth": 2, "featureSubsetStrategy": "all", "stepSize": 1.0}
    last = {}
    for ending in (-1.0, 1.0):
        told = panel.withColumn("momentum_5d", F.when(following.isNull(), ending).otherwise(F.signum(following)))
        _, ahead = crossval.select_boosting_rounds(told, rounds=(1,), overrides=settings)
        last[ending] = ahead.orderBy("unique_id", "ds").toPandas()["lgbm"]
    assert len(last[1.0]) == 3 * 5 and (last[1.0] > last[-1.0]).all()


def test_a_short_fit_is_a_prefix_of_a_long_one(panel):
    fits = {
        n: portable(fitting.fit(panel, ["lgbm"], overrides={"lgbm": {"maxDepth": 3, "maxIter": n}})["lgbm"]) for n in (2, 4)
    }
    x = np.random.default_rng(5).normal(size=(50, len(Design().features)))
    assert np.allclose(first_trees(fits[4], 2).predict(x), fits[2].predict(x))


def test_forecast_from_saved_state_equals_forecast_from_history(spark, panel, tmp_path):
    design = Design()
    models = fitting.fit(panel, ["ridge"], design)
    state = recursive.series_state(panel, design)
    folder = persistence.save_models(
        spark, str(tmp_path / "m"), models, design, state, panel.select("sector", "sector_code").distinct()
    )
    saved = persistence.load_models(spark, folder)
    order = ["unique_id", "ds"]
    known = panel.select("unique_id").first()[0]
    for ids in (None, [known]):
        a = forecasting.forecast(None, saved.models, 3, ids=ids, design=saved.design, state=saved.state).orderBy(*order).toPandas()
        b = forecasting.forecast(panel, models, 3, ids=ids, design=design).orderBy(*order).toPandas()
        pd.testing.assert_frame_equal(a, b)
    with pytest.raises(ValueError, match="NOBODY"):
        forecasting.forecast(None, saved.models, 3, ids=["NOBODY"], design=saved.design, state=saved.state)


def test_cross_validation_bounds_and_none_to_calibrate_on(panel):
    cv, _ = crossval.cross_validate(panel, ["ridge"], 1, 5, design=PAIR, levels=(80,))
    rows = cv.toPandas()
    assert (rows["ridge-lo-80"] <= rows["ridge"]).all() and (rows["ridge"] <= rows["ridge-hi-80"]).all()
    short = lags.keep_last(panel, PAIR.warm_up + 2 * 5)
    assert crossval.calibrate(short, ["ridge"], 5, design=PAIR) is None
    cv, _ = crossval.cross_validate(short, ["ridge"], 1, 5, design=PAIR, levels=(80,))
    rows = cv.toPandas()
    assert len(rows) and rows["ridge-lo-80"].isna().all()


def test_full_run_counts(spark, raw_bars, tmp_path):
    settings = Settings(enable_prediction_intervals=True, horizon=5, cv_step_size=3)
    run = full_run(spark, raw_bars, None, str(tmp_path / "run"), ["ridge"], settings)
    row = run.summary.first()
    assert (row["rows"], row["series"], row["fitted_rows"]) == (570, 3, 570 - 3 * 41)
    assert (row["cv_rows"], row["forecast_rows"], row["best_model"]) == (30, 15, "ridge")
    assert "ridge-lo-80" in run.forecasts.columns


def test_assembled_matrix_rejects_missing_values(panel):
    with pytest.raises(Exception):
        lags.feature_matrix(lags.add_lag_features(panel), ["lag1"]).collect()


def test_training_matrix_has_partitions_by_its_rows(spark, panel, monkeypatch):
    """A session with many shuffle partitions does not make a small fit pass over as many tasks."""
    seen = []

    class Estimator:
        def fit(self, matrix):
            seen.append((matrix.rdd.getNumPartitions(), matrix.count()))

    monkeypatch.setattr(fitting, "build", lambda *a: Estimator())
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    try:
        fitting.fit(panel, ["gb"], PAIR)
        assert fitting._sized(panel).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
        monkeypatch.setattr(fitting, "TASK_ROWS", 1)
        assert fitting._sized(panel) is panel
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0][1] == training_matrix(panel, PAIR).count()
    assert seen[0][0] <= 2 * spark.sparkContext.defaultParallelism
