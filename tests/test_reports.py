import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratacast.operators import ensemble, intervals, metrics, reports

DAY = dt.date(2024, 1, 1)


def test_metrics_zero_guards(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0)], "y double, p double")
    y, p = F.col("y"), F.col("p")
    assert tuple(df.agg(metrics.smape(y, p), metrics.wape(y, p), metrics.mape(y, p)).first()) == (0.0, 0.0, None)
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 180.0), (None, 3.0), (5.0, None)], "y double, p double")
    got = df.agg(metrics.smape(y, p), metrics.wape(y, p), metrics.mape(y, p)).first()
    assert got[0] == pytest.approx((10 / 105 + 20 / 190) / 2 * 100)
    assert got[1] == pytest.approx(10.0) and got[2] == pytest.approx(0.1)


def test_summary_ranks_models_and_puts_empty_ones_last(spark):
    cv = spark.createDataFrame(
        [("A", DAY, DAY, 1.0, 1.5, 1.1, None), ("A", DAY, DAY, 2.0, 2.5, 2.1, None)],
        "unique_id string, ds date, cutoff date, y double, lin double, rf double, none double",
    )
    summary = metrics.summarize_cv(cv, ["lin", "rf", "none"])
    assert [r["model"] for r in summary.collect()] == ["rf", "lin", "none"]
    assert metrics.best_model(summary).first()[0] == "rf"
    assert metrics.best_model(summary.limit(0)).first()[0] is None


def test_ensemble_skips_missing_and_needs_two_models(spark):
    df = spark.createDataFrame([(100.0, 110.0), (None, 4.0), (None, None)], "a double, b double")
    assert [r["ensemble_mean"] for r in ensemble.add_ensemble(df, ["a", "b"]).collect()] == [105.0, 4.0, None]
    assert "ensemble_mean" not in ensemble.add_ensemble(df, ["a", "zzz"]).columns


def test_cleanup_and_clip(spark):
    df = spark.createDataFrame([(float("nan"), None, "x"), (1.5, 2, None)], "a double, b int, c string")
    assert [tuple(r) for r in ensemble.fill_missing_features(df).collect()] == [(0.0, 0, "x"), (1.5, 2, None)]
    v = F.lit(-2.0)
    row = df.select(*(ensemble.clip_prediction(t, v) for t in ("price", "percent_return", "log_return"))).first()
    assert tuple(row) == (0.0, -0.999999, -2.0)


def test_records_leave_bounds_out(spark):
    df = spark.createDataFrame([("A", DAY, 1.0, 0.5, 1.5)], "unique_id string, ds date, lin double, lo double, hi double")
    df = df.withColumnsRenamed({"lo": "lin-lo-80", "hi": "lin-hi-80"})
    assert [tuple(r) for r in reports.prediction_records(df, ["lin"]).collect()] == [("A", DAY, "lin", 1.0)]


def test_quantiles_interpolate(spark):
    import numpy as np
    values = [1.0, 2.5, 4.0, 9.0]
    arr = F.array(*(F.lit(v) for v in values))
    for q in (0.0, 0.025, 0.1, 0.5, 0.9, 1.0):
        assert spark.range(1).select(intervals.quantile_of(arr, q)).first()[0] == pytest.approx(np.quantile(values, q))


@pytest.fixture()
def market(spark):
    universe = spark.createDataFrame([(1, "abel.us"), (2, "brk-b.us"), (3, "zzz.us")], "position int, ticker string")
    companies = spark.createDataFrame(
        [("ABEL", "Apple", "Tech"), ("BRK.B", "Berkshire", "Finance")], "ticker string, name string, sector string")
    training = spark.createDataFrame([("ABEL.US", DAY, 1.0), ("ZZZ.US", DAY, 2.0)], "unique_id string, ds date, close double")
    return universe, companies, training


def test_companies(market):
    universe, companies, training = market
    listing = reports.all_companies(universe, companies, training)
    rows = {r["ticker"]: (r["symbol"], r["name"], r["sector"], r["has_data"]) for r in listing.collect()}
    assert rows == {
        "ABEL.US": ("ABEL", "Apple", "Tech", True), "BRK-B.US": ("BRK-B", "Berkshire", "Finance", False),
        "ZZZ.US": ("ZZZ", "ZZZ", "Unknown", True),
    }
    assert tuple(reports.company_counts(listing).first()) == (3, 2)
    assert {r["ticker"] for r in reports.companies_with_data(universe, companies, training).collect()} == {"ABEL.US", "ZZZ.US"}
    assert [r[0] for r in reports.sectors(listing).collect()] == ["Finance", "Tech", "Unknown"]
    assert reports.search_companies(listing, text=" berk ").count() == 1
    assert reports.search_companies(listing, sector="Tech", text="berk").count() == 0
    assert reports.search_companies(listing, text="  ").count() == 3
    info = reports.company_info(universe, companies)
    assert info.filter("name is null").count() == 1


def test_available_series_falls_back(market):
    universe, _, training = market
    assert [r[0] for r in reports.available_series(training).collect()] == ["ABEL.US", "ZZZ.US"]
    listed = universe.union(universe)
    assert [r[0] for r in reports.available_series(training.limit(0), listed).collect()] == ["ABEL.US", "BRK-B.US", "ZZZ.US"]


def test_training_subset_raises_when_empty(market):
    training = market[2]
    assert reports.training_subset(training, ["ABEL.US"]).count() == 1
    with pytest.raises(ValueError):
        reports.training_subset(training, ["NONE"])


def test_aligned_lines_anchor_on_the_last_actual(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(4)]
    actual = spark.createDataFrame([("A", days[0], 1.0), ("A", days[1], 2.0), ("B", days[0], 5.0)], "unique_id string, ds date, value double")
    record = "unique_id string, ds date, model_name string, value double"
    fitted = spark.createDataFrame([("A", days[1], "m", 1.9), ("A", days[1], "other", 9.0)], record)
    ahead = spark.createDataFrame([("A", days[2], "m", 2.2), ("B", days[2], "m", 5.5)], record)
    rows = {(r["unique_id"], r["ds"]): tuple(r)[2:] for r in reports.aligned_lines(actual, fitted, ahead, ["m"]).collect()}
    assert rows == {
        ("A", days[0]): (1.0, None, None), ("A", days[1]): (2.0, 1.9, 2.0), ("A", days[2]): (None, None, 2.2),
        ("B", days[0]): (5.0, None, None), ("B", days[2]): (None, None, 5.5),
    }
