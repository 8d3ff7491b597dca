"""Lag features, target transforms, splits, futures, models and forecasts."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stratacast.functions.series import lagged
from stratacast.operators import ensemble, future, intervals, lags, metrics, scaling, splits
from stratacast.operators.regular import regularize
from stratacast.operators.targets import last_prices
from stratacast.plans import crossval, fitting, forecasting, persistence, recursive
from stratacast.plans.design import Design
from stratacast.plans.full_run import full_run
from stratacast.plans.models import ENET_ALPHA, ENET_L1_RATIO, HUBER_ALPHA, HUBER_EPSILON, HUBER_L1_RATIO, RIDGE_ALPHA
from stratacast.plans.scorers import LinearScorer
from stratacast.plans.training import training_frame
from stratacast.schemas import MODEL_FRAME_COLUMNS, TECHNICAL_COLUMNS, LagSpec, Settings, ewm_name
from stratacast.sources.bars import brand_bars, event_bars, nation_bars, order_bars
from stratacast.sources.scratch import new_folder
from stratacast.streaming.updates import merge_observations, refresh_state
from workload.fixtures import (
    MONTH_END, ONE_LAG, SIMPLE, TWO_LAGS, customer_days, sectors, simple_ahead, simple_cv, simple_fit,
    stored_training, training, universe,
)
from workload.registry import query
from workload.views import W, future_of, scaled

KEY = "unique_id ds"
SMALL = {"gb": {"maxIter": 3, "maxDepth": 3}, "lgbm": {"maxDepth": 3}}


def _lagged(spark, d):
    return lags.add_lag_features(training(spark, d).select("unique_id", "ds", "y"))


for name, columns in (
    ("F1_lags", [f"lag{k}" for k in LagSpec().lags]),
    ("F2_expanding_mean", ["expandingmean_lag1"]),
    ("F3_expanding_std", ["expandingstd_lag1"]),
    ("F4_rolling_mean", ["rollingmean_lag5_5", "rollingmean_lag10_10", "rollingmean_lag21_21"]),
    ("F5_rolling_std", ["rollingstd_lag5_5", "rollingstd_lag21_21"]),
    ("F6_exponential_mean", ["exponentiallyweightedmean_lag10_0_2"]),
    ("F7_seasonal_mean", ["seasonalrollingmean_lag21_5_4"]),
):
    query(name, " ".join([KEY, *(f"{c}:d" for c in columns)]), "SELECT * FROM lagged")(_lagged)

FEATURES = " ".join([KEY, "y:d", *(f"{c}:d" for c in LagSpec().names)])


@query("F8_drop_warm_up", FEATURES, "SELECT * FROM lagged WHERE rn > 41")
def _(spark, d):
    return lags.drop_warm_up(_lagged(spark, d))


@query("F9_keep_last", f"{KEY} y:d", "SELECT * FROM aged WHERE age <= 450")
def _(spark, d):
    return lags.keep_last(training(spark, d), 450)


@query("F10_feature_matrix", " ".join([KEY, "label:d", *(f"{c}:d" for c in LagSpec().names), "size:i"]), f"""
    SELECT *, y AS label, {len(LagSpec().names)} AS size FROM lagged WHERE rn > 41""")
def _(spark, d):
    names = LagSpec().names
    matrix = lags.feature_matrix(lags.drop_warm_up(_lagged(spark, d)), names)
    x = vector_to_array("features")
    return matrix.select(
        "unique_id", "ds", "label", *(x[at].alias(name) for at, name in enumerate(names)), F.size(x).alias("size")
    )


KINDS = {"unique_id": "", "ds": "", **{c: ":i" for c in MODEL_FRAME_COLUMNS if c.startswith("is_")},
         "week_of_year": ":i", "sector_code": ":i", "asset_class_code": ":i"}


@query("F11_model_frame", " ".join(c + KINDS.get(c, ":d") for c in MODEL_FRAME_COLUMNS), "SELECT * FROM training")
def _(spark, d):
    return lags.model_frame(training(spark, d))


@query("G1_difference", f"{KEY} z:x", f"SELECT unique_id, ds, close - lag(close) OVER {W} AS z FROM panel")
def _(spark, d):
    return scaling.difference(training(spark, d, "price"))


@query("G2_undifference", f"{KEY} naive:d", f"""
    SELECT unique_id, ds, last_close + sum(naive) OVER {W} AS naive FROM simple_ahead""")
def _(spark, d):
    panel = training(spark, d)
    base = last_prices(panel).withColumnRenamed("last_price", "last_value")
    return scaling.undifference_path(simple_ahead(panel), base, ["naive"])


@query("G2_undifference_fitted", f"{KEY} naive:d", f"""
    SELECT unique_id, ds, naive + lag(close) OVER {W} AS naive FROM simple_fit""")
def _(spark, d):
    panel = training(spark, d)
    levels = panel.select("unique_id", "ds", F.col("close").alias("y"))
    return scaling.undifference_fitted(simple_fit(panel).select("unique_id", "ds", "naive"), levels, ["naive"])


@query("G3_local_scaler", f"{KEY} z:d", "SELECT unique_id, ds, z FROM scaled_training")
def _(spark, d):
    panel = training(spark, d)
    return scaling.scale(panel, scaling.scaler_stats(panel))


@query("G4_unscale", f"{KEY} naive:d", """
    SELECT a.unique_id, a.ds, a.naive * s.std + s.mean AS naive FROM simple_ahead a
    JOIN (SELECT DISTINCT unique_id, mean, std FROM scaled_training) s ON s.unique_id = a.unique_id""")
def _(spark, d):
    panel = training(spark, d)
    return scaling.unscale(simple_ahead(panel), scaling.scaler_stats(panel), ["naive"])


@query("H1_holdout", f"{KEY} part", """
    SELECT unique_id, ds, CASE WHEN age > 14 THEN 'train' ELSE 'test' END AS part FROM aged""")
def _(spark, d):
    train, test = splits.holdout_split(training(spark, d), 14)
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


@query("H2_rolling_windows", f"{KEY} window:i role cutoff", "SELECT * FROM splits")
def _(spark, d):
    return splits.cv_windows(training(spark, d), 2, 14, 7)


@query("I1_future_common_date", f"{KEY} is_weekend:i is_month_start:i is_month_end:i week_of_year:i month_sin:d month_cos:d", f"""
    SELECT i.unique_id, f.ds, 0 AS is_weekend, CASE WHEN day(f.ds) = 1 THEN 1 ELSE 0 END AS is_month_start,
           CASE WHEN f.ds = last_day(f.ds) THEN 1 ELSE 0 END AS is_month_end, weekofyear(f.ds) AS week_of_year,
           sin(2 * pi() * month(f.ds) / 12) AS month_sin, cos(2 * pi() * month(f.ds) / 12) AS month_cos
    FROM (SELECT DISTINCT unique_id FROM panel) i,
         (SELECT ds FROM ({future_of("(SELECT 'all' AS unique_id, max(ds) AS ds FROM panel)")})) f""")
def _(spark, d):
    panel = training(spark, d)
    last = panel.agg(F.max("ds")).first()[0]
    return future.future_from_date(panel.select("unique_id").distinct(), last, 14)


@query("I2_future_per_series", f"{KEY} step:i", future_of("order_bars"))
def _(spark, d):
    return future.future_per_series(order_bars(spark, d), 14)


@query("I3_missing_future", KEY, f"""
    SELECT unique_id, ds FROM ({future_of('order_bars')}) EXCEPT SELECT unique_id, ds FROM ({future_of('bars')})""")
def _(spark, d):
    supplied = future.future_per_series(nation_bars(spark, d), 14)
    return future.missing_future(order_bars(spark, d), supplied, 14)


@query("I4_hold_technical", " ".join([KEY, *(f"{c}:d" for c in TECHNICAL_COLUMNS)]), f"""
    SELECT f.unique_id, f.ds, {", ".join(f"coalesce(l.{c}, {1 if c == 'volume_ma_ratio' else 0}) AS {c}" for c in TECHNICAL_COLUMNS)}
    FROM (SELECT * FROM future UNION ALL SELECT * FROM ({future_of('brand_bars')})) f
    LEFT JOIN last_rows l ON l.unique_id = f.unique_id""")
def _(spark, d):
    panel = training(spark, d)
    rows = future.future_per_series(panel, 14).union(future.future_per_series(brand_bars(spark, d), 14))
    return future.hold_technical(rows, panel)


def _coefficients(spark, models):
    terms = [
        (name, term, float(value))
        for name, m in models.items()
        for term, value in zip(["intercept", "lag1", "lag5"], [m.intercept, *m.coefficients.toArray()])
    ]
    return spark.createDataFrame(terms, "model string, term string, value double")


RIDGE_TERMS = """
    SELECT 'ridge' AS model, 'intercept' AS term, w0 AS value FROM r_w
    UNION ALL SELECT 'ridge', 'lag1', w1 FROM r_w UNION ALL SELECT 'ridge', 'lag5', w5 FROM r_w"""


@query("J1_ridge", "model term value:d", RIDGE_TERMS)
def _(spark, d):
    return _coefficients(spark, fitting.fit(stored_training(spark, d), ["ridge"], TWO_LAGS))


@query("J2_elastic_net", "model term value:d", f"""
    WITH m AS (SELECT covar_pop(x, z) AS c, var_pop(x) AS v, avg(x) AS mx, avg(z) AS mz FROM (
      SELECT z, lag(z) OVER {W} AS x FROM scaled_training) WHERE x IS NOT NULL),
    w AS (SELECT *, sign(c) * greatest(abs(c) - 0.005, 0) / (v + 0.005) AS w1 FROM m)
    SELECT 'enet' AS model, 'intercept' AS term, mz - w1 * mx AS value FROM w
    UNION ALL SELECT 'enet', 'lag1', w1 FROM w""")
def _(spark, d):
    return _coefficients(spark, fitting.fit(stored_training(spark, d), ["enet"], ONE_LAG))


# Huber loss with the elastic-net penalty, by the same reweighting: each step weights rows
# by min(1, epsilon / |r|) from the last fit, then coordinate descent on two weights
HUBER_SQL = f"""
WITH RECURSIVE d AS (SELECT z AS y, x1, x5 FROM r_z WHERE x5 IS NOT NULL),
rows_ AS (SELECT count(*) AS n FROM d),
it(k, b0, b1, b5, moved) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT k + 1, my - c[1] * m1 - c[2] * m5, c[1], c[2], greatest(abs(c[1] - b1), abs(c[2] - b5), abs(my - c[1] * m1 - c[2] * m5 - b0))
  FROM (
    SELECT k, b0, b1, b5, m1, m5, my,
      list_reduce(range(200), lambda b, t: CASE WHEN t % 2 = 0
          THEN [sign(c1 - v15 * b[2]) * greatest(abs(c1 - v15 * b[2]) - {HUBER_ALPHA * HUBER_L1_RATIO}, 0) / (v11 + {HUBER_ALPHA * (1 - HUBER_L1_RATIO)}), b[2]]
          ELSE [b[1], sign(c5 - v15 * b[1]) * greatest(abs(c5 - v15 * b[1]) - {HUBER_ALPHA * HUBER_L1_RATIO}, 0) / (v55 + {HUBER_ALPHA * (1 - HUBER_L1_RATIO)})] END,
        [CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)]) AS c
    FROM (
      SELECT k, b0, b1, b5, sw, m1, m5, my,
        (s11 - sw * m1 * m1) / n AS v11, (s55 - sw * m5 * m5) / n AS v55, (s15 - sw * m1 * m5) / n AS v15,
        (s1y - sw * m1 * my) / n AS c1, (s5y - sw * m5 * my) / n AS c5
      FROM (
        SELECT k, b0, b1, b5, any_value(n) AS n, sum(w) AS sw, sum(w * x1) / sum(w) AS m1, sum(w * x5) / sum(w) AS m5,
          sum(w * y) / sum(w) AS my, sum(w * x1 * x1) AS s11, sum(w * x5 * x5) AS s55, sum(w * x1 * x5) AS s15,
          sum(w * x1 * y) AS s1y, sum(w * x5 * y) AS s5y
        FROM (SELECT k, b0, b1, b5, n, x1, x5, y, CASE WHEN k = 0 THEN 1
                     ELSE least(1, {HUBER_EPSILON} / abs(y - b0 - b1 * x1 - b5 * x5)) END AS w
              FROM it, d, rows_ WHERE moved > 1e-13 AND k < 2000)
        GROUP BY k, b0, b1, b5)))),
last_ AS (SELECT * FROM it ORDER BY k DESC LIMIT 1)
SELECT 'sgd' AS model, 'intercept' AS term, b0 AS value FROM last_
UNION ALL SELECT 'sgd', 'lag1', b1 FROM last_ UNION ALL SELECT 'sgd', 'lag5', b5 FROM last_"""


@query("J3_huber", "model term value:d", HUBER_SQL)
def _(spark, d):
    return _coefficients(spark, fitting.fit(stored_training(spark, d), ["sgd"], TWO_LAGS))


# With one two-valued feature and one tree, every tree model predicts its group means.
GROUP_MEANS = """
    SELECT s.unique_id, s.ds, g.m * s.std + s.mean AS value FROM scaled_training s
    JOIN (SELECT is_month_end, avg(z) AS m FROM scaled_training GROUP BY 1) g ON g.is_month_end = s.is_month_end"""
ONE_TREE = {"maxIter": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


def _tree_query(name):
    one = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all"} if name == "rf" else ONE_TREE

    def build(spark, d):
        panel = stored_training(spark, d)
        models = fitting.fit(panel, [name], MONTH_END, overrides={name: one})
        return fitting.fitted_values(panel, models, MONTH_END).withColumnRenamed(name, "value")
    return build


for number, name, label in (
    (4, "rf", "random_forest"), (5, "gb", "gradient_boosting"), (6, "hgb", "histogram_boosting"),
    (7, "lgbm", "leaf_boosting_preset"), (8, "xgb", "column_boosting_preset"),
):
    query(f"J{number}_{label}", f"{KEY} value:d", GROUP_MEANS)(_tree_query(name))


@query("K1_fit", "model term value:d", RIDGE_TERMS)
def _(spark, d):
    models = fitting.fit(stored_training(spark, d), ["ridge", "enet", "sgd"], TWO_LAGS)
    return _coefficients(spark, {"ridge": models["ridge"]})


def _design_terms(spark, models, design):
    terms = [
        (name, term, float(value))
        for name, m in models.items()
        for term, value in zip(["intercept", *design.features], [m.intercept, *m.coefficients.toArray()])
    ]
    terms = [(name, term, 0.0 if abs(value) < 1e-12 else value) for name, term, value in terms]
    return spark.createDataFrame(terms, "model string, term string, value double")


DEFAULT_DESIGN = Design()
_DATE_SQL = {"dayofweek": "isodow(ds) - 1", "month": "month(ds)", "quarter": "quarter(ds)",
             "week_of_month": "floor((day(ds) - 1) / 7) + 1"}


def _design_rows_sql(design: Design) -> str:
    """The model matrix of `training` in SQL: label z, x the features in the design's order."""
    shifted = ", ".join(f"lag({c}, {design.technical_shift}) OVER {W} AS shifted_{c}" for c in TECHNICAL_COLUMNS)
    parts = []
    for name in design.features:
        if name in _DATE_SQL:
            parts.append(_DATE_SQL[name])
        elif name in TECHNICAL_COLUMNS:
            parts.append(f"shifted_{name}")
        else:
            parts.append(name)
    listed = ", ".join(f"CAST({p} AS DOUBLE)" for p in parts)
    return f"SELECT z AS label, [{listed}] AS x FROM (SELECT *, {shifted} FROM lagged_z) WHERE rn > {design.warm_up}"


def _gram_sql(design: Design) -> str:
    """CTEs m (rows), mu, c (centred cells), gram, cross: the moments the fits need."""
    p = len(design.features)
    return f"""
    m AS ({_design_rows_sql(design)}),
    numbered AS (SELECT row_number() OVER () AS rid, label, x FROM m),
    cells AS (SELECT rid, label, i, x[i] AS v FROM numbered, range(1, {p + 1}) t(i)),
    mx AS (SELECT i, avg(v) AS mi FROM cells GROUP BY i),
    my AS (SELECT avg(label) AS my, count(*) AS n FROM m),
    c AS (SELECT rid, i, v - mi AS d, label - my AS dy FROM cells JOIN mx USING (i), my),
    gram AS (SELECT a.i, b.i AS j, sum(a.d * b.d) AS g FROM c a JOIN c b ON a.rid = b.rid GROUP BY 1, 2),
    cross_ AS (SELECT i, sum(d * dy) AS c FROM c GROUP BY i)"""


def _gauss_jordan(matrix: str, p: int) -> str:
    """Solve the augmented p x (p + 1) list `matrix` without pivoting (its left part is positive definite)."""
    return f"""list_reduce(range({p}), lambda acc, k: list_transform(range({p}), lambda i: list_transform(range({p + 1}),
        lambda j: CASE WHEN i = k THEN acc[k + 1][j + 1] / acc[k + 1][k + 1]
                       ELSE acc[i + 1][j + 1] - acc[i + 1][k + 1] * acc[k + 1][j + 1] / acc[k + 1][k + 1] END)),
        {matrix})"""


def _terms_sql(model: str, design: Design, solved: str) -> str:
    """Rows (model, term, value): intercept, then one per feature; |value| < 1e-12 as 0 on both sides."""
    p = len(design.features)
    names = ", ".join(f"'{n}'" for n in design.features)
    return f"""
    w AS ({solved}),
    b AS (SELECT i, w.s[i][{p + 1}] AS beta FROM w, range(1, {p + 1}) t(i)),
    t AS (SELECT 'intercept' AS term, (SELECT my FROM my) - sum(beta * mi) AS value FROM b JOIN mx USING (i)
          UNION ALL SELECT [{names}][i], beta FROM b)
    SELECT '{model}' AS model, term, CASE WHEN abs(value) < 1e-12 THEN 0.0 ELSE value END AS value FROM t"""


def _ridge_sql(design: Design) -> str:
    p = len(design.features)
    rows = f"""(SELECT list(r ORDER BY i) FROM (
        SELECT g.i, list(g.g + CASE WHEN g.i = g.j THEN {RIDGE_ALPHA} ELSE 0 END ORDER BY g.j) || [any_value(x.c)] AS r
        FROM gram g JOIN cross_ x ON x.i = g.i GROUP BY g.i))"""
    return "WITH " + _gram_sql(design) + "," + _terms_sql("ridge", design, f"SELECT {_gauss_jordan(rows, p)} AS s")


def _enet_sql(design: Design, sweeps: int = 400) -> str:
    """Coordinate descent for the support and signs, then the exact solve on that support."""
    p = len(design.features)
    lasso, square = ENET_ALPHA * ENET_L1_RATIO, ENET_ALPHA * (1 - ENET_L1_RATIO)
    update = f"""list_transform(range({p}), lambda j: CASE WHEN j <> t % {p} THEN b[j + 1] ELSE
        sign(z.cr[j + 1] - list_sum(list_transform(range({p}), lambda q: z.cv[j + 1][q + 1] * b[q + 1])) + z.cv[j + 1][j + 1] * b[j + 1])
        * greatest(abs(z.cr[j + 1] - list_sum(list_transform(range({p}), lambda q: z.cv[j + 1][q + 1] * b[q + 1]))
                       + z.cv[j + 1][j + 1] * b[j + 1]) - {lasso}, 0) / (z.cv[j + 1][j + 1] + {square}) END)"""
    return "WITH " + _gram_sql(design) + f""",
    z AS (SELECT (SELECT list(r ORDER BY i) FROM (SELECT i, list(g / (SELECT n FROM my) ORDER BY j) AS r FROM gram GROUP BY i)) AS cv,
                 (SELECT list(c / (SELECT n FROM my) ORDER BY i) FROM cross_) AS cr),
    cd AS (SELECT cv, cr, list_reduce(range({sweeps * p}), lambda b, t: {update},
                                      list_transform(range({p}), lambda q: CAST(0 AS DOUBLE))) AS b0 FROM z),
    aug AS (SELECT list_transform(range({p}), lambda i: CASE WHEN b0[i + 1] = 0
              THEN list_transform(range({p + 1}), lambda j: CASE WHEN j = i THEN CAST(1 AS DOUBLE) ELSE 0 END)
              ELSE list_transform(range({p}), lambda j: CASE WHEN b0[j + 1] = 0 THEN 0
                     ELSE cv[i + 1][j + 1] + CASE WHEN i = j THEN {square} ELSE 0 END END)
                   || [cr[i + 1] - {lasso} * sign(b0[i + 1])] END) AS a FROM cd),""" + _terms_sql(
        "enet", design, f"SELECT {_gauss_jordan('a', p)} AS s FROM aug")


TERMS = "model term value:d"


@query("J1_ridge_all_features", TERMS, _ridge_sql(DEFAULT_DESIGN))
def _(spark, d):
    return _design_terms(spark, fitting.fit(stored_training(spark, d), ["ridge"]), DEFAULT_DESIGN)


@query("J2_elastic_net_all_features", TERMS, _enet_sql(DEFAULT_DESIGN))
def _(spark, d):
    return _design_terms(spark, fitting.fit(stored_training(spark, d), ["enet"]), DEFAULT_DESIGN)


@query("K1_fit_all_features", TERMS, _ridge_sql(DEFAULT_DESIGN))
def _(spark, d):
    models = fitting.fit(stored_training(spark, d), ["ridge", "enet", "sgd"])
    return _design_terms(spark, {"ridge": models["ridge"]}, DEFAULT_DESIGN)


@query("K2_fill_missing_features", f"{KEY} naive:d mean5:d", """
    SELECT unique_id, ds, coalesce(naive, 0) AS naive, coalesce(mean5, 0) AS mean5 FROM simple_fit""")
def _(spark, d):
    return ensemble.fill_missing_features(simple_fit(training(spark, d)), SIMPLE)


@query("K3_clip_predictions", f"{KEY} price:d percent:d log:d", """
    SELECT unique_id, ds, greatest(naive, 0) AS price, greatest(naive * 2, -0.999999) AS percent, naive AS log
    FROM simple_fit WHERE naive IS NOT NULL""")
def _(spark, d):
    naive = F.col("naive")
    return simple_fit(training(spark, d)).filter("naive is not null").select(
        "unique_id", "ds",
        ensemble.clip_prediction("price", naive).alias("price"),
        ensemble.clip_prediction("percent_return", naive * 2).alias("percent"),
        ensemble.clip_prediction("log_return", naive).alias("log"),
    )


@query("K4_fitted_values", f"{KEY} ridge:d", "SELECT * FROM r_fit")
def _(spark, d):
    panel = stored_training(spark, d)
    return fitting.fitted_values(panel, fitting.fit(panel, ["ridge"], TWO_LAGS), TWO_LAGS)


@query("K5_recursive_fixed_weights", f"{KEY} step:i ar:d", f"""
    WITH RECURSIVE path AS (
      SELECT unique_id, 0 AS step, any_value(mean) AS mean, any_value(std) AS std,
             list(z ORDER BY ds) FILTER (WHERE age <= 5) AS h
      FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS age FROM scaled_training) GROUP BY 1
      UNION ALL SELECT unique_id, step + 1, mean, std, list_append(h[2:5], CAST(0.5 AS DOUBLE) * h[5] + CAST(0.2 AS DOUBLE) * h[1])
      FROM path WHERE step < 14)
    SELECT p.unique_id, f.ds, p.step, p.h[5] * p.std + p.mean AS ar
    FROM path p JOIN future f ON f.unique_id = p.unique_id AND f.step = p.step""")
def _(spark, d):
    panel = training(spark, d)
    rows = future.future_per_series(panel, 14)
    ar = LinearScorer(np.array([0.5, 0.2]))
    return recursive.forecast_targets(recursive.series_state(panel, TWO_LAGS), rows, {"ar": ar}, 14, TWO_LAGS)


@query("K5_recursive_ridge", f"{KEY} ridge:d", "SELECT unique_id, ds, ridge FROM r_ahead WHERE step > 0")
def _(spark, d):
    panel = stored_training(spark, d)
    models = fitting.fit(panel, ["ridge"], TWO_LAGS)
    return forecasting.forecast(panel, models, design=TWO_LAGS, return_prices=False)


@query("K5_forecast_all_features", f"{KEY} ridge:d gb:d ensemble_mean:d")
def _(spark, d):
    panel = stored_training(spark, d)
    models = fitting.fit(panel, ["ridge", "gb"], overrides=SMALL)
    return forecasting.forecast(panel, models)


@query("K6_forecast_requested_ids", f"{KEY} ridge:d", f"""
    SELECT a.unique_id, a.ds, l.close * exp(sum(a.ridge) OVER (PARTITION BY a.unique_id ORDER BY a.ds)) AS ridge
    FROM r_ahead a JOIN last_rows l ON l.unique_id = a.unique_id WHERE a.step > 0 AND l.sector = 'ASIA'""")
def _(spark, d):
    panel = stored_training(spark, d)
    models = fitting.fit(panel, ["ridge"], TWO_LAGS)
    # small tables lack some nations, and asking for a series without history is an error
    wanted = sectors(spark, d).filter("sector = 'ASIA'").join(panel.select("unique_id").distinct(), "unique_id", "left_semi")
    return forecasting.forecast(panel, models, ids=wanted, design=TWO_LAGS)


@query("K7_ids_without_history", "unique_id", """
    SELECT upper(ticker) AS unique_id FROM universe EXCEPT SELECT unique_id FROM customer_days""")
def _(spark, d):
    wanted = universe(spark, d).select(F.upper("ticker").alias("unique_id"))
    return forecasting.unseen_without_history(wanted, customer_days(spark, d))


@query("K7_transfer_to_unseen", f"{KEY} step:i ridge:d", f"""
    WITH RECURSIVE path AS (
      SELECT unique_id, 0 AS step, any_value(mean) AS mean, any_value(std) AS std,
             list(z ORDER BY ds) FILTER (WHERE age <= 5) AS h
      FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS age
            FROM ({scaled(f"(SELECT unique_id, ds, coalesce(ln(close / lag(close) OVER {W}), 0) AS y FROM order_panel)")})) GROUP BY 1
      UNION ALL SELECT unique_id, step + 1, mean, std, list_append(h[2:5], w0 + w1 * h[5] + w5 * h[1])
      FROM path, r_w WHERE step < 14)
    SELECT p.unique_id, f.ds, p.step, p.h[5] * p.std + p.mean AS ridge
    FROM path p JOIN ({future_of('order_panel')}) f ON f.unique_id = p.unique_id AND f.step = p.step""")
def _(spark, d):
    models = fitting.fit(stored_training(spark, d), ["ridge"], TWO_LAGS)
    unseen = training_frame(order_bars(spark, d), unique=True)
    rows = future.future_per_series(unseen, 14)
    return recursive.forecast_targets(recursive.series_state(unseen, TWO_LAGS), rows, models, 14, TWO_LAGS)


@query("K8_ensemble", f"{KEY} ensemble_mean:d", """
    SELECT unique_id, ds, CASE WHEN naive IS NULL THEN mean5 WHEN mean5 IS NULL THEN naive
      ELSE (naive + mean5) / 2 END AS ensemble_mean FROM simple_fit""")
def _(spark, d):
    return ensemble.add_ensemble(simple_fit(training(spark, d)), SIMPLE)


ASIA_ORDERS = f"""
    SELECT o.unique_id, o.ds, coalesce(ln(o.close / lag(o.close) OVER (PARTITION BY o.unique_id ORDER BY o.ds)), 0) AS y
    FROM order_panel o JOIN sectors s ON s.unique_id = o.unique_id WHERE s.sector = 'ASIA'"""


def _updates(spark, d):
    panel = training_frame(order_bars(spark, d), sectors(spark, d), unique=True)
    return panel.filter("sector = 'ASIA'").select("unique_id", "ds", "y")


@query("K9_merge_observations", f"{KEY} y:d", f"""
    SELECT coalesce(n.unique_id, t.unique_id) AS unique_id, coalesce(n.ds, t.ds) AS ds, coalesce(n.y, t.y) AS y
    FROM training t FULL JOIN ({ASIA_ORDERS}) n ON n.unique_id = t.unique_id AND n.ds = t.ds""")
def _(spark, d):
    return merge_observations(training(spark, d).select("unique_id", "ds", "y"), _updates(spark, d))


SMOOTHED = ewm_name(*LagSpec().ewm[0])


# `hist` as its length and its values in order, each with its place as weight: one number per series
@query("K9_refresh_state", f"unique_id last_ds n:i total:d squares:d mean:d std:d level:d hist_size:i hist_sum:d oldest:d newest:d {SMOOTHED}:d", f"""
    WITH merged AS (
      SELECT coalesce(n.unique_id, t.unique_id) AS unique_id, coalesce(n.ds, t.ds) AS ds, coalesce(n.y, t.y) AS y
      FROM training t FULL JOIN ({ASIA_ORDERS}) n ON n.unique_id = t.unique_id AND n.ds = t.ds),
    z AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS age FROM ({scaled('merged')}))
    SELECT unique_id, max(ds) AS last_ds, count(*) AS n, sum(z) AS total, sum(z * z) AS squares,
           any_value(mean) AS mean, any_value(std) AS std, arg_max(y, ds) AS level,
           count(*) FILTER (age <= {LagSpec().lookback}) AS hist_size,
           sum(z * ({LagSpec().lookback} + 1 - age)) FILTER (age <= {LagSpec().lookback}) AS hist_sum,
           arg_min(z, ds) FILTER (age <= {LagSpec().lookback}) AS oldest, arg_max(z, ds) AS newest,
           list_reduce(list(z ORDER BY ds) FILTER (age >= {LagSpec().ewm[0][0]}),
                       lambda s, v: CAST(0.8 AS DOUBLE) * s + CAST(0.2 AS DOUBLE) * v) AS {SMOOTHED}
    FROM z GROUP BY 1""")
def _(spark, d):
    history = training(spark, d).select("unique_id", "ds", "y")
    state = refresh_state(recursive.series_state(history), history, _updates(spark, d))
    lookback = LagSpec().lookback
    weighed = F.zip_with("hist", F.sequence(lookback + 1 - F.size("hist"), F.lit(lookback)), lambda z, place: z * place)
    return state.withColumns({
        "hist_size": F.size("hist"), "oldest": F.get("hist", F.lit(0)), "newest": F.element_at("hist", -1),
        "hist_sum": F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b),
    })


LEVELS = (80, 95)
BOUNDS = intervals.bound_names("naive", LEVELS)


@query("K10_intervals", " ".join([KEY, *(f"{b}:d" for b in BOUNDS)]), """
    WITH res AS (
      SELECT unique_id, row_number() OVER (PARTITION BY unique_id, "window" ORDER BY ds) AS step, abs(y - naive) AS e FROM simple_cv),
    reach AS (
      SELECT a.unique_id, a.ds, a.naive - r.e AS v FROM simple_ahead a JOIN res r ON r.unique_id = a.unique_id AND r.step = a.step
      UNION ALL SELECT a.unique_id, a.ds, a.naive + r.e FROM simple_ahead a JOIN res r ON r.unique_id = a.unique_id AND r.step = a.step)
    SELECT unique_id, ds, quantile_cont(v, 0.1) AS "naive-lo-80", quantile_cont(v, 0.9) AS "naive-hi-80",
           quantile_cont(v, 0.025) AS "naive-lo-95", quantile_cont(v, 0.975) AS "naive-hi-95" FROM reach GROUP BY 1, 2""")
def _(spark, d):
    panel = training(spark, d)
    residuals = intervals.calibration_residuals(simple_cv(panel), ["naive"])
    return intervals.add_intervals(simple_ahead(panel).drop("step"), residuals, ["naive"], LEVELS)


def _priced(path, base):
    """Price path of a ridge forecast from the last close of `base`."""
    return f"""
    SELECT a.unique_id, a.ds, a.step, c.close * exp(sum(a.ridge) OVER (PARTITION BY a.unique_id ORDER BY a.ds)) AS ridge
    FROM {path} a JOIN (SELECT unique_id, arg_max(close, ds) AS close FROM {base} GROUP BY 1) c
    ON c.unique_id = a.unique_id WHERE a.step > 0"""


QUANTILES = ", ".join(
    f'quantile_cont(v, {q}) AS "ridge-{side}-{level}"'
    for level, low, high in ((80, 0.1, 0.9), (95, 0.025, 0.975)) for side, q in (("lo", low), ("hi", high))
)


@query("K10_calibrated_forecast", " ".join([KEY, "ridge:d", *(f"{b}:d" for b in intervals.bound_names("ridge", LEVELS))]), f"""
    WITH res AS (
      SELECT p.unique_id, p.step, abs(t.close - p.ridge) AS e
      FROM ({_priced('c0_ahead', 'calibration0')} UNION ALL {_priced('c1_ahead', 'calibration1')}) p
      JOIN training t ON t.unique_id = p.unique_id AND t.ds = p.ds),
    point AS ({_priced('r_ahead', 'training')}),
    reach AS (
      SELECT p.*, p.ridge - r.e AS v FROM point p JOIN res r ON r.unique_id = p.unique_id AND r.step = p.step
      UNION ALL SELECT p.*, p.ridge + r.e FROM point p JOIN res r ON r.unique_id = p.unique_id AND r.step = p.step)
    SELECT unique_id, ds, any_value(ridge) AS ridge, {QUANTILES} FROM reach GROUP BY 1, 2""")
def _(spark, d):
    panel = stored_training(spark, d)
    residuals = crossval.calibrate(panel, ["ridge"], design=TWO_LAGS)
    models = fitting.fit(panel, ["ridge"], TWO_LAGS)
    return forecasting.forecast(panel, models, design=TWO_LAGS, residuals=residuals)


@query("K11_interval_fallback", "unique_id rows:i intervals_enabled", """
    SELECT unique_id, count(*) AS rows, count(*) >= 41 + 2 * 14 + 1 AS intervals_enabled
    FROM (SELECT unique_id FROM panel UNION ALL SELECT unique_id FROM event_panel) GROUP BY 1""")
def _(spark, d):
    both = regularize(nation_bars(spark, d)).union(regularize(event_bars(spark, d)))
    return intervals.series_with_intervals(both, 41, 2, 14)


FOLD_ROWS = " UNION ALL ".join(
    f"""SELECT a.unique_id, a.ds, s.cutoff, s.y, a.ridge, {i} AS fold FROM r{i}_ahead a
        JOIN splits s ON s.unique_id = a.unique_id AND s.ds = a.ds AND s."window" = {i} AND s.role = 'test'
        WHERE a.step > 0""" for i in (0, 1)
)


@query("K12_cross_validation", f"{KEY} cutoff y:d ridge:d", FOLD_ROWS)
def _(spark, d):
    return crossval.cross_validate(stored_training(spark, d), ["ridge"], design=TWO_LAGS)[0]


FOLD_BOUNDS = " UNION ALL ".join(
    f"""SELECT * FROM (
      WITH res AS (
        SELECT p.unique_id, p.step, abs(t.y - p.ridge) AS e
        FROM (SELECT * FROM f{i}c0_ahead UNION ALL SELECT * FROM f{i}c1_ahead) p
        JOIN training t ON t.unique_id = p.unique_id AND t.ds = p.ds WHERE p.step > 0),
      reach AS (
        SELECT p.unique_id, p.ds, p.ridge - r.e AS v FROM r{i}_ahead p JOIN res r ON r.unique_id = p.unique_id AND r.step = p.step
        UNION ALL SELECT p.unique_id, p.ds, p.ridge + r.e FROM r{i}_ahead p JOIN res r ON r.unique_id = p.unique_id AND r.step = p.step)
      SELECT x.*, b.* EXCLUDE (unique_id, ds) FROM (SELECT * FROM ({FOLD_ROWS}) WHERE fold = {i}) x
      JOIN (SELECT unique_id, ds, {QUANTILES} FROM reach GROUP BY 1, 2) b ON b.unique_id = x.unique_id AND b.ds = x.ds)"""
    for i in (0, 1)
)


@query("K12_cross_validation_intervals",
       " ".join([KEY, "cutoff y:d ridge:d", *(f"{b}:d" for b in intervals.bound_names("ridge", LEVELS))]), FOLD_BOUNDS)
def _(spark, d):
    return crossval.cross_validate(stored_training(spark, d), ["ridge"], design=TWO_LAGS, levels=LEVELS)[0]


@query("K12_cross_validation_summary", "model smape:d wape:d", f"""
    SELECT 'ridge' AS model, avg(abs(y - ridge) / CASE WHEN abs(y) + abs(ridge) = 0 THEN 1 ELSE (abs(y) + abs(ridge)) / 2 END) * 100 AS smape,
           sum(abs(y - ridge)) / sum(abs(y)) * 100 AS wape FROM ({FOLD_ROWS})""")
def _(spark, d):
    cv, _ = crossval.cross_validate(stored_training(spark, d), ["ridge"], design=TWO_LAGS)
    return metrics.summarize_cv(cv, ["ridge"])


@query("K13_cv_fitted_values", f"{KEY} fold:i ridge:d",
       "SELECT *, 0 AS fold FROM r0_fit UNION ALL SELECT *, 1 FROM r1_fit")
def _(spark, d):
    return crossval.cross_validate(stored_training(spark, d), ["ridge"], design=TWO_LAGS, with_fitted=True)[1]


@query("K14_boosting_rounds", f"{KEY} lgbm:d")
def _(spark, d):
    return crossval.select_boosting_rounds(stored_training(spark, d))[1]


@query("K15_save_and_load", f"{KEY} ridge:d", "SELECT unique_id, ds, ridge FROM r_ahead WHERE step > 0")
def _(spark, d):
    panel = stored_training(spark, d)
    models = fitting.fit(panel, ["ridge"], TWO_LAGS)
    codes = panel.select("sector", "sector_code").distinct()
    folder = persistence.save_models(
        spark, new_folder(spark, "saved"), models, TWO_LAGS, recursive.series_state(panel, TWO_LAGS), codes
    )
    saved = persistence.load_models(spark, folder)
    rows = future.future_per_series(panel, 14)
    return recursive.forecast_targets(saved.state, rows, saved.models, 14, saved.design)


@query("K15_forecast_from_saved_state", f"{KEY} ridge:d", f"""
    SELECT unique_id, ds, ridge FROM ({_priced('r_ahead', 'training')})""")
def _(spark, d):
    panel = stored_training(spark, d)
    folder = persistence.save_models(
        spark, new_folder(spark, "saved"), fitting.fit(panel, ["ridge"], TWO_LAGS), TWO_LAGS,
        recursive.series_state(panel, TWO_LAGS), panel.select("sector", "sector_code").distinct(),
    )
    saved = persistence.load_models(spark, folder)
    return forecasting.forecast(None, saved.models, design=saved.design, state=saved.state)


@query("K11_run_without_intervals", "series:i forecast_rows:i intervals bounds:i", """
    SELECT count(DISTINCT unique_id) AS series, 14 * count(DISTINCT unique_id) AS forecast_rows, false AS intervals, 0 AS bounds
    FROM bars""")
def _(spark, d):
    # a series of 69 days is one too short to calibrate on
    recent = lags.keep_last(regularize(nation_bars(spark, d)), 69)
    run = full_run(
        spark, recent, sectors(spark, d), new_folder(spark, "run"), ["ridge"], Settings(cv_windows=1, enable_prediction_intervals=True)
    )
    return run.summary.withColumn("bounds", F.lit(sum("-lo-" in c or "-hi-" in c for c in run.forecasts.columns)))


@query("K16_full_run", "rows:i series:i fitted_rows:i cv_rows:i forecast_rows:i intervals", """
    SELECT true AS intervals, count(*) AS rows, count(DISTINCT unique_id) AS series, count(*) - 41 * count(DISTINCT unique_id) AS fitted_rows,
           28 * count(DISTINCT unique_id) AS cv_rows, 14 * count(DISTINCT unique_id) AS forecast_rows FROM training""")
def _(spark, d):
    run = full_run(
        spark, nation_bars(spark, d), sectors(spark, d), new_folder(spark, "run"), ["ridge", "gb"],
        Settings(enable_prediction_intervals=True), SMALL,
    )
    return run.summary
