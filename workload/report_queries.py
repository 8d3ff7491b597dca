"""Error metrics and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacast.operators import ensemble, metrics, reports
from stratacast.operators.targets import last_prices, reconstruct_prices
from stratacast.plans.fitting import fit
from workload.fixtures import (
    SIMPLE, companies, customer_days, sectors, simple_ahead, simple_cv, simple_fit, stored, stored_training,
    training, universe,
)
from workload.registry import query
from workload.views import W

KEY = "unique_id ds"


def _smape(p):
    return f"avg(abs(y - {p}) / CASE WHEN abs(y) + abs({p}) = 0 THEN 1 ELSE (abs(y) + abs({p})) / 2 END) * 100"


def _wape(p):
    return f"sum(abs(y - {p})) / sum(abs(y)) * 100"


SUMMARY = " UNION ALL ".join(
    f"SELECT '{m}' AS model, {_smape(m)} AS smape, {_wape(m)} AS wape FROM simple_cv" for m in SIMPLE
)


@query("L1_smape", "unique_id smape:d", f"SELECT unique_id, {_smape('naive')} AS smape FROM simple_cv GROUP BY 1")
def _(spark, d):
    return simple_cv(training(spark, d)).groupBy("unique_id").agg(
        metrics.smape(F.col("y"), F.col("naive")).alias("smape")
    )


@query("L2_wape", "unique_id wape:d", f"SELECT unique_id, {_wape('naive')} AS wape FROM simple_cv GROUP BY 1")
def _(spark, d):
    return simple_cv(training(spark, d)).groupBy("unique_id").agg(
        metrics.wape(F.col("y"), F.col("naive")).alias("wape")
    )


@query("L3_model_ranking", "model smape:d wape:d", SUMMARY)
def _(spark, d):
    return metrics.summarize_cv(simple_cv(training(spark, d)), SIMPLE)


@query("L4_best_model", "best_model", f"SELECT arg_min(model, smape) AS best_model FROM ({SUMMARY})")
def _(spark, d):
    return metrics.best_model(metrics.summarize_cv(simple_cv(training(spark, d)), SIMPLE))


@query("L5_mape", "unique_id mape:d", """
    SELECT unique_id, avg(abs((y - naive) / nullif(y, 0))) AS mape FROM simple_cv GROUP BY 1""")
def _(spark, d):
    return simple_cv(training(spark, d)).groupBy("unique_id").agg(
        metrics.mape(F.col("y"), F.col("naive")).alias("mape")
    )


@query("M1_prediction_records", f"{KEY} model_name value:d", """
    SELECT unique_id, ds, 'naive' AS model_name, naive AS value FROM simple_ahead
    UNION ALL SELECT unique_id, ds, 'mean5', mean5 FROM simple_ahead""")
def _(spark, d):
    return reports.prediction_records(simple_ahead(training(spark, d)), SIMPLE)


@query("M2_history", f"{KEY} value:x", "SELECT unique_id, ds, close AS value FROM aged WHERE age <= 60")
def _(spark, d):
    return reports.history(training(spark, d), last_n=60)


BACKTEST = f"""
    SELECT unique_id, ds, base * exp(naive) AS naive, base * exp(mean5) AS mean5 FROM (
      SELECT *, coalesce(lag(close) OVER {W}, close) AS base,
             row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS age FROM simple_fit) WHERE age <= 50"""
BACKTEST_LONG = f"""
    SELECT unique_id, ds, 'naive' AS model_name, naive AS value FROM ({BACKTEST})
    UNION ALL SELECT unique_id, ds, 'mean5', mean5 FROM ({BACKTEST})
    UNION ALL SELECT unique_id, ds, 'ensemble_mean', (naive + mean5) / 2 FROM ({BACKTEST})"""


def _backtest(panel):
    return reports.backtest(simple_fit(panel), panel, SIMPLE, "log_return", last_n=50)


@query("M3_backtest", f"{KEY} model_name value:d", BACKTEST_LONG)
def _(spark, d):
    return _backtest(training(spark, d))


@query("M4_available_series", "unique_id", "SELECT DISTINCT unique_id FROM customer_days")
def _(spark, d):
    return reports.available_series(stored(customer_days(spark, d), "days"))


@query("M4_configured_series", "unique_id", "SELECT DISTINCT upper(ticker) AS unique_id FROM universe")
def _(spark, d):
    listed = universe(spark, d)
    return reports.available_series(None, listed.union(listed))


COMPANY = "ticker symbol name sector has_data"


@query("M5_companies_with_data", COMPANY, "SELECT * FROM listing WHERE has_data")
def _(spark, d):
    return reports.companies_with_data(universe(spark, d), companies(spark, d), customer_days(spark, d))


def _listing(spark, d):
    return reports.all_companies(universe(spark, d), companies(spark, d), customer_days(spark, d))


query("M6_all_companies", COMPANY, "SELECT * FROM listing")(_listing)


@query("M6_company_counts", "total:i available:i", "SELECT count(*) AS total, count(*) FILTER (has_data) AS available FROM listing")
def _(spark, d):
    return reports.company_counts(_listing(spark, d))


@query("M7_company_info", "ticker name sector", """
    SELECT u.ticker, c.name, c.sector FROM universe u
    LEFT JOIN companies c ON c.ticker = replace(upper(u.ticker), '.US', '')""")
def _(spark, d):
    return reports.company_info(universe(spark, d), companies(spark, d))


@query("M8_sectors", "sector", "SELECT DISTINCT sector FROM listing WHERE has_data")
def _(spark, d):
    return reports.sectors(_listing(spark, d).filter("has_data"))


@query("M9_company_search", COMPANY, """
    SELECT * FROM listing WHERE sector = 'NATION_3' AND (contains(lower(ticker), '1') OR contains(lower(name), '1') OR contains(lower(symbol), '1'))""")
def _(spark, d):
    return reports.search_companies(_listing(spark, d), "NATION_3", " 1 ")


@query("M10_data_statistics", "rows:i companies:i start end", """
    SELECT count(*) AS rows, count(DISTINCT unique_id) AS companies, min(ds) AS start, max(ds) AS "end" FROM training""")
def _(spark, d):
    return reports.data_statistics(training(spark, d))


@query("M11_run_summary", "rows:i unique_series:i start end trained_models", """
    SELECT count(*) AS rows, count(DISTINCT unique_id) AS unique_series, min(ds) AS start, max(ds) AS "end",
           'enet,ridge' AS trained_models FROM training""")
def _(spark, d):
    panel = stored_training(spark, d)
    return reports.run_summary(panel, list(fit(panel, ["ridge", "enet"]))).withColumn(
        "trained_models", F.array_join("trained_models", ",")
    )


@query("M12_training_subset", f"{KEY} y:d", "SELECT * FROM training WHERE sector = 'ASIA'")
def _(spark, d):
    return reports.training_subset(stored_training(spark, d), sectors(spark, d).filter("sector = 'ASIA'"))


@query("M13_aligned_lines", f"{KEY} actual:d predicted:d forecast:d", f"""
    WITH hist AS (SELECT unique_id, ds, close AS actual FROM aged WHERE age <= 60),
    past AS (SELECT unique_id, ds, value AS predicted FROM ({BACKTEST_LONG}) WHERE model_name = 'ensemble_mean'),
    prices AS (SELECT unique_id, ds, last_close * exp(sum(naive) OVER {W}) AS naive,
                      last_close * exp(sum(mean5) OVER {W}) AS mean5 FROM simple_ahead),
    line AS (SELECT unique_id, ds, (naive + mean5) / 2 AS forecast FROM prices
             UNION ALL SELECT unique_id, ds, actual FROM hist WHERE ds = (SELECT max(ds) FROM hist)),
    keys AS (SELECT unique_id, ds FROM hist UNION SELECT unique_id, ds FROM past UNION SELECT unique_id, ds FROM line)
    SELECT k.unique_id, k.ds, h.actual, p.predicted, l.forecast FROM keys k
    LEFT JOIN hist h ON h.unique_id = k.unique_id AND h.ds = k.ds
    LEFT JOIN past p ON p.unique_id = k.unique_id AND p.ds = k.ds
    LEFT JOIN (SELECT unique_id, ds, max(forecast) AS forecast FROM line GROUP BY 1, 2) l
      ON l.unique_id = k.unique_id AND l.ds = k.ds""")
def _(spark, d):
    panel = stored_training(spark, d)
    prices = reconstruct_prices(simple_ahead(panel).drop("step"), last_prices(panel), SIMPLE, "log_return")
    ahead = reports.prediction_records(
        ensemble.add_ensemble(prices, SIMPLE), ensemble.with_ensemble(SIMPLE)
    )
    return reports.aligned_lines(
        stored(reports.history(panel, last_n=60), "lines"), _backtest(panel), stored(ahead, "lines"), ensemble.with_ensemble(SIMPLE)
    )
