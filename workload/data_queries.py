"""Sources, cleansing, regularisation, targets, calendar and technical features."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacast.functions.calendar import add_calendar_features, add_date_features
from stratacast.operators import cleanse, regular, statics, targets, technical
from stratacast.plans.training import series_sectors
from stratacast.schemas import BAR_VALUES, TECHNICAL_COLUMNS
from stratacast.sources import price_files, symbols, tables
from stratacast.sources.bars import (
    brand_bars, event_bars, nation_bars, order_bars, resample_bars,
)
from stratacast.sources.scratch import new_folder
from workload.fixtures import (
    SIMPLE, quotes, sectors, simple_ahead, simple_fit, stored, table, training, universe,
)
from workload.registry import query
from workload.views import W

KEY = "unique_id ds"
BAR = f"{KEY} open:x high:x low:x close:x volume:d"
LINE = " ".join(["l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:x l_extendedprice:x",
                 "l_discount:x l_tax:x l_returnflag l_linestatus l_shipdate"])


@query("A1_parquet_scan", LINE, "SELECT * FROM lineitem")
def _(spark, d):
    return tables.load_table(spark, f"{d}/lineitem.parquet")


@query("A2_parquet_sink", BAR, "SELECT * FROM bars")
def _(spark, d):
    path = new_folder(spark, "bars")
    tables.save_table(nation_bars(spark, d), path)
    return tables.load_table(spark, path)


@query("A3_json_report", "unique_id last_price:x last_ds",
       "SELECT unique_id, arg_max(close, ds) AS last_price, CAST(max(ds) AS VARCHAR) AS last_ds FROM bars GROUP BY 1")
def _(spark, d):
    path = new_folder(spark, "report")
    tables.save_report(targets.last_prices(nation_bars(spark, d)), path)
    return spark.read.schema("unique_id string, last_price double, last_ds string").json(path)


@query("A4_price_csv_scan", BAR, "SELECT unique_id, CAST(ds AS TIMESTAMP) AS ds, open, high, low, close, volume FROM bars")
def _(spark, d):
    path = new_folder(spark, "csv")
    price_files.write_price_csv(nation_bars(spark, d), path)
    return price_files.read_price_csv(spark, path)


ISSUE = """
    CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(text) < 50 THEN 'too_short'
         WHEN contains(text, 'No data') OR contains(text, 'Exceeded') THEN 'refused'
         WHEN contains(lower(text), '<html') OR contains(lower(text), '<!doctype') THEN 'markup'
         WHEN NOT (contains(split_part(text, chr(10), 1), 'Date') AND contains(split_part(text, chr(10), 1), 'Close'))
         THEN 'no_header' END"""


@query("A5_payload_quarantine", "source item:i valid issue", f"""
    SELECT source, item, issue IS NULL AS valid, issue FROM (SELECT source, item, {ISSUE} AS issue FROM (
      SELECT 'page' AS source, page_id AS item, html AS text FROM pages
      UNION ALL SELECT 'document', doc_id, text FROM documents
      UNION ALL SELECT 'headed', doc_id, 'Date,Open,High,Low,Close,Volume' || chr(10) || text FROM documents))""")
def _(spark, d):
    documents = table(spark, d, "documents")
    headed = F.concat(F.lit("Date,Open,High,Low,Close,Volume\n"), F.col("text"))
    payloads = (
        table(spark, d, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("item"), F.col("html").alias("text"))
        .union(documents.select(
            F.col("doc_id"), F.explode(F.create_map(F.lit("document"), F.col("text"), F.lit("headed"), headed)).alias("source", "text")
        ).select("source", "doc_id", "text"))
    )
    issue = price_files.payload_issue(F.col("text"))
    return payloads.withColumn("issue", issue).withColumn("valid", F.col("issue").isNull())


@query("A6_vendor_rename", BAR, "SELECT unique_id, CAST(ds AS TIMESTAMP) AS ds, open, high, low, close, volume FROM bars")
def _(spark, d):
    bars = nation_bars(spark, d)
    vendor = bars.select(
        "unique_id", F.col("ds").cast("timestamp").alias("Date"),
        *(F.col(c).alias(c.capitalize()) for c in BAR_VALUES),
    )
    return price_files.from_vendor(vendor, F.col("unique_id"))


@query("A7_combine_sources", BAR, """
    SELECT * FROM bars UNION ALL SELECT * FROM brand_bars UNION ALL SELECT * FROM event_bars""")
def _(spark, d):
    sources = [nation_bars(spark, d), brand_bars(spark, d), event_bars(spark, d)]
    return tables.combine([stored(frame, "bars") for frame in sources], ordered=True)


@query("A8_ticker_to_symbol", "ticker symbol",
       "SELECT ticker, upper(regexp_replace(ticker, '\\.us$', '', 'i')) AS symbol FROM universe")
def _(spark, d):
    return universe(spark, d).withColumn("symbol", symbols.ticker_to_symbol(F.col("ticker")))


@query("A9_symbol_to_ticker", "c_name ticker", "SELECT c_name, upper(c_name) || '.US' AS ticker FROM customer")
def _(spark, d):
    return table(spark, d, "customer").withColumn("ticker", symbols.symbol_to_ticker(F.col("c_name")))


@query("A10_date_range", "l_orderkey:i ds",
       "SELECT l_orderkey, l_shipdate AS ds FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1999-01-01'")
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("ds"))
    start, end = (F.lit(day).cast("timestamp_ntz") for day in ("1997-01-01", "1999-01-01"))
    return tables.restrict_dates(lines, start, end)


@query("A11_universe", BAR, "SELECT * FROM bars WHERE unique_id IN (SELECT unique_id FROM sectors WHERE sector = 'ASIA')")
def _(spark, d):
    return tables.restrict_universe(nation_bars(spark, d), sectors(spark, d).filter("sector = 'ASIA'"))


@query("A12_resample_weekly", BAR, """
    SELECT unique_id, CAST(date_trunc('week', ds) AS DATE) AS ds, arg_min(open, ds) AS open, max(high) AS high,
           min(low) AS low, arg_max(close, ds) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""")
def _(spark, d):
    return resample_bars(nation_bars(spark, d), "w")


@query("A12_resample_monthly", BAR, """
    SELECT unique_id, CAST(date_trunc('month', ds) AS DATE) AS ds, arg_min(open, ds) AS open, max(high) AS high,
           min(low) AS low, arg_max(close, ds) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""")
def _(spark, d):
    return resample_bars(nation_bars(spark, d), "m")


QUOTE = f"{KEY} open high:x low:x close:x volume:x"


# text forms of doubles differ between engines, so the price column that is text is compared as a number
@query("B1_normalize_keys", f"{KEY} open:x refused:i high:x low:x close:x volume:x", """
    SELECT upper(unique_id) AS unique_id, CAST(ds AS DATE) AS ds, TRY_CAST(open AS DOUBLE) AS open,
           CASE WHEN open = 'R' THEN 1 ELSE 0 END AS refused, high, low, close, volume FROM quotes""")
def _(spark, d):
    return cleanse.normalize_keys(quotes(spark, d)).withColumns({
        "open": F.col("open").try_cast("double"), "refused": (F.col("open") == "R").cast("int"),
    })


@query("B2_coerce_numeric", QUOTE.replace("open ", "open:x "), "SELECT unique_id, ds, TRY_CAST(open AS DOUBLE) AS open, high, low, close, volume FROM quotes")
def _(spark, d):
    return cleanse.coerce_numeric(quotes(spark, d))


@query("B3_drop_incomplete", BAR, "SELECT * FROM typed_quotes WHERE open IS NOT NULL")
def _(spark, d):
    return cleanse.drop_incomplete(cleanse.coerce_numeric(cleanse.normalize_keys(quotes(spark, d))))


@query("B4_keep_traded", BAR, "SELECT * FROM traded_quotes")
def _(spark, d):
    return cleanse.keep_traded(
        cleanse.drop_incomplete(cleanse.coerce_numeric(cleanse.normalize_keys(quotes(spark, d))))
    )


@query("B5_deduplicate", BAR, "SELECT * FROM clean_quotes")
def _(spark, d):
    return cleanse.cleanse(quotes(spark, d))


@query("B6_business_calendar", BAR, "SELECT * FROM aligned")
def _(spark, d):
    return regular.business_calendar(nation_bars(spark, d))


@query("B7_fill_prices", f"{KEY} open:x high:x low:x close:x", "SELECT * FROM panel")
def _(spark, d):
    return regular.fill_prices(regular.business_calendar(nation_bars(spark, d)))


@query("B8_fill_volume", f"{KEY} volume:i", "SELECT * FROM panel")
def _(spark, d):
    return regular.fill_volume(regular.business_calendar(nation_bars(spark, d)))


PANEL = f"{KEY} open:x high:x low:x close:x volume:i"


@query("B6_B8_regularize", PANEL, "SELECT * FROM quote_panel")
def _(spark, d):
    return regular.regularize(cleanse.cleanse(quotes(spark, d)))


@query("B6_B8_regularize_sparse", PANEL, "SELECT * FROM order_panel")
def _(spark, d):
    return regular.regularize(order_bars(spark, d))


@query("B6_B8_regularize_events", PANEL, "SELECT * FROM event_panel")
def _(spark, d):
    return regular.regularize(event_bars(spark, d))


MIXED = "(SELECT * FROM bars UNION ALL SELECT * FROM brand_bars)"


@query("B9_sector_lookup", f"{KEY} sector", f"""
    SELECT b.unique_id, b.ds, coalesce(s.sector, 'Unknown') AS sector
    FROM {MIXED} b LEFT JOIN sectors s ON s.unique_id = b.unique_id""")
def _(spark, d):
    return statics.add_sector(nation_bars(spark, d).union(brand_bars(spark, d)), sectors(spark, d))


@query("B10_asset_class", f"{KEY} asset_class asset_class_code:i", "SELECT unique_id, ds, 'equity' AS asset_class, 1 AS asset_class_code FROM bars")
def _(spark, d):
    return statics.add_asset_class(nation_bars(spark, d))


@query("B11_sector_code", f"{KEY} sector sector_code:i", f"""
    SELECT unique_id, ds, sector, dense_rank() OVER (ORDER BY sector) AS sector_code FROM (
      SELECT b.unique_id, b.ds, coalesce(s.sector, 'Unknown') AS sector
      FROM {MIXED} b LEFT JOIN sectors s ON s.unique_id = b.unique_id)""")
def _(spark, d):
    # codes are found on one row per series and join the facts by series, as in the training frame
    bars = stored(nation_bars(spark, d).union(brand_bars(spark, d)), "bars")
    named = series_sectors(bars.select("unique_id").distinct(), sectors(spark, d))
    return bars.join(named, "unique_id", "left")


@query("B12_sample_weight", f"{KEY} sample_weight:d", """
    SELECT unique_id, ds, greatest(volume / max(volume) OVER (PARTITION BY unique_id), CAST(0.05 AS DOUBLE)) AS sample_weight FROM bars""")
def _(spark, d):
    return statics.add_sample_weight(nation_bars(spark, d))


RULES = [
    "unique_id_filled", "sector_filled", "asset_class_filled", "ds_present", "y_present",
    *(f"{c}_positive" for c in (*BAR_VALUES, "sample_weight", "sector_code", "asset_class_code")),
    "is_weekend_flag", "is_month_start_flag", "is_month_end_flag", "week_of_year_range",
]
UNBROKEN = ", ".join(f"0 AS {rule}" for rule in RULES if rule not in ("close_positive", "volume_positive"))


@query("B13_rule_counts", " ".join(f"{r}:i" for r in RULES), f"""
    SELECT count(*) FILTER (close - 900 <= 0) AS close_positive, count(*) FILTER (volume - 30 <= 0) AS volume_positive,
           {UNBROKEN} FROM training""")
def _(spark, d):
    spoiled = training(spark, d).withColumns({"close": F.col("close") - 900, "volume": F.col("volume") - 30})
    return cleanse.rule_counts(spoiled)


@query("B13_violations", f"{KEY} broken", """
    SELECT unique_id, ds, concat_ws(',', CASE WHEN close - 900 <= 0 THEN 'close_positive' END,
      CASE WHEN volume - 30 <= 0 THEN 'volume_positive' END) AS broken
    FROM training WHERE close - 900 <= 0 OR volume - 30 <= 0""")
def _(spark, d):
    spoiled = training(spark, d).withColumns({"close": F.col("close") - 900, "volume": F.col("volume") - 30})
    return cleanse.violations(spoiled).withColumn("broken", F.array_join("broken", ","))


@query("B14_quality_report", "rows:i series:i start end missing_rate:d target_type", """
    SELECT count(*) AS rows, count(DISTINCT unique_id) AS series, min(ds) AS start, max(ds) AS "end",
      (avg(CAST(open IS NULL AS INT)) + avg(CAST(high IS NULL AS INT)) + avg(CAST(low IS NULL AS INT))
       + avg(CAST(close IS NULL AS INT)) + avg(CAST(volume IS NULL AS INT))) / 7 AS missing_rate,
      'log_return' AS target_type FROM aligned""")
def _(spark, d):
    return cleanse.quality_report(regular.business_calendar(nation_bars(spark, d)), "log_return")


@query("C1_price_target", f"{KEY} y:x", "SELECT unique_id, ds, close AS y FROM panel")
def _(spark, d):
    return targets.add_target(regular.regularize(nation_bars(spark, d)), "price")


@query("C2_log_return", f"{KEY} y:d", f"SELECT unique_id, ds, coalesce(ln(close / lag(close) OVER {W}), 0) AS y FROM panel")
def _(spark, d):
    return targets.add_target(regular.regularize(nation_bars(spark, d)), "log_return")


@query("C3_percent_return", f"{KEY} y:d", f"SELECT unique_id, ds, coalesce(close / lag(close) OVER {W} - 1, 0) AS y FROM panel")
def _(spark, d):
    return targets.add_target(regular.regularize(nation_bars(spark, d)), "percent_return")


@query("C4_invert_log_path", f"{KEY} naive:d mean5:d", f"""
    SELECT unique_id, ds, last_close * exp(sum(naive) OVER {W}) AS naive, last_close * exp(sum(mean5) OVER {W}) AS mean5 FROM simple_ahead""")
def _(spark, d):
    panel = training(spark, d)
    return targets.reconstruct_prices(simple_ahead(panel), targets.last_prices(panel), SIMPLE, "log_return")


@query("C5_invert_percent_path", f"{KEY} naive:d mean5:d", f"""
    SELECT unique_id, ds, last_close * product(1 + naive) OVER {W} AS naive, last_close * product(1 + mean5) OVER {W} AS mean5 FROM simple_ahead""")
def _(spark, d):
    panel = training(spark, d)
    return targets.reconstruct_prices(simple_ahead(panel), targets.last_prices(panel), SIMPLE, "percent_return")


@query("C6_reconstruct_unknown_base", f"{KEY} naive:d mean5:d", f"""
    SELECT unique_id, ds, base * exp(sum(naive) OVER {W}) AS naive, base * exp(sum(mean5) OVER {W}) AS mean5 FROM (
      SELECT a.*, CASE WHEN s.sector = 'ASIA' THEN a.last_close ELSE 1 END AS base
      FROM simple_ahead a JOIN sectors s ON s.unique_id = a.unique_id)""")
def _(spark, d):
    panel = training(spark, d)
    known = targets.last_prices(panel.filter("sector = 'ASIA'"))
    return targets.reconstruct_prices(simple_ahead(panel), known, SIMPLE, "log_return")


@query("C7_last_prices", "unique_id last_price:x last_ds", """
    SELECT unique_id, arg_max(close, ds) AS last_price, max(ds) AS last_ds FROM brand_bars GROUP BY 1""")
def _(spark, d):
    return targets.last_prices(brand_bars(spark, d))


@query("C8_one_step_prices", f"{KEY} naive:d mean5:d", f"""
    SELECT unique_id, ds, coalesce(lag(close) OVER {W}, close) * exp(naive) AS naive,
           coalesce(lag(close) OVER {W}, close) * exp(mean5) AS mean5 FROM simple_fit""")
def _(spark, d):
    panel = training(spark, d)
    return targets.reconstruct_fitted_prices(
        simple_fit(panel).select("unique_id", "ds", *SIMPLE), panel, SIMPLE, "log_return"
    )


@query("D1_D5_calendar_features", "l_orderkey:i ds is_weekend:i is_month_start:i is_month_end:i week_of_year:i month_sin:d month_cos:d", """
    SELECT l_orderkey, l_shipdate AS ds, CASE WHEN isodow(l_shipdate) >= 6 THEN 1 ELSE 0 END AS is_weekend,
      CASE WHEN day(l_shipdate) = 1 THEN 1 ELSE 0 END AS is_month_start,
      CASE WHEN CAST(l_shipdate AS DATE) = last_day(l_shipdate) THEN 1 ELSE 0 END AS is_month_end,
      weekofyear(l_shipdate) AS week_of_year, sin(2 * pi() * month(l_shipdate) / 12) AS month_sin,
      cos(2 * pi() * month(l_shipdate) / 12) AS month_cos FROM lineitem""")
def _(spark, d):
    return add_calendar_features(
        table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("ds"))
    )


@query("D6_D7_date_features", "event_id:i ds dayofweek:i month:i quarter:i week_of_month:i", """
    SELECT event_id, ts AS ds, isodow(ts) - 1 AS dayofweek, month(ts) AS month, quarter(ts) AS quarter,
           (day(ts) - 1) // 7 + 1 AS week_of_month FROM events""")
def _(spark, d):
    return add_date_features(table(spark, d, "events").select("event_id", F.col("ts").alias("ds")))


def _technical(spark, d):
    return technical.add_technical_features(regular.regularize(nation_bars(spark, d)))


for name, columns in (
    ("E1_volatility", "volatility_5d volatility_20d"), ("E2_momentum", "momentum_5d momentum_20d"),
    ("E3_range", "range_pct"), ("E4_volume_ratio", "volume_ma_ratio"),
):
    query(name, " ".join([KEY, *(f"{c}:d" for c in columns.split())]), "SELECT * FROM training")(_technical)

TRAINING = " ".join([
    PANEL, "y:d sector asset_class sector_code:i asset_class_code:i sample_weight:d is_weekend:i is_month_start:i",
    "is_month_end:i week_of_year:i month_sin:d month_cos:d", *(f"{c}:d" for c in TECHNICAL_COLUMNS),
])


@query("E5_training_frame", TRAINING, "SELECT * FROM training")
def _(spark, d):
    return training(spark, d)


@query("E6_static_features", "unique_id sector asset_class sector_code:i asset_class_code:i", """
    SELECT DISTINCT unique_id, sector, asset_class, sector_code, asset_class_code FROM training""")
def _(spark, d):
    return statics.static_features(training(spark, d))
