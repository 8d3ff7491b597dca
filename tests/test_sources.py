import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratacast.sources import price_files, symbols, tables
from stratacast.sources.bars import resample_bars

HEADER = "Date,Open,High,Low,Close,Volume"


def test_csv_files_are_scanned_by_ticker_name(spark, tmp_path):
    (tmp_path / "abel.us.csv").write_text(f"{HEADER}\n2024-01-02,1,2,0.5,1.5,100\n2024-01-03,1.5,2,1,n/a,90\n")
    (tmp_path / "morn.us.csv").write_text(f"{HEADER}\n2024-01-02,3,4,2,3.5,10\n")
    rows = price_files.read_price_csv(spark, str(tmp_path)).orderBy("unique_id", "ds").collect()
    assert [r["unique_id"] for r in rows] == ["ABEL.US", "ABEL.US", "MORN.US"]
    assert rows[0]["ds"] == dt.datetime(2024, 1, 2) and rows[0]["volume"] == 100.0
    assert rows[1]["close"] is None
    assert list(rows[0].asDict()) == ["unique_id", "ds", "open", "high", "low", "close", "volume"]


def test_csv_without_a_column_names_it(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,Open,High,Low,Close\n" + "2024-01-02,1,2,0.5,1.5\n" * 2)
    with pytest.raises(Exception, match="x.csv lacks columns Volume"):
        price_files.read_price_csv(spark, str(tmp_path)).collect()


def test_each_csv_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "0700.csv").write_text(f"{HEADER}\n2024-01-02,1,2,0.5,1.5,100\n")
    (tmp_path / "b.csv").write_text("Date,Close,Open,High,Low,Volume\r\n2024-01-02,1.5,1,2,0.5,100\r\n\r\n")
    (tmp_path / "page.csv").write_text("<html><body>" + "Date Close " * 20)
    rows = price_files.read_price_csv(spark, str(tmp_path)).orderBy("unique_id").collect()
    assert [tuple(r)[0] for r in rows] == ["0700", "B"]
    assert [tuple(r)[2:] for r in rows] == [(1.0, 2.0, 0.5, 1.5, 100.0)] * 2
    assert [(r.ticker, r.issue) for r in price_files.rejected_price_files(spark, str(tmp_path)).collect()] == [("page", "markup")]


def test_price_files_round_trip_digit_tickers(spark, raw_bars, tmp_path):
    bars = raw_bars.withColumn("unique_id", F.regexp_replace("unique_id", "ABEL.US", "0005"))
    price_files.write_price_csv(bars, str(tmp_path / "out"))
    back = price_files.read_price_csv(spark, str(tmp_path / "out"))
    assert back.exceptAll(bars.select(back.columns).withColumn("ds", F.col("ds").cast("timestamp_ntz"))).count() == 0
    assert back.count() == 570 and "0005" in {r[0] for r in back.select("unique_id").distinct().collect()}
    assert len(list((tmp_path / "out").glob("unique_id=*/*.csv"))) == 3


@pytest.mark.parametrize("text, issue", [
    (None, "empty"), ("", "empty"), ("Date,Close", "too_short"),
    (HEADER + "\n" + "No data " * 10, "refused"), (HEADER + "\nExceeded the daily hits limit" * 3, "refused"),
    (HEADER + "\nexceeded the daily hits limit" * 3, None),
    (HEADER + "\n<HTML><body>" + "x" * 50, "markup"), (" <!DOCTYPE html>" + "x" * 50, "markup"),
    ("Open,High\n" + "1,2\n" * 20, "no_header"), (HEADER + "\n2024-01-02,1,2,0.5,1.5,100\n", None),
])
def test_payload_issue(spark, text, issue):
    df = spark.createDataFrame([(text,)], "text string").select(price_files.payload_issue(F.col("text")))
    assert df.first()[0] == issue


def test_symbols(spark):
    df = spark.createDataFrame([("brk-b.us",), ("ABEL.US",), ("us.usb",)], "t string")
    t = F.col("t")
    rows = df.select(symbols.ticker_to_symbol(t), symbols.symbol_to_ticker(symbols.ticker_to_symbol(t)),
                     symbols.company_key(t)).collect()
    assert [tuple(r) for r in rows] == [
        ("BRK-B", "BRK-B.US", "BRK.B"), ("ABEL", "ABEL.US", "ABEL"), ("US.USB", "US.USB.US", "US.USB"),
    ]


def test_round_trip_combine_and_restrictions(spark, raw_bars, tmp_path):
    path = str(tmp_path / "bars")
    tables.save_table(raw_bars, path)
    back = tables.load_table(spark, path, raw_bars.schema)
    assert back.count() == 570
    assert tables.combine([back.limit(0), back]).count() == 570
    with pytest.raises(ValueError):
        tables.combine([back.limit(0)])
    with pytest.raises(ValueError):
        tables.combine([])
    assert tables.restrict_universe(back, []).count() == 570
    assert tables.restrict_universe(back, ["ABEL.US"]).count() == 190
    ids = back.select("unique_id").filter("unique_id <> 'ABEL.US'").distinct()
    assert tables.restrict_universe(back, ids).count() == 380
    month = tables.restrict_dates(back, dt.datetime(2023, 2, 1), dt.datetime(2023, 3, 1))
    assert month.agg(F.min("ds"), F.max("ds")).first() == (dt.datetime(2023, 2, 1), dt.datetime(2023, 2, 28))


def test_filters_and_columns_reach_the_scan(spark, raw_bars, tmp_path):
    path = str(tmp_path / "bars")
    tables.save_table(raw_bars, path)
    df = tables.restrict_universe(tables.load_table(spark, path), ["ABEL.US"]).select("unique_id", "close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(unique_id), EqualTo(unique_id,ABEL.US)]" in plan
    assert "ReadSchema: struct<unique_id:string,close:double>" in plan


def test_weekly_bars(spark):
    rows = [("A", dt.date(2024, 1, d), float(d), d + 1.0, d - 1.0, d + 0.5, 1.0) for d in (2, 3, 5, 8)]
    df = spark.createDataFrame(rows, "unique_id string, ds date, open double, high double, low double, close double, volume double")
    assert [tuple(r) for r in resample_bars(df, "w").orderBy("ds").collect()] == [
        ("A", dt.date(2024, 1, 1), 2.0, 6.0, 1.0, 5.5, 3.0), ("A", dt.date(2024, 1, 8), 8.0, 9.0, 7.0, 8.5, 1.0),
    ]
    with pytest.raises(ValueError):
        resample_bars(df, "y")


def test_quoted_cells_stay_in_their_columns(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"Date","Open","High","Low","Close","Volume"\n'
                                    '2024-01-02,"1,234.5",2000,1000,1500,10\n2024-01-03,"7",8,6,"7.5",20\n')
    rows = price_files.read_price_csv(spark, str(tmp_path)).orderBy("ds").collect()
    got = [(r.open, r.high, r.low, r.close, r.volume) for r in rows]
    # a thousands separator is no number: that one cell is empty, the others keep their places
    assert got == [(None, 2000.0, 1000.0, 1500.0, 10.0), (7.0, 8.0, 6.0, 7.5, 20.0)]
