"""Per-ticker price files: payload checks, CSV scan, vendor column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacast.schemas import BAR_COLUMNS, BAR_VALUES

# The vendor header, and the texts an error payload carries.
VENDOR_COLUMNS = ["Date", "Open", "High", "Low", "Close", "Volume"]
MIN_PAYLOAD_CHARS = 50
REFUSAL_TEXTS = ["No data", "Exceeded"]
MARKUP_TEXTS = ["<html", "<!doctype"]
HEADER_TEXTS = ["Date", "Close"]


def payload_issue(text: Column) -> Column:
    """Why a downloaded price file cannot be used, or NULL when it can."""
    header = F.trim(F.substring_index(text, "\n", 1))
    lowered = F.lower(text)
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(F.length(text) < MIN_PAYLOAD_CHARS, "too_short")
        .when(text.contains(REFUSAL_TEXTS[0]) | text.contains(REFUSAL_TEXTS[1]), "refused")
        .when(lowered.contains(MARKUP_TEXTS[0]) | lowered.contains(MARKUP_TEXTS[1]), "markup")
        .when(~(header.contains(HEADER_TEXTS[0]) & header.contains(HEADER_TEXTS[1])), "no_header")
    )


def is_valid_payload(text: Column) -> Column:
    return payload_issue(text).isNull()


def split_payloads(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) payload rows; the rejected ones carry `issue`."""
    checked = df.withColumn("issue", payload_issue(F.col(column)))
    return checked.filter("issue is null").drop("issue"), checked.filter("issue is not null")


def from_vendor(df: DataFrame, ticker: Column) -> DataFrame:
    """Vendor column names to bar columns, with the id added and no time zone."""
    missing = sorted(set(VENDOR_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"price data lacks columns {missing}")
    values = [
        F.col(vendor).try_cast("double").alias(ours)
        for vendor, ours in zip(VENDOR_COLUMNS[1:], BAR_VALUES)
    ]
    return df.select(
        F.upper(ticker).alias("unique_id"), F.col("Date").cast("timestamp_ntz").alias("ds"), *values
    ).select(*BAR_COLUMNS)


def _price_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ticker, content): one row per price file, whole, as each has a header of its own."""
    files = spark.read.text(path, wholetext=True)
    place = F.url_decode(F.col("_metadata.file_path"))
    folder = F.regexp_extract(place, r"/unique_id=([^/]+)/", 1)
    name = F.regexp_replace(F.regexp_extract(place, r"([^/]+)$", 1), r"(?i)\.csv$", "")
    return files.select(
        place.alias("path"), F.when(folder != "", folder).otherwise(name).alias("ticker"), F.col("value").alias("content")
    )


def rejected_price_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ticker, issue) of the files that `read_price_csv` leaves out."""
    files = _price_files(spark, path)
    return files.select("path", "ticker", payload_issue(F.col("content")).alias("issue")).filter("issue is not null")


#: Cells read from one line of a price file; a vendor file has seven.
CELLS = 64
_CELL_SCHEMA = ", ".join(f"c{i} string" for i in range(CELLS))


def csv_cells(line: Column) -> Column:
    """The cells of one CSV line as strings, quotes honoured (`"1,234.5"` is one cell)."""
    parsed = F.from_csv(line, _CELL_SCHEMA, {"mode": "PERMISSIVE"})
    return F.array(*(parsed[f"c{i}"] for i in range(CELLS)))


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan price files named `<ticker>.csv`, or folders named `unique_id=<ticker>`.

    Columns are found by each file's own header, cells split as CSV (quoted cells may hold
    commas; a quoted header is read as its names). A file that lacks one fails the job and is
    named; files that are no price data at all are left out (`rejected_price_files`). One
    ticker's file is read whole, so it must fit in a task.
    """
    lines = F.split("content", r"\r?\n")
    files = _price_files(spark, path).filter(is_valid_payload(F.col("content"))).select(
        "path", "ticker", F.transform(csv_cells(F.get(lines, 0)), lambda name: F.trim(name)).alias("header"), lines.alias("lines")
    )
    missing = F.array_except(F.array(*(F.lit(c) for c in VENDOR_COLUMNS)), "header")
    refusal = F.raise_error(F.concat(
        F.lit("price file "), F.col("path"), F.lit(" lacks columns "), F.array_join(missing, ", ")
    )).cast("array<string>")
    checked = files.withColumn("header", F.when(F.size(missing) == 0, F.col("header")).otherwise(refusal))
    rows = checked.select("ticker", "header", F.posexplode("lines").alias("at", "line")).filter(
        (F.col("at") > 0) & (F.trim("line") != "")
    ).withColumn("cells", csv_cells(F.col("line")))
    named = rows.select("ticker", *(
        F.trim(F.get("cells", (F.array_position("header", c) - 1).cast("int"))).alias(c) for c in VENDOR_COLUMNS
    ))
    return from_vendor(named, F.col("ticker"))


def write_price_csv(bars: DataFrame, path: str) -> None:
    """Write bars under the vendor's header, one folder and one file per ticker."""
    renamed = [F.col(ours).alias(vendor) for vendor, ours in zip(VENDOR_COLUMNS[1:], BAR_VALUES)]
    (
        bars.select("unique_id", F.col("ds").cast("string").alias("Date"), *renamed)
        .repartition("unique_id").write.mode("overwrite").option("header", True).partitionBy("unique_id").csv(path)
    )
