import datetime as dt
import math
import random

import pytest
from pyspark.sql import SparkSession

from stratacast.schemas import RAW_BARS


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("stratacast-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def business_days(start, count):
    day, found = start, []
    while len(found) < count:
        if day.weekday() < 5:
            found.append(day)
        day += dt.timedelta(days=1)
    return found


@pytest.fixture(scope="session")
def walk_rows():
    """Three price paths over 190 business days, as raw bar tuples: a slope, a wave and noise."""
    rng = random.Random(2718)
    rows = []
    for number, name in enumerate(("ABEL.US", "MORN.US", "FINN.US"), start=1):
        for step, day in enumerate(business_days(dt.date(2023, 1, 3), 190)):
            close = 35.0 * number + 0.05 * step + 2.0 * math.sin(step / (5.0 + number)) + rng.uniform(-0.6, 0.6)
            at = dt.datetime(day.year, day.month, day.day)
            rows.append((name, at, close * 0.998, close * 1.006, close * 0.991, close, 700.0 + 13 * step + 90 * number))
    return rows


@pytest.fixture(scope="session")
def raw_bars(spark, walk_rows):
    return spark.createDataFrame(walk_rows, RAW_BARS)
