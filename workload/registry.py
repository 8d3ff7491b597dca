"""Queries paired with the SQL that must give the same rows.

Both sides share one output layout, written as `name:kind` words, so that types
and rounding agree: `d` a DOUBLE rounded to 6 places, `x` a DOUBLE as it is,
`i` a BIGINT, and no kind for text, dates and booleans.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _layout(words: str) -> list[tuple[str, str]]:
    return [tuple((word + ":").split(":")[:2]) for word in words.split()]


def _spark_column(name: str, kind: str):
    column = F.col(f"`{name}`")
    if kind == "d":
        # adding zero turns a negative zero into a plain one
        column = F.round(column.cast("double"), 6) + F.lit(0.0)
    elif kind in ("x", "i"):
        column = column.cast("double" if kind == "x" else "bigint")
    return column.alias(name)


def _sql_column(name: str, kind: str) -> str:
    quoted = f'"{name}"'
    text = {
        "d": f"round(CAST({quoted} AS DOUBLE), 6) + CAST(0 AS DOUBLE)",
        "x": f"CAST({quoted} AS DOUBLE)",
        "i": f"CAST({quoted} AS BIGINT)",
        "": quoted,
    }[kind]
    return f"{text} AS {quoted}"


def _with_views(body: str) -> str:
    """Prefix `body` with the named views it needs, directly or not, in order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    listed = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"WITH RECURSIVE {listed}\n{body}" if listed else body


def query(name: str, columns: str, sql: str | None = None):
    layout = _layout(columns)

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(spark, folder).select(*(_spark_column(n, k) for n, k in layout))

        QUERIES[name] = run
        if sql is not None:
            listed = ", ".join(_sql_column(n, k) for n, k in layout)
            ORACLES[name] = _with_views(f"SELECT {listed} FROM ({sql}) AS result")
        return build

    return register
