"""Helpers of the training-data operators: fixed byte classes, hidden columns, registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Word separators of the white-space contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
# Characters outside words of the letter-and-digit contracts, either case.
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def query(name: str, sql: str | None = None):
    """Register a (spark, folder) -> DataFrame function and, where there is one, its SQL."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in either case."""
    used = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in used:
            stem += "_"
        used.add(stem.lower())
        out.append(stem)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sha256_text(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def text_or_empty(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
