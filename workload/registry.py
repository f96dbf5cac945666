"""Name to (Spark query, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


# Text tables and the key that spreads their rows.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


class Tables:
    """The given tables below one directory."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        key = TEXT_KEYS.get(name)
        return balanced(table, key) if key else table


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that is stored in fewer pieces than there are task slots.

    A small file is often one row group and would be processed by one task. Tables
    of cluster size have more pieces than slots and are left as they are.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() <= slots else df


def query(sql: str | None = None):
    def register(function: Callable[[Tables], DataFrame]):
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return function

    return register
