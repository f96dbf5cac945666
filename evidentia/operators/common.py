"""Helpers shared by the operators: findings, materialization, skew-safe ranks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


TASK_ROWS = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, else one in the warehouse, which is shared too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a read; consumers see real
    table sizes and scan only the columns they use. Rows of several megabytes need
    ``group_rows``: a task holds that many of them at once, not all of its file.
    Their values are many and differ, so no dictionary is tried for each group.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    options = {"parquet.block.row.count.limit": group_rows, "parquet.enable.dictionary": False} if group_rows else {}
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def violations(df: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    """Rows of a rule breach in the common findings layout."""
    return df.select(
        F.lit(rule).alias("rule"),
        key.cast("string").alias("key"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def row_violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """Check many row rules in one pass; a rule is broken where its column is true."""
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    )
    return df.select(
        F.explode(broken).alias("rule"),
        key.cast("string").alias("key"),
        F.lit(None).cast("string").alias("detail"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_unique(df: DataFrame, *keys: str, rule: str = "duplicate_key") -> DataFrame:
    """Keys that occur more than once. Counting combines map-side, so a hot key is
    one partial row per task."""
    counts = df.groupBy(*keys).count().filter("count > 1")
    return violations(counts, rule, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]),
                      F.col("count"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as their number asks for, so what one task holds does not grow with them."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-df.count() // TASK_ROWS)), *keys)


def top_per(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str) -> DataFrame:
    """First rows per key. The rank filter is pushed into a per-task group limit,
    so at most ``limit`` rows per key and task reach the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def positions(df: DataFrame, keys: list[str], order: str, block: int, ties: list[str] = [],
              name: str = "position") -> DataFrame:
    """Zero-based position of each row in its key by an integer order column.

    A plain window would put a hot key into one task. Here rows are ranked inside
    blocks of the order column, and the block counts, which are few, give each
    block its offset.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order, *ties)
    ranked = blocked.withColumn("_rank", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
        .drop("_block", "_offset", "_rank")
    )


def fold_sorted(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Run a streaming fold over rows grouped by key and sorted inside the group.

    The rows of a key pass through as Arrow batches; only the state of ``step``
    is held, never a whole group.
    """
    return (
        df.repartition(*keys)
        .sortWithinPartitions(*keys, *order)
        .mapInPandas(step, schema)
    )
