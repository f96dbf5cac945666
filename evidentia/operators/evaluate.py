"""Acceptance checks of retrieval results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STRINGS = "array<string>"


def evaluate(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, check, ok) for ``cases(case_id, query_id, required_chunk_ids,
    required_source_ids, forbidden_primary_ids, minimum_sources, expect_none)``.

    A packet holds at most a handful of rows, so its ids fit one array.
    """
    packets = results.groupBy("query_id").agg(
        F.collect_list("chunk_id").alias("ids"),
        F.collect_set("source_id").alias("sources"),
        F.min_by("chunk_id", "rank").alias("first"),
    )
    empty = F.array().cast(_STRINGS)
    joined = cases.join(packets, "query_id", "left").select(
        cases["*"], F.coalesce("ids", empty).alias("ids"),
        F.coalesce("sources", empty).alias("sources"), "first")
    listed = lambda name: F.coalesce(F.col(name), empty)
    checks = [
        ("expect_none", F.col("expect_none"), F.size("ids") == 0),
        ("required_chunks", F.size(listed("required_chunk_ids")) > 0,
         F.size(F.array_except(listed("required_chunk_ids"), F.col("ids"))) == 0),
        ("required_sources", F.size(listed("required_source_ids")) > 0,
         F.size(F.array_except(listed("required_source_ids"), F.col("sources"))) == 0),
        ("forbidden_primary", F.size(listed("forbidden_primary_ids")) > 0,
         ~F.coalesce(F.array_contains(listed("forbidden_primary_ids"), F.col("first")), F.lit(False))),
        ("distinct_sources", F.col("minimum_sources").isNotNull(),
         F.size("sources") >= F.col("minimum_sources")),
    ]
    none = F.coalesce("expect_none", F.lit(False))
    rows = F.array_compact(F.array(*[
        F.when(
            F.coalesce(active, F.lit(False)) & (F.lit(name == "expect_none") | ~none),
            F.struct(F.lit(name).alias("check"), ok.alias("ok")))
        for name, active, ok in checks]))
    return joined.select("case_id", F.inline(rows))


def pass_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check").agg(
        F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))
