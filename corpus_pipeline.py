"""Corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, packing.

STAGES holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
Rows are matched with decisions by a hash of id and text, so null and repeated ids need no special case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import benchmark_decontamination, minhash_join, packing, quality_rules, secret_scan
from evidentia.llm.common import table
from evidentia.operators.common import materialized

REDACTED = "<SECRET>"


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, one without an id only where none has one."""
    rows = minhash_join.near_duplicates(docs, size=5, percent=80)
    # Rows with an empty set resemble nothing; only repeated rows of them go.
    group = rows.groupBy(F.coalesce("component", "key").alias("c"), F.col("component").isNull().alias("e"))
    named_first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    first = group.agg(F.min(named_first).alias("first")).select(F.col("first.key").alias("__key"))
    one = Window.partitionBy("__key").orderBy(F.xxhash64(*docs.columns))
    once = docs.withColumn("__key", minhash_join.row_key()).withColumn("__turn", F.row_number().over(one)).filter("__turn = 1")
    return once.join(first, "__key", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    keyed = docs.select(_key().alias("doc_id"), "text")
    found = benchmark_decontamination.find_contamination(keyed, table(spark, sf_dir, "benchmark"))
    hit = materialized(found.filter("n_hit > 0").select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return docs.withColumn("__key", _key()).join(hit, "__key", "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the values of live-looking credentials replaced; copied examples stay."""
    keyed = docs.withColumn("__key", _key())
    found = secret_scan.scan(keyed, id_column="__key", owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    live = found.select(F.col("doc_id").alias("__key"), F.filter("spans", lambda s: s["class"] == "live").alias("s"))
    live = live.filter(F.size("s") > 0).select("__key", F.transform("s", lambda s: F.struct(
        s["value_start"].alias("a"), s["value_end"].alias("b"))).alias("__cuts"))
    live = materialized(live.dropDuplicates(["__key"]), "live-secrets")
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [_cut(t, c) for t, c in zip(batch.column(text).to_pylist(), batch.column(len(names)).to_pylist())]
            columns = [pa.array(bodies, pa.string()) if i == text else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = keyed.join(live, "__key", "left").select(*names, "__cuts")
    return joined.mapInArrow(run, docs.schema).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names)


def _cut(text: str | None, cuts: list[dict] | None) -> str | None:
    if not text or not cuts:
        return text
    out, at = [], 0
    for c in sorted(cuts, key=lambda c: (c["a"], c["b"])):
        if c["a"] >= at:
            out += [text[at:c["a"]], REDACTED]
        at = max(at, c["b"])
    return "".join(out) + text[at:]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("pack", pack)]

# Tokenizing and signatures are outside SQL; tests compare the pipeline with a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
