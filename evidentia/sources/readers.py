"""Readers: manifests, dossiers, glossaries, binary documents, asset listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.text import sha256_hex
from evidentia.schemas import DOSSIER, GLOSSARY, SOURCES


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source manifest, one JSON object per line. ``ordinal`` keeps manifest order
    within the file set; the lists of optional fields default to empty."""
    rows = spark.read.schema(_with_corrupt(SOURCES)).json(path)
    empty = F.array().cast("array<string>")
    return rows.select(
        F.col("id").alias("source_id"), "kind", "title",
        F.coalesce("aliases", empty).alias("aliases"),
        F.coalesce("tags", empty).alias("tags"),
        F.col("filePath").alias("file_path"),
        F.col("publicHref").alias("public_href"),
        F.col("projectId").alias("project_id"),
        F.col("pageCount").alias("page_count"),
        F.col("structuredText").alias("structured_text"),
        F.coalesce("visualPages", F.array().cast("array<int>")).alias("visual_pages"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ordinal"),
        "_corrupt_record",
    )


def read_dossiers(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested dossiers; a malformed document keeps its text in ``_corrupt_record``."""
    return (
        spark.read.schema(_with_corrupt(DOSSIER))
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .json(path)
    )


def read_glossary(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Glossary entries; ``entry`` is the file, the document in it and the position, so documents stay apart."""
    rows = spark.read.schema(GLOSSARY).option("multiLine", multi_line).json(path)
    placed = rows.select("version", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), "entries")
    return placed.select("version", "file", "row", F.posexplode("entries").alias("at", "e")).select(
        "version", F.struct("file", "row", "at").alias("entry"), "e.canonical", "e.aliases", "e.intents"
    )


def read_document_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and length of every matching file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", sha256_hex(F.col("content")).alias("digest"), "length")


def read_asset_listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root`` with sizes; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    marker = "/" + root.rstrip("/").split("/")[-1] + "/"
    return files.select(
        F.concat(F.lit("/"), F.substring_index("path", marker, -1)).alias("path"), "length"
    )


def source_digests(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Digest per source: profile rows hash their text, others their file."""
    named = files.select(F.col("path").alias("file_path"), F.col("digest").alias("file_digest"))
    profile = F.col("kind") == "profile"
    return sources.join(named, "file_path", "left").select(
        "source_id",
        F.when(profile, sha256_hex(F.col("structured_text"))).otherwise(F.col("file_digest"))
        .alias("digest"),
    )
