"""Sinks: all-or-nothing index publication and event text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.common import materialized


BUCKETS = 64


class PublicationConflict(RuntimeError):
    """Somebody else published a version in the meantime."""


class Publication:
    """Versions of one table below a folder, and which of them is current.

    ``versions/<token>`` holds rows, ``current/<number>`` the folders that make a version, one a line: a token, or
    ``token/bucket=n`` where buckets of earlier versions are carried on. The highest number is current. A version is complete before its pointer exists, and a pointer appears by one rename that fails
    if the number is taken; so a crash between any two steps leaves the old version or the new one, and of two
    writers one is told. Readers resolve the pointer once and keep to that version.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def numbers(self) -> list[int]:
        folder = self._at("current")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def parts(self, number: int | None = None) -> list[str]:
        """The folders of a version below ``versions``, by default of the current one; at most its buckets."""
        known = self.numbers()
        if number is None and not known:
            raise FileNotFoundError(f"nothing is published in {self.path}")
        pointer = self._at("current", f"{known[-1] if number is None else number:012d}").toString()
        return sorted(r[0] for r in self.spark.read.text(pointer).collect())

    def read(self, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/versions/{p}" for p in self.parts(number)])

    def stage(self, rows: DataFrame, order: list[str]) -> str:
        """Write a version in canonical order; nobody reads it yet.

        Range partitioning samples its input, so the rows are stored first and computed once.
        """
        token = uuid.uuid4().hex
        stored = materialized(rows, "publication")
        stored.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(self._at("versions", token).toString())
        return token

    def stage_buckets(self, rows: DataFrame, order: list[str]) -> list[str]:
        """Write the buckets of rows with a ``bucket`` column, each in canonical order; returns their folders."""
        token = uuid.uuid4().hex
        rows.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(
            self._at("versions", token).toString())
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("versions", token))]
        return [f"{token}/{n}" for n in sorted(names) if n.startswith("bucket=")]

    def point(self, folders: list[str], number: int) -> None:
        """Make staged folders current as ``number``, unless that number exists."""
        draft = self._at("drafts", uuid.uuid4().hex)
        stream = self._fs.create(draft, False)
        stream.write(bytearray("\n".join(folders).encode()))
        stream.close()
        self._fs.mkdirs(self._at("current"))
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, self._at("current", f"{number:012d}"), no_overwrite)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise PublicationConflict(f"version {number} of {self.path} exists") from error
            raise

    def retire(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions, and versions without a pointer that are older than these."""
        known = self.numbers()
        kept = {p.split("/")[0] for n in known[-keep:] for p in self.parts(n)}
        limit = min((self._fs.getFileStatus(self._at("versions", v)).getModificationTime() for v in kept), default=0)
        for n in known[:-keep]:
            self._fs.delete(self._at("current", f"{n:012d}"), False)
        for status in self._fs.listStatus(self._at("versions")) if known else []:
            if status.getPath().getName() not in kept and status.getModificationTime() < limit:
                self._fs.delete(status.getPath(), True)


def write_index(df: DataFrame, path: str, order: list[str], keep: int = 2) -> int:
    """Publish a table in canonical row order, or leave the old one in place; returns the version's number.

    Reading the files of a version in name order gives the canonical order without a single-task sort.
    """
    target = Publication(df.sparkSession, path)
    number = max(target.numbers(), default=0) + 1
    target.point([target.stage(df, order)], number)
    target.retire(keep)
    return number


def read_index(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """One published version, by default the current one; later publications do not change it."""
    return Publication(spark, path).read(number)


def _bucket(source: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int").alias("bucket")


def write_buckets(df: DataFrame, path: str, order: list[str], source: str = "source_id", buckets: int = BUCKETS) -> int:
    """Publish a table whose sources can be replaced one by one by ``rebuild_index``."""
    target = Publication(df.sparkSession, path)
    number = max(target.numbers(), default=0) + 1
    stored = materialized(df.withColumn("bucket", _bucket(source, buckets)), "publication")
    target.point(target.stage_buckets(stored, order), number)
    return number


def rebuild_index(drift: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, order: list[str],
                  source: str = "source_id", buckets: int = BUCKETS) -> int:
    """Publish the next version from the current one and the sources that drifted.

    ``drift(source, status)`` is the result of ``digest_drift``; ``build`` gets the sources to compute and
    returns their rows. Only buckets of drifted sources are written: their other rows are carried over from the
    current version, and all other buckets are taken on as they are. The result equals a full build.
    """
    target = Publication(drift.sparkSession, path)
    number = target.numbers()[-1]
    changed = materialized(drift.filter("status <> 'same'").select(F.col(source), "status", _bucket(source, buckets)), "drifted")
    touched = {r.bucket for r in changed.select("bucket").distinct().collect()}  # at most all buckets
    parts = target.parts(number)
    own = {p: int(p.rsplit("=", 1)[1]) for p in parts}
    fresh = build(changed.filter("status <> 'removed'").select(source)).withColumn("bucket", _bucket(source, buckets))
    rewritten = [p for p in parts if own[p] in touched]
    if rewritten:
        old = target.spark.read.parquet(*[f"{target.path}/versions/{p}" for p in rewritten]).withColumn("bucket", _bucket(source, buckets))
        fresh = old.join(changed.select(source), source, "left_anti").select(*old.columns).unionByName(fresh)
    folders = target.stage_buckets(materialized(fresh, "publication"), order) if touched else []
    target.point(sorted(folders + [p for p in parts if own[p] not in touched]), number + 1)
    return number + 1


def encode_event(kind: Column, data_json: Column) -> Column:
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data_json, F.lit("\n\n"))


def encode_events(df: DataFrame) -> DataFrame:
    """``value`` text blocks from ``type`` and a struct or JSON ``data`` column."""
    data = F.col("data")
    if df.schema["data"].dataType.typeName() != "string":
        data = F.to_json(data)
    return df.select(*[c for c in df.columns if c not in ("type", "data")],
                     encode_event(F.col("type"), data).alias("value"))
