"""WARC archives with a two-level capture index.

Tasks append records, each a gzip member of its own, to archive files in a shared folder. The captures'
reversed-host keys are sorted over the cluster and written as compressed blocks of lines, one file per
key range, next to a sparse directory with the first key and the place of each block. A lookup goes from
the range (a list as long as the number of ranges) to the block by binary search in that directory, reads
that byte range only, finds the line by binary search, and reads the record's byte range from the archive.

Equal payloads of at least ``least_bytes`` are stored once: the smallest page_id is the response, the
others are revisit records that name it and keep the HTTP head.

Scale: payloads move once, from the table into an archive; only digests and index lines are shuffled. The
table of repeated payloads is joined as Spark sees fit for its size. Keys end in the page_id, so a url with
very many captures is many lines, spread over blocks and ranges. Files carry the task attempt in their
name and the index names the attempt that was committed, so lost executors leave nothing wrong behind.
Files are written with the file systems of pyarrow; the shared folder must be one it can open.

Defined results: a null payload is empty; a null url has an empty key; rows with equal page_id and url are
separate records that one lookup finds together, all responses if they hold the smallest page_id; null
page_ids never become a response while another row has the payload; an empty table gives empty archives.
Columns other than the three named ones are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import query, table
from evidentia.operators.common import materialized, scratch_path

FILE_BYTES = 1 << 30
BLOCK_LINES = 300
READ_BYTES = 1 << 24
CAPTURED = "2024-01-01T00:00:00Z"  # records of one run carry one date, so equal input gives equal bytes


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", folder) and not folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)


def capture_key(url: str | None, page_id: int | None) -> str:
    """``org,example)/path?query 0000000000000000042``; control characters and spaces are escaped."""
    scheme, found, rest = (url or "").partition("://")
    if found:
        m = re.match(r"([^/?#]*)([^#]*)", rest, re.S)
        rest = ",".join(reversed(m[1].lower().split("."))) + ")" + m[2]
    else:
        rest = scheme
    rest = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", rest)
    return f"{rest} {'' if page_id is None else format(page_id, '020d')}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode().rstrip("=")


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One uncompressed WARC/1.1 record; a revisit (refers_to not null) has the HTTP head only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
            ("WARC-Date", CAPTURED), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")),
            ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = http + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one uncompressed record; the digest of a stored payload is computed and compared."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda f: None if f is None or "None" in f else int(f[len("<urn:page:"):-1])
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload}


def _gzip(raw: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def with_first_page(pages: DataFrame, payload: Column, least_bytes: int = 0) -> DataFrame:
    """Add ``first``: the smallest page_id with the same payload, where that is another one."""
    digest = F.sha1(payload.cast("binary"))
    sized = pages.withColumn("digest", F.when(F.octet_length(payload) >= least_bytes, digest))
    firsts = sized.filter("digest is not null").groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = sized.join(materialized(firsts, "payloads"), "digest", "left")
    return joined.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("digest")


CAPTURES = "key string, page_id bigint, file string, at bigint, size bigint"


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row below ``folder``; returns the captures (stored): key, page_id, file, at, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        number, out, at, file = 0, None, 0, ""
        try:
            for batch in batches:
                rows = []
                for pid, address, body, first in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        file = f"{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
                        out, at, number = system.open_output_stream(posixpath.join(root, file), compression=None), 0, number + 1
                    member = _gzip(record(pid, address, (body or "").encode("utf-8", "surrogatepass"), first))
                    out.write(member)
                    rows.append((capture_key(address, pid), pid, file, at, len(member)))
                    at += len(member)
                yield _batch(rows, CAPTURES)
        finally:
            if out is not None:
                out.close()

    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"))
    judged = with_first_page(narrow, F.col("html"), least_bytes).select("page_id", "url", "html", "first")
    return materialized(judged.mapInArrow(run, CAPTURES), "captures")


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], names)


@dataclass
class CaptureIndex:
    """Key ranges (stored): first key, block file, directory file. ``folder`` holds the files."""

    folder: str
    ranges: DataFrame


RANGES = "first string, blocks string, directory string"


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort captures by key into compressed blocks and write a sparse directory for each key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        lines, entries, at, out = [], [], 0, None

        def flush():
            nonlocal at, lines
            block = _gzip("\n".join(lines).encode("utf-8", "surrogatepass"))
            out.write(block)
            entries.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(block)}")
            at, lines = at + len(block), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or system.open_output_stream(posixpath.join(root, f"{name}.cdx.gz"), compression=None)
                lines.append("\t".join("" if v is None else str(v) for v in row))
                if len(lines) >= block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with system.open_output_stream(posixpath.join(root, f"{name}.dir"), compression=None) as directory:
            directory.write("\n".join(entries).encode("utf-8", "surrogatepass"))
        yield _batch([(entries[0].split("\t")[0], f"{name}.cdx.gz", f"{name}.dir")], RANGES)

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key").sortWithinPartitions("key")
    return CaptureIndex(folder, materialized(ordered.mapInArrow(run, RANGES), "key-ranges"))


def lookup(keys: DataFrame, index: CaptureIndex) -> DataFrame:
    """Captures whose key is asked for. ``keys``: one string column."""
    spark, folder = keys.sparkSession, index.folder
    ranges = sorted((r["first"].encode("utf-8", "surrogatepass"), r["blocks"], r["directory"]) for r in index.ranges.collect())  # one row per key range
    shared = spark.sparkContext.broadcast(ranges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [r[0] for r in shared.value]
        for batch in batches:
            asked = batch.column(0).to_pylist()
            # Equal keys may run over a border, so a search starts one range early where it must.
            rows = [(k, p) for k in asked for p in _ranges_of(k.encode("utf-8", "surrogatepass"), firsts)]
            yield _batch(rows, "key string, part int")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        part, firsts, places, data = None, [], [], None
        block, lines, line_keys = None, [], []
        for batch in batches:
            found = []
            for key, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wanted = key.encode("utf-8", "surrogatepass")
                if p != part:
                    part, block = p, None
                    with system.open_input_file(posixpath.join(root, shared.value[p][2])) as f:
                        entries = [e.split(b"\t") for e in f.read().split(b"\n")]
                    firsts, places = [e[0] for e in entries], [(int(e[1]), int(e[2])) for e in entries]
                    if data is not None:
                        data.close()
                    data = system.open_input_file(posixpath.join(root, shared.value[p][1]))
                for b in _ranges_of(wanted, firsts):
                    if b != block:
                        lines = zlib.decompress(data.read_at(places[b][1], places[b][0]), 31).split(b"\n")
                        block, line_keys = b, [x.split(b"\t", 1)[0] for x in lines]
                    for x in lines[bisect.bisect_left(line_keys, wanted):bisect.bisect_right(line_keys, wanted)]:
                        k, pid, file, at, size = x.decode("utf-8", "surrogatepass").split("\t")
                        found.append((k, int(pid) if pid else None, file, int(at), int(size)))
            yield _batch(found, CAPTURES)
        if data is not None:
            data.close()

    placed = keys.distinct().mapInArrow(place, "key string, part int")
    parts = max(1, len(ranges))
    return placed.repartition(parts, "part").sortWithinPartitions("part", "key").mapInArrow(read, CAPTURES)


def _ranges_of(key: bytes, firsts: list[bytes]) -> range:
    """Numbers of the sorted pieces that can hold the key; ``firsts`` are their first keys."""
    last = bisect.bisect_right(firsts, key) - 1
    first = max(0, bisect.bisect_left(firsts, key) - 1)
    return range(first, last + 1)


RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_records(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Parse the records at the captures' places; ``payloads`` adds the stored payload of responses."""
    schema = RECORDS + (", payload string" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        name, data = None, None
        for batch in batches:
            rows = []
            for file, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    if data is not None:
                        data.close()
                    name, data = file, system.open_input_file(posixpath.join(root, file))
                r = parse_record(zlib.decompress(data.read_at(size, at), 31))
                row = tuple(r[f.split()[0]] for f in RECORDS.split(", "))
                rows.append(row + ((r["payload"].decode("utf-8", "surrogatepass"),) if payloads else ()))
            yield _batch(rows, schema)
        if data is not None:
            data.close()

    near = captures.select("file", "at", "size").withColumn("stretch", F.floor(F.col("at") / READ_BYTES))
    near = near.repartition("file", "stretch").sortWithinPartitions("file", "at").drop("stretch")
    return near.mapInArrow(run, schema)


def keys_of(pages: DataFrame, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Capture keys of rows with a url and a page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(capture_key(u, p),) for u, p in zip(*(c.to_pylist() for c in batch.columns))], "key string")

    return pages.select(F.col(url).cast("string"), F.col(page_id).cast("long")).mapInArrow(run, "key string")


@query("op2_warc_index")
def op2_warc_index(spark, folder: str) -> DataFrame:
    """Archive every page, index the captures, look all of them up and read them back."""
    pages = table(spark, folder, "pages")
    root = scratch_path(spark, "archive")
    captures = write_archives(pages, root)
    index = write_index(captures, root + "/index")
    found = lookup(keys_of(pages), index)
    return read_records(found, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
