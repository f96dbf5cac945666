"""Secret scans: candidates of every text, judged by how many owners and repositories hold them.

``find_candidates`` finds spans of credential shapes in each text. ``ownership`` counts, for the digest of
each candidate value, the distinct repositories and owners of the whole corpus that contain it. A value
that many owners hold is a widely copied example (documentation, test keys); one that stays with an owner
and looks random is taken for a live credential.

Scale: texts are read once and never shuffled; only spans with a 16-byte digest are. Counts are folded
per (value, owner, repository), then per (value, owner), then per value, each with partial sums before
the shuffle, so a value held by a third of all rows is one partial row per task. Counts are stored, so their
join with the stored spans has a plain table on either side and Spark can split it at hot values.

Defined results: a null or empty text has no spans; null owners and repositories count as one unnamed
owner and repository; repeated rows are reported one by one and count as several documents of the same
owner; equal spans of several kinds are all reported, ordered by start, then kind; an empty table gives
an empty table. Input columns other than the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import query, table
from evidentia.operators.common import materialized

COPIED_OWNERS = 3  # held by so many owners or more: a widely copied example
LIVE_BITS = 2.5  # bits a character from which a value looks random

# Base kinds in order, with the group that holds the value and its least length.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# Further public token shapes, each with a string that every match contains.
_MORE = [
    ("github", b"gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{30,}")),
    ("slack", b"xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("google", b"AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{30,}")),
    ("stripe", b"k_live_", re.compile(r"\b[rs]k_live_[A-Za-z0-9]{16,}")),
    ("jwt", b"eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("private_key", b"PRIVATE KEY", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")),
]
BASE_KINDS = ["assign", "access", "hex"]
KINDS = BASE_KINDS + [k for k, _, _ in _MORE]
_RANK = {k: i for i, k in enumerate(KINDS)}


def spans_of(text: str) -> list[tuple[int, str, int, int, int]]:
    """(start, kind, end, value start, value end) in code points, by start, then kind."""
    raw, out = text.encode("utf-8", "surrogatepass"), []
    lowered = raw.lower()
    if any(k in lowered for k in _KEYS):
        # A short value still uses up its match, so length is tested afterwards.
        out += [(m.start(), "assign", m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), "access", m.end(), *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), "hex", m.end(), *m.span()) for m in _HEX.finditer(text)]
    for kind, part, pattern in _MORE:
        if part in raw:
            out += [(m.start(), kind, m.end(), *m.span()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[0], _RANK[s[1]]))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("value_start", pa.int32()),
                   ("value_end", pa.int32()), ("digest", pa.binary()), ("bits", pa.float64())])
_SPAN_SQL = "struct<start:int,kind:string,end:int,value_start:int,value_end:int,digest:binary,bits:double>"


def find_candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", owner: Column | None = None,
                    repository: Column | None = None) -> DataFrame:
    """One row per document: row (a number of its own), doc_id, owner, repository, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for body in batch.column(4):
                t, spans = body.as_py() or "", []
                for start, kind, end, a, b in spans_of(t):
                    value = t[a:b]
                    spans.append({"start": start, "kind": kind, "end": end, "value_start": a, "value_end": b,
                                  "digest": hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:16],
                                  "bits": entropy(value)})
                found.append(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(4)] + [pa.array(found, pa.list_(_SPAN))],
                ["row", "doc_id", "owner", "repository", "spans"])

    nameless = F.lit("")
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(owner.cast("string") if owner is not None else nameless, nameless).alias("owner"),
        F.coalesce(repository.cast("string") if repository is not None else nameless, nameless).alias("repository"),
        F.col(text).cast("string"))
    return narrow.mapInArrow(run, f"row bigint, doc_id bigint, owner string, repository string, spans array<{_SPAN_SQL}>")


def ownership(candidates: DataFrame) -> DataFrame:
    """digest, n_documents, n_owners, n_repositories over the corpus. ``candidates``: row, owner, repository, digest."""
    per_doc = candidates.groupBy("digest", "owner", "repository").agg(F.count_distinct("row").alias("n"))
    per_owner = per_doc.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    return per_owner.groupBy("digest").agg(
        F.sum("n").alias("n_documents"), F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", owner: Column | None = None,
         repository: Column | None = None, copied_owners: int = COPIED_OWNERS, live_bits: float = LIVE_BITS) -> DataFrame:
    """One row per document: row, doc_id and spans, each with its counts and class: live, copied or weak."""
    found = materialized(find_candidates(docs, id_column, text, owner, repository), "secret-candidates")
    flat = found.filter(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("s"))
    flat = flat.select("row", "owner", "repository", "s", F.col("s.digest").alias("digest"))
    owners = materialized(ownership(flat), "secret-owners")
    judged = flat.join(owners, "digest").withColumn(
        "class", F.when(F.col("n_owners") >= copied_owners, "copied").when(F.col("s.bits") >= live_bits, "live").otherwise("weak"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("s.kind"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        F.col("s.start").alias("start"), rank.alias("rank"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"),
        F.col("s.value_start").alias("value_start"), F.col("s.value_end").alias("value_end"), "n_documents", "n_owners",
        "n_repositories", "class"))).alias("spans"))
    return found.select("row", "doc_id").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array()))


@query("op1_secret_scan")
def op1_secret_scan(spark, folder: str) -> DataFrame:
    """Spans of every document; a source is the owner, its texts in one language a repository."""
    docs = table(spark, folder, "documents")
    found = scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    of = lambda test: F.filter("spans", test)
    written = lambda s: F.array_join(F.transform(
        s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(field: str, value: str) -> Column:
        return F.size(of(lambda x: x[field] == value)).cast("long").alias(f"n_{value}")

    counts = [count("kind", k) for k in BASE_KINDS]
    classes = [count("class", k) for k in ("live", "copied")]
    return found.select(
        "doc_id", *counts, F.sha2(written(of(lambda x: x["kind"].isin(BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"), *classes)
