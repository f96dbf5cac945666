"""Verification of a stored index against its inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import DENSITIES, INTENTS, ChunkingConfig
from evidentia.functions import text
from evidentia.operators.common import check_unique, materialized, row_violations, union_all, violations
from evidentia.operators.corpus import chunk_windows

PAGE_KEY = ["source_id", "page"]
INDEX_VERSION = 2  # fixed value of the index layout
TREE_NODES = 1024


def audit_chunks(chunks: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Shape findings over ``source_id, page, chunk_index, text``.

    The windows and the rebuild work on single pages, which entered as one row.
    """
    key = F.concat_ws(":p", "source_id", F.col("page").cast("string"))
    order = Window.partitionBy(*PAGE_KEY).orderBy("chunk_index")
    whole = Window.partitionBy(*PAGE_KEY)
    overlap = config.overlap
    seen = chunks.select(
        *PAGE_KEY, "chunk_index", "text",
        F.lag("text").over(order).alias("previous"),
        (F.row_number().over(order) - 1).alias("expected"),
        F.count(F.lit(1)).over(whole).alias("n"),
    )
    last = F.col("expected") == F.col("n") - 1
    shape = row_violations(seen, key, {
        "chunk_sequence": F.col("chunk_index") != F.col("expected"),
        "chunk_too_long": F.char_length("text") > config.size,
        "short_final_chunk": last & (F.col("n") > 1) & (F.char_length("text") <= overlap),
        "chunk_overlap": F.col("previous").isNotNull()
        & (F.substring("text", 1, overlap) != F.right("previous", F.lit(overlap))),
        "chunk_text": (F.col("text") == "")
        | (F.col("text") != text.normalize_text(F.col("text"))),
    })
    pieces = seen.groupBy(*PAGE_KEY).agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("pieces"))
    rebuilt = F.array_join(
        F.transform("pieces", lambda p, i: F.when(i == 0, p["text"]).otherwise(
            F.substring(p["text"], F.lit(overlap + 1), F.char_length(p["text"])))), "")
    normal = pieces.select(*PAGE_KEY, "pieces", text.normalize_text(rebuilt).alias("_normal"))
    again = normal.select(*PAGE_KEY, "pieces", chunk_windows(F.col("_normal"), config).alias("w"))
    same = F.transform("pieces", lambda p: p["text"]) == F.transform("w", lambda w: w["text"])
    broken = again.filter((F.size("pieces") > 1) & ~F.coalesce(same, F.lit(False)))
    return shape.unionByName(violations(broken, "chunk_progression", key))


def digest_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(source_id, status): added, removed, changed, same, or invalid stored digest."""
    old = stored.select("source_id", F.col("digest").alias("old"))
    new = current.select("source_id", F.col("digest").alias("new"))
    joined = old.join(new, "source_id", "full")
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("old").rlike("^[a-f0-9]{64}$"), "invalid")
        .when(F.col("old") != F.col("new"), "changed")
        .otherwise("same")
    )
    return joined.select("source_id", status.alias("status"))


_COMPARED = [
    "source_id", "project_id", "page", "title", "text", "terms", "aliases", "tags",
    "citation_label", "public_href", "knowledge_kind", "intents", "information_density",
    "page_role", "provenance", "evidence_pages", "question_aliases",
]


def verify_index(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Stored rows equal the re-derived rows, and each row obeys its own rules.

    Rows meet on the id with one digest each, so texts are not shuffled; only rows
    whose digests differ are compared column by column.
    """
    def digests(df: DataFrame, name: str) -> DataFrame:
        # Rows of a repeated id fold to one; the repetition is reported by itself.
        digest = F.sha2(F.to_json(F.struct(*_COMPARED)), 256)
        return df.select("id", digest.alias(name)).groupBy("id").agg(F.min(name).alias(name))

    joined = digests(stored, "have").join(digests(expected, "want"), "id", "full")
    unequal = joined.filter("have <> want").select("id")
    sides = [
        df.join(unequal, "id", "left_semi").groupBy("id").agg(F.min_by(
            F.struct(*_COMPARED), F.sha2(F.to_json(F.struct(*_COMPARED)), 256)).alias(name))
        for df, name in ((stored, "a"), (expected, "b"))]
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in _COMPARED]))
    changed = sides[0].join(sides[1], "id").select("id", F.explode(differing).alias("column"))
    return union_all([
        violations(joined.filter("have IS NULL"), "missing_chunk", F.col("id")),
        violations(joined.filter("want IS NULL"), "unexpected_chunk", F.col("id")),
        violations(changed, "differs", F.col("id"), F.col("column")),
        check_unique(stored, "id", rule="duplicate_chunk"),
        row_rules(stored),
    ])


def row_rules(chunks: DataFrame) -> DataFrame:
    """Layout rules of excerpt, document-claim and owner-claim rows."""
    claim = F.col("knowledge_kind") == "authored-claim"
    excerpt = F.col("knowledge_kind") == "source-excerpt"
    owner = F.col("provenance") == "owner_statement"
    intents = F.array(*[F.lit(i) for i in INTENTS])
    pages = F.col("evidence_pages")
    ascending = F.array_sort(F.array_distinct(pages)) == pages
    return row_violations(chunks, F.col("id"), {
        "knowledge_kind": ~F.coalesce(claim | excerpt, F.lit(False)),
        "unnormalized_text": (F.col("text") == "") | (F.col("text") != text.normalize_text(F.col("text"))),
        "no_terms": F.size("terms") < 1,
        "intents": (F.size(F.array_except("intents", intents)) > 0)
        | (F.size(F.array_distinct("intents")) != F.size("intents"))
        | (claim & (F.size("intents") == 0)) | (excerpt & (F.size("intents") > 0)),
        "density": ~F.coalesce(F.col("information_density").isin(*DENSITIES), F.lit(False))
        | (claim & (F.col("information_density") != "high")),
        "excerpt_layout": excerpt & (
            F.col("provenance").isNotNull() | (F.size("question_aliases") > 0)
            | (pages != F.array(F.col("page")))),
        "candidate_published": F.coalesce(F.col("provenance") == "candidate_contribution", F.lit(False)),
        "owner_layout": claim & owner & (
            F.col("page").isNotNull() | (F.size(pages) > 0) | (F.col("page_role") != "owner-confirmed")
            | (F.col("citation_label") != text.owner_label(F.col("title")))),
        "claim_evidence": claim & ~owner & (
            F.col("page").isNull() | (F.size(pages) == 0)
            | (F.get(pages, F.lit(0)) != F.col("page")) | ~ascending
            | (F.col("citation_label") != text.page_label(F.col("title"), F.col("page")))),
    })


def check_order(stored: DataFrame, order: list[str]) -> DataFrame:
    """Findings for rows of a Parquet table that precede a smaller key in file and row order.

    Each task walks the rows it reads and reports breaks inside its stretch and the stretch's first and last
    key. Only these summaries, a few a task, are put in order and compared with their neighbours.
    """
    names = ["file", "row", *order]
    rows = stored.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), *order)
    key = "struct<" + ", ".join(f"{c}: {rows.schema[c].dataType.simpleString()}" for c in order) + ">"

    def ranked(k: tuple) -> tuple:
        return tuple((v is not None, v) for v in k)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch: list | None = None
        out = []
        for batch in batches:
            for file, row, *k in zip(*(batch.column(c).to_pylist() for c in names)):
                if stretch is not None and stretch[0] == file and stretch[2] + 1 == row:
                    if ranked(stretch[4]) > ranked(k):
                        out.append((file, row, row, None, k, True))
                    stretch[2], stretch[4] = row, k
                else:
                    if stretch is not None:
                        out.append((*stretch, False))
                    stretch = [file, row, row, k, k]
        if stretch is not None:
            out.append((*stretch, False))
        shape = lambda k: None if k is None else dict(zip(order, k))
        kinds = pa.struct([(c, batch.schema.field(c).type) for c in order]) if out else pa.null()
        if out:
            file, low, high, first, last, broken = zip(*out)
            yield pa.RecordBatch.from_arrays([
                pa.array(file), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(list(map(shape, first)), kinds),
                pa.array(list(map(shape, last)), kinds), pa.array(broken)], ["file", "low", "high", "first", "last", "broken"])

    stretches = materialized(rows.mapInArrow(
        walk, f"file string, low bigint, high bigint, first {key}, last {key}, broken boolean"), "stretches")
    before = F.lag("last").over(Window.orderBy("file", "low"))  # a few rows a task
    ends = stretches.filter("NOT broken").withColumn("_before", before).filter(F.col("_before") > F.col("first"))
    at = F.concat_ws("#", "file", F.col("low").cast("string"))
    return violations(stretches.filter("broken"), "row_order", at).unionByName(violations(ends, "row_order", at))


def digest_tree(rows: DataFrame, leaf: Column, digest: Column, fan: int = TREE_NODES) -> DataFrame:
    """(level, node, rows, digest): a hash tree over the groups of ``leaf``.

    Level 2 has one node a leaf, level 1 ``fan`` nodes by the hash of the leaf, level 0 the root. Nodes add up
    row digests in lanes, so a hot leaf combines map-side; where order counts, ``digest`` holds the row's
    position. Equal trees have equal roots, and unequal ones are followed down to the leaves that differ.
    """
    def folded(level: int, nodes: DataFrame) -> DataFrame:
        lanes = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
        sums = nodes.groupBy("node").agg(
            F.sum("n").alias("rows"), *[F.sum(lane).cast("decimal(38,0)").alias(f"s{i}") for i, lane in enumerate(lanes)])
        text_ = F.concat_ws(":", "node", *[F.col(c).cast("string") for c in ("rows", "s0", "s1", "s2", "s3")])
        return sums.select(F.lit(level).alias("level"), "node", "rows", F.sha2(text_, 256).alias("digest"))

    def above(level: int, node: Column, below: DataFrame) -> DataFrame:
        return folded(level, below.select(node.cast("string").alias("node"), F.col("rows").alias("n"), F.col("digest").alias("h")))

    leaves = materialized(folded(2, rows.select(
        leaf.cast("string").alias("node"), F.lit(1).cast("bigint").alias("n"), digest.alias("h"))), "digest-leaves")
    middle = above(1, F.pmod(F.xxhash64("node"), F.lit(fan)), leaves)
    return leaves.unionByName(middle).unionByName(above(0, F.lit(""), middle))


def differing_leaves(have: DataFrame, want: DataFrame) -> DataFrame:
    """Findings for the leaves of two digest trees that differ, going down only where nodes above do."""
    def pairs(level: int) -> DataFrame:
        sides = [t.filter(F.col("level") == level).select("node", F.col("digest").alias(n)) for t, n in ((have, "have"), (want, "want"))]
        return sides[0].join(sides[1], "node", "full").filter(~F.col("have").eqNullSafe(F.col("want"))).select("node", "have", "want")

    fan = F.pmod(F.xxhash64("node"), F.lit(TREE_NODES)).cast("string").alias("_above")
    leaves = [t.filter("level = 2").select("node", "digest", fan).join(
        pairs(1).select(F.col("node").alias("_above")), "_above", "left_semi") for t in (have, want)]
    joined = leaves[0].select("node", F.col("digest").alias("have")).join(
        leaves[1].select("node", F.col("digest").alias("want")), "node", "full")
    return violations(joined.filter(~F.col("have").eqNullSafe(F.col("want"))), "range_differs", F.col("node"))


def check_meta(meta: DataFrame, digests: DataFrame, version: int = INDEX_VERSION) -> DataFrame:
    """Findings for an index header: its version and its set of source digests.

    ``meta(version, source_digests map)`` holds one row, ``digests(source_id, digest)`` what the sources say now.
    """
    stored = meta.select(F.explode("source_digests").alias("source_id", "have"))
    joined = stored.join(digests.select("source_id", F.col("digest").alias("want")), "source_id", "full")
    return union_all([
        violations(meta.filter(~F.coalesce(F.col("version") == version, F.lit(False))), "index_version", F.col("version")),
        violations(joined.filter("have IS NULL"), "missing_digest", F.col("source_id")),
        violations(joined.filter("want IS NULL"), "unexpected_digest", F.col("source_id")),
        violations(joined.filter("have <> want"), "wrong_digest", F.col("source_id")),
    ])
