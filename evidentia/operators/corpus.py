"""Corpus build: page routing, checks, chunking, assembly and reports.

Tables: ``sources(source_id, kind, title, aliases, tags, file_path, public_href,
project_id, page_count, structured_text, visual_pages, ordinal)``,
``pages(source_id, page, text, method)`` and
``page_meta(project_id, page, role, density)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.config import DENSITIES, NATIVE_TEXT_MINIMUM, ChunkingConfig
from evidentia.functions import text
from evidentia.operators.common import check_unique, row_violations, union_all, violations
from evidentia.operators.privacy import privacy_gate

_NO_STRINGS = "array<string>"


def route_page_text(pages: DataFrame) -> DataFrame:
    """Choose native or recognized text from ``native_text``, ``ocr_text``, ``visual``.

    ``missing_ocr`` marks pages whose short native text has no replacement.
    """
    native = text.squeeze(F.coalesce("native_text", F.lit("")))
    use_native = (F.char_length(native) >= NATIVE_TEXT_MINIMUM) | F.coalesce("visual", F.lit(False))
    rest = [c for c in pages.columns if c not in ("native_text", "ocr_text", "visual")]
    return pages.select(
        *rest,
        F.when(use_native, native).otherwise(text.squeeze(F.col("ocr_text"))).alias("text"),
        F.when(use_native, "pdf-text").otherwise("ocr").alias("method"),
        (~use_native & F.col("ocr_text").isNull()).alias("missing_ocr"),
    )


def check_sources(sources: DataFrame) -> DataFrame:
    profile = F.col("kind") == "profile"
    blank = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    visual, tags = F.col("visual_pages"), F.col("tag_keys")
    # Tags are folded as one string because a UDF cannot run per array element.
    keyed = sources.withColumn(
        "tag_keys",
        F.transform(
            F.split(text.fold(F.array_join("tags", "\n")), "\n"),
            lambda t: F.regexp_replace(t, rf"[\p{{P}}\p{{S}}{text.SPACE}]", ""),
        ),
    )
    rules = {
        "missing_id": blank("source_id"),
        "missing_viewer_target": blank("title") | blank("public_href"),
        "missing_structured_text": profile & blank("structured_text"),
        "missing_file_path": ~profile & blank("file_path"),
        "invalid_page_count": ~profile & (F.coalesce("page_count", F.lit(0)) < 1),
        "invalid_visual_pages": ~profile & (
            (F.size(F.array_distinct(visual)) != F.size(visual))
            | F.exists(visual, lambda p: (p < 1) | (p > F.col("page_count")))
        ),
        "invalid_tags": (F.col("kind") == "project-pdf") & (F.size("tags") > 0) & (
            F.array_contains(tags, "") | (F.size(F.array_distinct(tags)) != F.size(tags))
        ),
        "invalid_project_id": (F.col("kind") == "project-pdf")
        & ~F.col("project_id").eqNullSafe(F.col("source_id")),
    }
    return union_all([
        row_violations(keyed, F.col("source_id"), rules),
        check_unique(sources, "source_id", rule="duplicate_source"),
    ])


def check_project_matches(sources: DataFrame, projects: DataFrame) -> DataFrame:
    """Every project has exactly one manifest row of its own."""
    counts = sources.filter("kind = 'project-pdf'").groupBy(
        F.col("source_id").alias("project_id")).agg(F.count(F.lit(1)).alias("n"))
    joined = projects.select("project_id").distinct().join(counts, "project_id", "left")
    found = F.coalesce("n", F.lit(0))
    return violations(joined.filter(found != 1), "manifest_match", F.col("project_id"), found)


def check_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages of a source are exactly 1..N and non-visual pages have text."""
    expected = sources.select(
        "source_id",
        F.when(F.col("kind") == "profile", 1).otherwise(F.col("page_count")).alias("expected"),
        "visual_pages",
    )
    counts = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    totals = expected.join(counts, "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Expected pages are generated where each source row lives; the anti join
    # hashes on (source, page), so a source with many pages spreads out.
    wanted = expected.filter("expected >= 1").select(
        "source_id", F.explode(F.sequence(F.lit(1), F.col("expected"))).alias("page"))
    missing = wanted.join(pages.select("source_id", "page"), ["source_id", "page"], "left_anti")
    placed = pages.join(expected, "source_id")
    key = F.concat_ws(":p", "source_id", F.col("page").cast("string"))
    return union_all([
        violations(totals.filter("n <> expected"), "page_count", F.col("source_id"),
                   F.concat_ws("/", F.col("n").cast("string"), F.col("expected").cast("string"))),
        violations(missing, "missing_page", key),
        violations(placed.filter("page < 1 OR page > expected"), "unexpected_page", key),
        check_unique(pages, "source_id", "page", rule="duplicate_page"),
        violations(
            placed.filter(
                ~F.coalesce(F.array_contains("visual_pages", F.col("page")), F.lit(False))
                & ~text_remains(F.col("text"))
            ),
            "blank_page", key),
    ])


def text_remains(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(f"[^{text.SPACE}]")


def with_page_meta(pages: DataFrame, sources: DataFrame, page_meta: DataFrame) -> DataFrame:
    """Attach density and role; ``meta_missing`` marks project pages without any."""
    meta = page_meta.select(
        "project_id", "page", F.col("role").alias("_role"), F.col("density").alias("_density"))
    joined = pages.join(
        sources.drop("structured_text"), "source_id"
    ).join(meta, ["project_id", "page"], "left")
    fixed = F.col("kind").isin("profile", "resume")
    valid = F.col("_density").isin(*DENSITIES) & (F.col("_role") != "")
    return joined.select(
        *[F.col(c) for c in joined.columns if not c.startswith("_")],
        F.when(fixed, "medium").otherwise(F.col("_density")).alias("information_density"),
        F.when(fixed, F.col("kind")).otherwise(F.col("_role")).alias("page_role"),
        (~fixed & ~F.coalesce(valid, F.lit(False))).alias("meta_missing"),
    )


def chunk_windows(normalized: Column, config: ChunkingConfig = ChunkingConfig()) -> Column:
    """Overlapping windows of one normalized page, or null where none can end.

    Every start depends on the previous end, so one pattern consumes the page from start to start: as many characters
    as fit, so that the window does not end behind a space and the next one does not start with one.
    """
    size, overlap = config.size, config.overlap
    if overlap == 0:
        shared = "(?<=[^ ])()"
    elif overlap == 1:
        shared = "(?=([^ ]))"
    else:
        shared = f"(?=([^ ].{{{overlap - 2}}}[^ ]))"
    step = F.lit(f"(?s)\\G(?=.{{{size + 1}}})(.{{1,{size - overlap}}}){shared}")
    steps = F.arrays_zip(
        F.regexp_extract_all(normalized, step, F.lit(1)).alias("piece"), F.regexp_extract_all(normalized, step, F.lit(2)).alias("tail"))
    starts = F.aggregate(
        steps, F.array(F.lit(0)), lambda all_, s: F.concat(all_, F.array(F.element_at(all_, -1) + F.char_length(s["piece"]))))
    row = lambda n, start, value: F.struct(
        n.cast("int").alias("chunk_index"), start.alias("start"), value.alias("text"))
    rest = lambda w: F.substring(normalized, F.element_at(w["starts"], -1) + 1, F.char_length(normalized))
    window = lambda w: F.concat(
        F.transform(w["steps"], lambda s, n: row(n, F.get(w["starts"], n), F.concat(s["piece"], s["tail"]))),
        F.array(row(F.size(w["steps"]), F.element_at(w["starts"], -1), rest(w))))
    found = F.transform(F.array(F.struct(steps.alias("steps"), starts.alias("starts"))), lambda w: F.when(
        F.char_length(normalized) - F.element_at(w["starts"], -1) <= size, window(w)))
    return F.filter(F.element_at(found, 1), lambda w: w["text"] != "")


def _with_windows(pages: DataFrame, config: ChunkingConfig) -> DataFrame:
    """Pages with ``_windows``. The normal form is a column of its own, as it may come from Python."""
    return pages.withColumn("_normal", text.normalize_text(F.col("text"))).withColumn(
        "_windows", chunk_windows(F.col("_normal"), config)).drop("_normal")


def chunk_pages(pages: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """``text`` of each page row to chunk rows; other columns are carried along."""
    rest = [c for c in pages.columns if c != "text"]
    # More than a bare column: windows would be made twice, once to drop pages without any.
    return _with_windows(pages, config).select(*rest, F.inline(F.coalesce("_windows", F.slice("_windows", 1, 0))))


def unchunkable_pages(pages: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Pages on which no window can end outside white space."""
    broken = _with_windows(pages.filter(F.col("text").isNotNull()), config)
    return violations(
        broken.filter(F.col("_windows").isNull()), "no_chunk_boundary",
        F.concat_ws(":p", "source_id", F.col("page").cast("string")))


def excerpt_chunks(
    pages: DataFrame, sources: DataFrame, page_meta: DataFrame,
    config: ChunkingConfig = ChunkingConfig(),
) -> DataFrame:
    """Source-excerpt rows of the canonical chunk layout, plus order columns."""
    placed = with_page_meta(pages, sources, page_meta)
    chunks = chunk_pages(placed, config)
    metadata = F.concat_ws(" ", "title", F.array_join("aliases", " "), F.array_join("tags", " "), "text")
    empty = F.array().cast(_NO_STRINGS)
    return chunks.select(
        text.chunk_id(F.col("source_id"), F.col("page"), F.col("chunk_index")).alias("id"),
        "source_id", "project_id", F.col("page").cast("int").alias("page"), "title", "text",
        text.build_terms(metadata).alias("terms"), "aliases", "tags",
        F.when(F.col("kind") == "profile", F.col("title"))
        .otherwise(text.page_label(F.col("title"), F.col("page"))).alias("citation_label"),
        "public_href", F.lit("source-excerpt").alias("knowledge_kind"),
        empty.alias("intents"), "information_density", "page_role",
        F.lit(None).cast("string").alias("provenance"),
        F.array(F.col("page").cast("int")).alias("evidence_pages"),
        empty.alias("question_aliases"),
        "ordinal", "chunk_index",
    )


def build_index(excerpts: DataFrame, claims: DataFrame, allow: list[str] = []) -> dict[str, DataFrame]:
    """Excerpts then claims as one table, with duplicate-id and privacy findings.

    ``part`` 0/1 and the ordinals keep the canonical order for ``write_index``.
    """
    rows = excerpts.withColumn("part", F.lit(0)).unionByName(
        claims.withColumn("part", F.lit(1)), allowMissingColumns=True)
    published = F.concat_ws(
        "\n", "id", "title", "text", "citation_label", "public_href", "page_role",
        *[F.array_join(c, "\n") for c in ("aliases", "tags", "question_aliases")])
    gate = privacy_gate(rows.withColumn("_published", published), "_published", allow)
    return {
        "index": gate["safe"].drop("_published"),
        "quarantined": gate["quarantined"].drop("_published"),
        "violations": check_unique(rows, "id", rule="duplicate_chunk"),
    }


def extraction_report(pages: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Counts per source: pages by method, empty visual pages and chunks."""
    visual = sources.select("source_id", "visual_pages")
    counts = pages.join(visual, "source_id", "left").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("method") == "pdf-text").alias("native"),
        F.count_if(F.col("method") == "ocr").alias("ocr"),
        F.count_if(F.col("method") == "structured").alias("structured"),
        F.count_if(
            F.coalesce(F.array_contains("visual_pages", F.col("page")), F.lit(False))
            & ~text_remains(F.col("text"))
        ).alias("empty_visual"),
    )
    per_source = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"))
    return counts.join(per_source, "source_id", "left").na.fill(0, ["chunks"])


def corpus_digest(rows: DataFrame, digest: Column) -> DataFrame:
    """One digest over all rows, independent of partitioning.

    Each row digest is cut into four 60-bit lanes; lane sums and the row count
    combine map-side into one small row, however large or repetitive the input.
    """
    lanes = [
        F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)
    ]
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(lane), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}")
          for i, lane in enumerate(lanes)],
    )
    return sums.select(
        F.col("n").alias("rows"),
        F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in sums.columns]), 256).alias("digest"),
    )


def profile_text(profiles: DataFrame) -> DataFrame:
    """Fold ``name, discipline, introduction, school, program, period`` and
    ``capabilities<title, items>`` into one labelled page of structured text."""
    capability = F.transform(
        "capabilities",
        lambda c: F.concat(c["title"], F.lit("（"), F.array_join(c["items"], "、"), F.lit("）")),
    )
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("姓名："), "name"),
        F.concat(F.lit("方向："), "discipline"),
        F.concat(F.lit("简介："), "introduction"),
        F.concat(F.lit("教育："), F.concat_ws("，", "school", "program", "period")),
        F.concat(F.lit("能力："), F.array_join(capability, "；")),
    )
    return profiles.select(
        "source_id", F.lit(1).alias("page"), lines.alias("text"), F.lit("structured").alias("method"))


def asset_paths(project: Column, digest: Column, page: Column) -> dict[str, Column]:
    """Path of the two renditions of a page below a digest folder."""
    base = F.concat(
        F.lit("/projects/pages/"), project, F.lit("/"), F.substring(digest, 1, 12), F.lit("/"),
        F.when(page < 100, F.lpad(page.cast("string"), 2, "0")).otherwise(page.cast("string")))
    return {
        "mobile": F.concat(base, F.lit("-960.webp")),
        "desktop": F.concat(base, F.lit("-1800.webp")),
    }


def build_asset_manifest(pages: DataFrame, digests: DataFrame) -> DataFrame:
    """One row per ``project_id, page`` with its paths, hash and the page count.

    The manifest stays flat: the count comes from a combined aggregate instead of
    collecting a project's pages into one row.
    """
    counts = pages.groupBy("project_id").agg(F.count(F.lit(1)).alias("page_count"))
    rows = pages.join(digests, "project_id").join(counts, "project_id")
    paths = asset_paths(F.col("project_id"), F.col("digest"), F.col("page"))
    return rows.select(
        "project_id", F.substring("digest", 1, 12).alias("source_hash"), "page_count", "page",
        *[c.alias(n) for n, c in paths.items()])


def check_assets(manifest: DataFrame, listing: DataFrame, digests: DataFrame,
                 expected: DataFrame) -> DataFrame:
    """Findings over a flat manifest ``project_id, project_ord, source, source_hash,
    page_count, page_ord, page, mobile, desktop``.

    ``expected(project_id, project_ord, page_count)`` is the published catalog,
    ``digests(path, digest)`` the current source files.
    """
    key = F.concat_ws(":p", "project_id", F.col("page").cast("string"))
    projects = manifest.select(
        "project_id", "project_ord", "source", "source_hash", "page_count").distinct()
    counts = manifest.groupBy("project_id", "page_count").agg(F.count("page").alias("n"))
    referenced = union_all([
        manifest.select(key.alias("key"), F.col(c).alias("path"), F.lit("page_asset").alias("what"))
        for c in ("mobile", "desktop")
    ] + [projects.select(F.col("project_id").alias("key"), F.col("source").alias("path"),
                         F.lit("source").alias("what"))])
    escape = ~F.col("path").startswith("/") | F.array_contains(F.split("path", r"[/\\]"), "..")
    found = referenced.filter(~escape).join(listing, "path", "left")
    hashed = projects.join(digests.withColumnRenamed("path", "source"), "source")
    placed = projects.join(
        expected.select("project_id", F.col("project_ord").alias("_ord"),
                        F.col("page_count").alias("_pages")), "project_id", "full")
    return union_all([
        row_violations(manifest, key, {
            "page_sequence": F.col("page") != F.col("page_ord") + 1,
            "mobile_suffix": ~F.col("mobile").endswith("-960.webp"),
            "desktop_suffix": ~F.col("desktop").endswith("-1800.webp"),
        }),
        violations(counts.filter("n <> page_count"), "page_count", F.col("project_id"), F.col("n")),
        violations(referenced.filter(escape), "path_escapes_root", F.col("key"), F.col("path")),
        violations(found.filter("length IS NULL"), "missing_file", F.col("key"), F.col("path")),
        violations(found.filter("length <= 0"), "empty_file", F.col("key"), F.col("path")),
        violations(hashed.filter(~F.col("digest").startswith(F.col("source_hash"))),
                   "source_hash", F.col("project_id")),
        violations(
            placed.filter("NOT (_ord <=> project_ord AND _pages <=> page_count)"),
            "catalog_mismatch", F.col("project_id")),
    ])
