"""Sources, sinks, corpus build, authored claims and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import authored, corpus, verify
from evidentia.operators import common
from evidentia.operators.common import scratch_path
from evidentia.sources import readers, writers
from workload import world
from workload.registry import query
from workload.world import SQL_CHUNKS, SQL_CLAIMS, SQL_PAGES, SQL_SOURCES, sql_norm, sql_terms


def _counts(findings):
    return findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------- sources, sinks
@query(f"WITH {SQL_SOURCES} SELECT source_id, 'project-pdf' AS kind, title, len(aliases) AS n_aliases, page_count, NULL::VARCHAR AS structured_text FROM sources_")
def read_sources(t):
    rows = world.document_sources(t).select(
        F.col("source_id").alias("id"), "kind", "title", "aliases", "tags",
        F.col("file_path").alias("filePath"), F.col("public_href").alias("publicHref"),
        F.col("project_id").alias("projectId"), F.col("page_count").alias("pageCount"))
    path = scratch_path(t.spark, "manifest")
    rows.write.json(path)
    return readers.read_sources(t.spark, path).select(
        "source_id", "kind", "title", F.size("aliases").alias("n_aliases"), "page_count", "structured_text")


def _written_benchmark(t):
    """One text file per benchmark row, in a folder named by its id."""
    path = scratch_path(t.spark, "documents")
    t.benchmark.select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy(
        "item_id").option("lineSep", "\n").text(path)
    return path


@query("SELECT item_id, sha256(text || chr(10)) AS digest, strlen(text) + 1 AS length FROM benchmark")
def read_document_digests(t):
    found = readers.read_document_digests(t.spark, _written_benchmark(t))
    return found.select(
        F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"), "digest", "length")


@query("SELECT item_id, strlen(text) + 1 AS length FROM benchmark")
def read_asset_listing(t):
    found = readers.read_asset_listing(t.spark, _written_benchmark(t))
    return found.select(F.regexp_extract("path", "^/item_id=([0-9]+)/", 1).cast("bigint").alias("item_id"), "length")


@query(f"""WITH {SQL_CLAIMS} SELECT p.project_id, p.title, 10 AS page_count, count(*) AS n_claims,
count(*) FILTER (part % 3 = 0) AS n_questions, 0 AS corrupt FROM projects_ p JOIN claims_ USING (project_id) GROUP BY ALL""")
def read_dossiers(t):
    path = scratch_path(t.spark, "dossiers")
    world.dossiers(t).write.json(path)
    return readers.read_dossiers(t.spark, path, multi_line=False).select(
        F.col("projectId").alias("project_id"), "title", F.col("pageCount").alias("page_count"),
        F.size("claims").alias("n_claims"), F.size("commonQuestions").alias("n_questions"),
        F.col("_corrupt_record").isNotNull().cast("int").alias("corrupt"))


def _glossary(t):
    return t.part.select(
        F.lit(1).alias("version"), F.col("p_partkey").alias("entry"), F.col("p_name").alias("canonical"),
        F.array(F.concat("p_brand", F.lit(" "), "p_type"), F.upper("p_name")).alias("aliases"),
        F.array(world._intent(F.col("p_size") % 11)).alias("intents"))


SQL_GLOSSARY = f"glossary_ AS (SELECT p_partkey AS entry, p_name AS canonical, [p_brand || ' ' || p_type, upper(p_name)] AS aliases, [{world.SQL_INTENTS}[(p_size % 11)::INT + 1]] AS intents FROM part)"


@query("SELECT p_name AS canonical, p_brand || ' ' || p_type AS alias, count(*) AS n FROM part GROUP BY ALL")
def read_glossary(t):
    """Documents of forty entries each."""
    path = scratch_path(t.spark, "glossary")
    entry = F.struct("canonical", "aliases", "intents")
    _glossary(t).groupBy(F.floor(F.col("entry") / 40).alias("g")).agg(
        F.lit(1).alias("version"), F.collect_list(entry).alias("entries")).drop("g").write.json(path)
    read = readers.read_glossary(t.spark, path, multi_line=False)
    return read.groupBy("canonical", F.get("aliases", F.lit(0)).alias("alias")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id AS id, source_id, page, sha256(text) AS digest FROM chunks_")
def write_index(t):
    path = scratch_path(t.spark, "index")
    for _ in range(2):  # the second publication replaces the first
        writers.write_index(world.document_chunks(t), path, ["source_id", "page", "id"])
    return writers.read_index(t.spark, path).select("id", "source_id", "page", F.sha2("text", 256).alias("digest"))


@query("SELECT conv_id, turn, sha256('event: delta' || chr(10) || 'data: ' || json_object('text', text) || chr(10) || chr(10)) AS digest FROM conversations")
def encode_events(t):
    rows = t.conversations.select(
        "conv_id", "turn", F.lit("delta").alias("type"), F.struct("text").alias("data"))
    return writers.encode_events(rows).select("conv_id", "turn", F.sha2("value", 256).alias("digest"))


# ----------------------------------------------------------------- corpus build
_SQUEEZED = sql_norm("regexp_replace(html, '<[^>]*>', ' ', 'g')")


@query(f"""SELECT page_id, CASE WHEN ok THEN 'pdf-text' ELSE 'ocr' END AS method, sha256(CASE WHEN ok THEN n ELSE o END) AS digest, NOT ok AND o IS NULL AS missing_ocr
FROM (SELECT page_id, n, o, length(n) >= 40 OR page_id % 7 = 0 AS ok FROM
(SELECT page_id, CASE WHEN page_id % 3 = 0 THEN trim(substr(s, 1, 30)) ELSE s END AS n, CASE WHEN page_id % 5 <> 0 THEN {sql_norm('url')} END AS o
 FROM (SELECT page_id, url, {_SQUEEZED} AS s FROM pages)))""")
def route_page_text(t):
    native = text.squeeze(F.regexp_replace("html", "<[^>]*>", " "))
    pages = t.pages.select(
        "page_id", F.when(F.col("page_id") % 3 == 0, F.substring(native, 1, 30)).otherwise(native).alias("native_text"),
        F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("ocr_text"), (F.col("page_id") % 7 == 0).alias("visual"))
    return corpus.route_page_text(pages).select(
        "page_id", "method", F.sha2("text", 256).alias("digest"), "missing_ocr")


def _supplier_sources(t):
    """Manifest rows with every kind of defect among them."""
    key = F.col("s_suppkey")
    return t.supplier.select(
        F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("s"), F.floor(key / 2).cast("string"))).alias("source_id"),
        F.when(key % 9 == 0, "profile").otherwise("project-pdf").alias("kind"),
        F.when(key % 13 == 0, "").otherwise(F.col("s_name")).alias("title"),
        F.array("s_name", F.when(key % 8 == 0, F.upper("s_name")).otherwise("x")).alias("tags"),
        F.when(key % 11 != 0, F.col("s_name")).alias("file_path"), F.lit("/x").alias("public_href"),
        F.concat(F.lit("s"), F.floor(key / 2).cast("string")).alias("project_id"),
        (key % 4).cast("int").alias("page_count"), F.when(key % 2 == 0, "text").alias("structured_text"),
        F.array((key % 5).cast("int"), F.lit(1)).alias("visual_pages"))


@query("""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 17 = 0 THEN '' ELSE 's' || (s_suppkey // 2) END AS id,
 s_suppkey % 9 = 0 AS profile, s_suppkey % 4 AS pages, s_suppkey % 5 AS v FROM supplier)
SELECT * FROM (SELECT 'missing_id' AS rule, count(*) AS n FROM s WHERE id = ''
UNION ALL SELECT 'missing_viewer_target', count(*) FROM s WHERE k % 13 = 0
UNION ALL SELECT 'missing_structured_text', count(*) FROM s WHERE profile AND k % 2 <> 0
UNION ALL SELECT 'missing_file_path', count(*) FROM s WHERE NOT profile AND k % 11 = 0
UNION ALL SELECT 'invalid_page_count', count(*) FROM s WHERE NOT profile AND pages < 1
UNION ALL SELECT 'invalid_visual_pages', count(*) FROM s WHERE NOT profile AND (v = 1 OR v < 1 OR v > pages OR 1 > pages)
UNION ALL SELECT 'invalid_tags', count(*) FROM s WHERE NOT profile AND k % 8 = 0
UNION ALL SELECT 'invalid_project_id', count(*) FROM s WHERE NOT profile AND id = ''
UNION ALL SELECT 'duplicate_source', count(*) FROM (SELECT id FROM s GROUP BY id HAVING count(*) > 1)) WHERE n > 0""")
def check_sources(t):
    return _counts(corpus.check_sources(_supplier_sources(t)))


@query("""SELECT 'manifest_match' AS rule, count(*) AS n FROM (SELECT 's' || (o_orderkey % (SELECT count(*) // 2 + 10 FROM supplier)) AS p FROM orders GROUP BY p) q
LEFT JOIN (SELECT CASE WHEN s_suppkey % 17 = 0 THEN '' ELSE 's' || (s_suppkey // 2) END AS p, count(*) AS n FROM supplier WHERE s_suppkey % 9 <> 0 GROUP BY 1) m USING (p) WHERE coalesce(n, 0) <> 1""")
def check_project_matches(t):
    known = t.supplier.select(F.floor(F.count(F.lit(1)) / 2) + 10).scalar()
    projects = t.orders.select(F.concat(F.lit("s"), (F.col("o_orderkey") % known).cast("string")).alias("project_id"))
    return _counts(corpus.check_project_matches(_supplier_sources(t), projects))


@query("""WITH p AS (SELECT l_orderkey AS s, l_linenumber AS page, l_returnflag AS f FROM lineitem),
o AS (SELECT o_orderkey AS s, 1 + o_custkey % 5 AS expected FROM orders),
c AS (SELECT s, count(*) AS n FROM p GROUP BY s)
SELECT * FROM (SELECT 'page_count' AS rule, count(*) AS n FROM o LEFT JOIN c USING (s) WHERE coalesce(n, 0) <> expected
UNION ALL SELECT 'missing_page', count(*) FROM (SELECT s, unnest(range(1, expected + 1)) AS page FROM o) w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.s = w.s AND p.page = w.page)
UNION ALL SELECT 'unexpected_page', count(*) FROM p JOIN o USING (s) WHERE page < 1 OR page > expected
UNION ALL SELECT 'duplicate_page', count(*) FROM (SELECT s, page FROM p GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'blank_page', count(*) FROM p JOIN o USING (s) WHERE f = 'R' AND page <> 2)""")
def check_pages(t):
    pages = t.lineitem.select(
        F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("page"),
        F.when(F.col("l_returnflag") == "R", " ").otherwise("text").alias("text"))
    sources = t.orders.select(
        F.col("o_orderkey").alias("source_id"), F.lit("project-pdf").alias("kind"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("page_count"), F.array(F.lit(2)).alias("visual_pages"))
    return _counts(corpus.check_pages(pages, sources))


_DENSITY = "CASE l.quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END"


@query(f"SELECT d.doc_id, {_DENSITY} AS information_density, 'detail' AS page_role, false AS meta_missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def with_page_meta(t):
    placed = corpus.with_page_meta(world.document_pages(t), world.document_sources(t), world.document_meta(t))
    return placed.select("doc_id", "information_density", "page_role", "meta_missing")


SQL_WINDOWS = f"""{SQL_PAGES}, {SQL_SOURCES}, norm_ AS (SELECT doc_id, source_id, page, {sql_norm('text')} AS text FROM pages_),
cuts AS (SELECT doc_id, text, 0 AS idx, 0 AS s, least(1200, length(text)) AS e, length(text) AS n, false AS emitted FROM norm_ WHERE text <> ''
 UNION ALL
 SELECT doc_id, text,
  CASE WHEN emitted THEN idx + 1 ELSE idx END, CASE WHEN emitted THEN e - 150 ELSE s END,
  CASE WHEN emitted THEN least(e - 150 + 1200, n) WHEN back THEN e - 1 ELSE e END, n,
  NOT emitted AND NOT back
 FROM (SELECT *, e < n AND e > s + 150 AND (text[e] = ' ' OR text[e - 149] = ' ') AS back FROM cuts)
 WHERE NOT (emitted AND e = n))"""
SQL_CHUNKED = (f"{SQL_WINDOWS}, chunks_ AS (SELECT n.source_id || ':p' || n.page || ':c' || c.idx AS chunk_id, n.doc_id, n.source_id,"
               " n.page, c.idx AS chunk_index, c.s AS start, o.title, o.aliases, o.tags, substr(c.text, c.s + 1, c.e - c.s) AS text"
               " FROM cuts c JOIN norm_ n USING (doc_id) JOIN sources_ o USING (source_id) WHERE c.emitted)")


@query(f"WITH RECURSIVE {SQL_CHUNKED} SELECT doc_id, chunk_index, start, sha256(text) AS digest FROM chunks_")
def chunk_pages(t):
    return corpus.chunk_pages(world.document_pages(t)).select(
        "doc_id", "chunk_index", "start", F.sha2("text", 256).alias("digest"))


@query(f"""WITH RECURSIVE {SQL_CHUNKED} SELECT chunk_id AS id, title || ' · p. ' || page AS citation_label, {_DENSITY} AS information_density,
len({sql_terms("concat_ws(' ', title, array_to_string(aliases, ' '), array_to_string(tags, ' '), text)")}) AS n_terms
FROM chunks_ c LEFT JOIN labels l USING (doc_id)""")
def excerpt_chunks(t):
    return _excerpts(t).select("id", "citation_label", "information_density", F.size("terms").alias("n_terms"))


def _excerpts(t):
    return corpus.excerpt_chunks(
        world.document_pages(t).drop("doc_id"), world.document_sources(t), world.document_meta(t))


@query("SELECT 'none' AS rule, 0 AS n WHERE false")
def unchunkable_pages(t):
    return _counts(corpus.unchunkable_pages(world.document_pages(t)))


@query(f"""WITH RECURSIVE {SQL_CHUNKED}, last_ AS (SELECT doc_id, max(chunk_index) AS m FROM chunks_ GROUP BY doc_id),
gone AS (SELECT * FROM last_ WHERE doc_id % 3 = 0 AND m >= 2), cut AS (SELECT * FROM last_ WHERE doc_id % 3 = 1 AND m >= 1)
SELECT * FROM (SELECT 'chunk_sequence' AS rule, sum(m - 1)::BIGINT AS n FROM gone
UNION ALL SELECT 'chunk_overlap', (SELECT count(*) FROM gone g JOIN chunks_ a ON a.doc_id = g.doc_id AND a.chunk_index = 0 JOIN chunks_ b ON b.doc_id = g.doc_id AND b.chunk_index = 2 WHERE right(a.text, 150) <> left(b.text, 150)) + (SELECT count(*) FROM cut)
UNION ALL SELECT 'chunk_too_long', (SELECT count(*) FROM cut JOIN chunks_ USING (doc_id) WHERE chunk_index = 1 AND length(text) >= 1200)
UNION ALL SELECT 'chunk_progression', (SELECT count(*) FROM gone) + (SELECT count(*) FROM cut)
UNION ALL SELECT 'short_final_chunk', (SELECT count(*) FROM gone JOIN chunks_ USING (doc_id) WHERE chunk_index = m AND length(text) <= 150)) WHERE n > 0""")
def audit_chunks(t):
    """Chunks with some second windows removed and some second windows clipped."""
    chunks = corpus.chunk_pages(world.document_pages(t)).drop("start")
    counts = chunks.groupBy("doc_id").agg(F.max("chunk_index").alias("m"))
    second = F.col("chunk_index") == 1
    damaged = chunks.join(counts, "doc_id").filter(
        ~(second & (F.col("doc_id") % 3 == 0) & (F.col("m") >= 2))).withColumn("text", F.when(
            second & (F.col("doc_id") % 3 == 1), F.concat(F.lit("x"), "text")).otherwise(F.col("text")))
    return _counts(verify.audit_chunks(damaged.drop("m")))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 50 = 0 THEN 'added' WHEN doc_id % 50 = 1 THEN 'removed' WHEN doc_id % 50 = 2 THEN 'changed'
 WHEN doc_id % 50 = 3 THEN 'invalid' ELSE 'same' END AS status FROM documents) GROUP BY status""")
def digest_drift(t):
    digest = F.sha2("text", 256)
    rows = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "doc_id", "text")
    kind = F.col("doc_id") % 50
    stored = rows.filter(kind != 0).select(
        "source_id", F.when(kind == 3, "broken").otherwise(digest).alias("digest"))
    current = rows.filter(kind != 1).select(
        "source_id", F.when(kind == 2, F.sha2(F.upper(F.concat("text", F.lit("x"))), 256)).otherwise(digest).alias("digest"))
    return verify.digest_drift(stored, current).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'duplicate_key' AS rule, l_orderkey || '|' || l_linenumber AS key, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def check_unique(t):
    return common.check_unique(t.lineitem, "l_orderkey", "l_linenumber")


@query(f"""WITH {SQL_CLAIMS}, {SQL_PAGES}, {SQL_SOURCES} SELECT 'source-excerpt' AS knowledge_kind, count(*) AS n FROM documents
WHERE NOT regexp_matches(text, '@|\\+1 \\(|(?i)address[:：]') UNION ALL SELECT 'authored-claim', count(*) FROM claims_ WHERE public AND provenance <> 'candidate_contribution'""")
def build_index(t):
    """Documents and published claims in one table behind the privacy gate."""
    excerpts = world.document_chunks(t).withColumn("ordinal", F.col("source_id")).withColumn("chunk_index", F.lit(0))
    claims = _claim_chunks(t).withColumn("ordinal", F.col("ordinal").cast("string")).drop("terms")
    built = corpus.build_index(excerpts, claims)
    return built["index"].groupBy("knowledge_kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT rule, count(*) AS n FROM (SELECT CASE WHEN doc_id % 97 = 0 THEN 'missing_chunk' WHEN doc_id % 50 = 1 THEN 'differs' END AS rule FROM documents
UNION ALL SELECT 'candidate_published' FROM documents WHERE doc_id % 97 <> 0 AND doc_id % 71 = 0
UNION ALL SELECT 'excerpt_layout' FROM documents WHERE doc_id % 97 <> 0 AND doc_id % 71 = 0
UNION ALL SELECT 'differs' FROM documents WHERE doc_id % 97 <> 0 AND doc_id % 71 = 0
UNION ALL SELECT 'unexpected_chunk' FROM documents WHERE doc_id % 89 = 3) WHERE rule IS NOT NULL GROUP BY rule""")
def verify_index(t):
    """A stored index with removed, added, retitled and unpublishable rows."""
    expected = common.materialized(
        world.document_chunks(t).withColumn("terms", F.array(F.lit("t"))), "expected")
    doc = (F.col("page") - 1) * 20 + F.substring(F.col("source_id"), F.lit(4), F.lit(9)).cast("int")
    stored = expected.filter(doc % 97 != 0).withColumns({
        "title": F.when(doc % 50 == 1, "other").otherwise(F.col("title")),
        "provenance": F.when(doc % 71 == 0, "candidate_contribution").otherwise(F.col("provenance"))})
    added = expected.filter(doc % 89 == 3).withColumn("id", F.concat("id", F.lit("x")))
    stored = common.materialized(stored.unionByName(added), "stored")
    return _counts(verify.verify_index(stored, expected))


@query("""SELECT doc_id, CASE WHEN kind = 2 THEN sha256(text || 'x') ELSE sha256(text) END AS digest
FROM (SELECT doc_id, text, doc_id % 50 AS kind FROM documents) WHERE kind <> 1""")
def rebuild_index(t):
    """An index of one source a document, after some were added, removed and changed."""
    kind = F.col("doc_id") % 50
    rows = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "doc_id", "text")
    before = rows.filter(kind != 0)
    now = rows.filter(kind != 1).withColumn("text", F.when(kind == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    path, digest = scratch_path(t.spark, "rebuilt"), F.sha2("text", 256).alias("digest")
    writers.write_buckets(before, path, ["doc_id"])
    drift = verify.digest_drift(before.select("source_id", digest), now.select("source_id", digest))
    writers.rebuild_index(drift, lambda sources: now.join(sources, "source_id", "left_semi"), path, ["doc_id"])
    return writers.read_index(t.spark, path).select("doc_id", digest)


@query("SELECT 'row_order' AS rule, count(*) AS n FROM documents WHERE doc_id % 50 = 8")
def check_order(t):
    """A published table whose keys are swapped at every fiftieth row."""
    path, k = scratch_path(t.spark, "ordered"), F.col("doc_id") % 50
    swapped = t.documents.select("doc_id", F.when(k == 7, F.col("doc_id") + 1).when(k == 8, F.col("doc_id") - 1).otherwise(
        F.col("doc_id")).alias("key"))
    writers.write_index(swapped, path, ["doc_id"])
    return _counts(verify.check_order(writers.read_index(t.spark, path), ["key"]))


@query("SELECT DISTINCT 'range_differs' AS rule, source AS key FROM documents WHERE doc_id % 97 = 0")
def differing_ranges(t):
    """Sources in which some text has another position than before."""
    place = F.when(F.col("doc_id") % 97 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    tree = lambda position: verify.digest_tree(
        t.documents, F.col("source"), F.sha2(F.concat_ws(":", position.cast("string"), F.sha2("text", 256)), 256))
    return verify.differing_leaves(tree(place), tree(F.col("doc_id"))).select("rule", "key")


@query("""SELECT rule, count(*) AS n FROM (SELECT 'index_version' AS rule UNION ALL
SELECT CASE WHEN n % 5 = 0 THEN 'missing_digest' WHEN n % 5 = 1 THEN 'wrong_digest' WHEN n % 5 = 2 THEN 'unexpected_digest' END
FROM (SELECT DISTINCT s_suppkey AS n FROM supplier)) WHERE rule IS NOT NULL GROUP BY rule""")
def check_meta(t):
    """A header of another version, without some sources' digests, with wrong and surplus ones."""
    n = F.col("s_suppkey") % 5
    now = t.supplier.select(F.col("s_suppkey").cast("string").alias("source_id"), F.sha2("s_name", 256).alias("digest"), n.alias("n"))
    written = now.filter("n <> 0").select("source_id", F.when(F.col("n") == 1, F.lit("x")).otherwise(F.col("digest")).alias("digest"))
    pairs = F.map_from_entries(F.collect_list(F.struct("source_id", "digest")))
    meta = written.agg(pairs.alias("source_digests")).select(F.lit(3).alias("version"), "source_digests")
    return _counts(verify.check_meta(meta, now.filter("n <> 2").select("source_id", "digest")))


@query(f"""WITH RECURSIVE {SQL_CHUNKED}, c AS (SELECT source_id, count(*) AS chunks FROM chunks_ GROUP BY 1)
SELECT source AS source_id, count(*) AS pages, count(*) FILTER (doc_id % 3 = 0) AS native, count(*) FILTER (doc_id % 3 = 1) AS ocr,
count(*) FILTER (doc_id % 3 = 2) AS structured, 0 AS empty_visual, any_value(chunks) AS chunks FROM documents JOIN c ON source = source_id GROUP BY source""")
def extraction_report(t):
    pages = world.document_pages(t)
    methods = F.array(F.lit("pdf-text"), F.lit("ocr"), F.lit("structured"))
    marked = pages.withColumn("method", F.get(methods, (F.col("doc_id") % 3).cast("int")))
    return corpus.extraction_report(marked, corpus.chunk_pages(pages), world.document_sources(t))


_LANES = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::HUGEINT) AS s{i}" for i in range(4))


@query(f"""SELECT n AS rows, sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS digest FROM (SELECT count(*) AS n, {_LANES} FROM
(SELECT sha256(json_object('doc_id', doc_id, 'lang', lang, 'source', source, 'text', text)) AS h FROM documents))""")
def corpus_digest(t):
    rows = t.documents.select(F.struct("text", "source", "lang", "doc_id").alias("r"))
    return corpus.corpus_digest(rows, F.sha2(text.stable_json(F.col("r"), rows.schema["r"].dataType), 256))


@query("""SELECT c_custkey::VARCHAR AS source_id, '姓名：' || c_name || chr(10) || '方向：' || c_mktsegment || chr(10) || '简介：' || c_mktsegment || ' buyer' || chr(10)
|| '教育：' || 'school ' || c_nationkey || '，program，2020' || chr(10) || '能力：' || 'A（x、' || c_nationkey || '）；B（y）' AS text FROM customer""")
def profile_text(t):
    capability = lambda title, *items: F.struct(F.lit(title).alias("title"), F.array(*items).alias("items"))
    nation = F.col("c_nationkey").cast("string")
    profiles = t.customer.select(
        F.col("c_custkey").cast("string").alias("source_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("discipline"), F.concat("c_mktsegment", F.lit(" buyer")).alias("introduction"),
        F.concat(F.lit("school "), nation).alias("school"), F.lit("program").alias("program"), F.lit("2020").alias("period"),
        F.array(capability("A", F.lit("x"), nation), capability("B", F.lit("y"))).alias("capabilities"))
    return corpus.profile_text(profiles).select("source_id", "text")


def _assets(t):
    pages = world.document_pages(t).select(F.col("source_id").alias("project_id"), "page")
    digests = world.document_sources(t).select("project_id", F.sha2("source_id", 256).alias("digest"))
    return corpus.build_asset_manifest(pages, digests)


@query("""SELECT source AS project_id, substr(sha256(source), 1, 12) AS source_hash, count(*) OVER (PARTITION BY source) AS page_count, (doc_id // 20 + 1)::INT AS page,
'/projects/pages/' || source || '/' || substr(sha256(source), 1, 12) || '/' || CASE WHEN doc_id // 20 + 1 < 10 THEN '0' ELSE '' END || (doc_id // 20 + 1) || '-960.webp' AS mobile,
'/projects/pages/' || source || '/' || substr(sha256(source), 1, 12) || '/' || CASE WHEN doc_id // 20 + 1 < 10 THEN '0' ELSE '' END || (doc_id // 20 + 1) || '-1800.webp' AS desktop FROM documents""")
def build_asset_manifest(t):
    return _assets(t)


@query("""WITH d AS (SELECT source, doc_id // 20 + 1 AS page, substr(source, 4)::INT AS o FROM documents)
SELECT * FROM (SELECT 'page_sequence' AS rule, count(*) AS n FROM d WHERE page % 11 = 0
UNION ALL SELECT 'mobile_suffix', count(*) FROM d WHERE page % 7 = 0
UNION ALL SELECT 'path_escapes_root', count(*) FROM d WHERE page % 13 = 0
UNION ALL SELECT 'missing_file', count(*) FROM d WHERE page % 17 = 0 AND page % 13 <> 0
UNION ALL SELECT 'empty_file', count(*) FROM d WHERE page % 19 = 0 AND page % 17 <> 0 AND page % 13 <> 0
UNION ALL SELECT 'source_hash', count(DISTINCT source) FROM d WHERE o % 5 = 0
UNION ALL SELECT 'catalog_mismatch', count(DISTINCT source) FROM d WHERE o % 6 = 0) WHERE n > 0""")
def check_assets(t):
    """The derived manifest with damaged rows against a damaged file listing."""
    page, number = F.col("page"), F.substring(F.col("project_id"), F.lit(4), F.lit(9)).cast("int")
    manifest = _assets(t).select(
        "project_id", number.alias("project_ord"), F.concat(F.lit("/files/"), "project_id").alias("source"),
        "source_hash", "page_count", F.when(page % 11 == 0, page).otherwise(page - 1).alias("page_ord"), "page",
        F.when(page % 7 == 0, F.concat("mobile", F.lit("x"))).otherwise(F.col("mobile")).alias("mobile"),
        F.when(page % 13 == 0, F.concat(F.lit("/../"), "desktop")).otherwise(F.col("desktop")).alias("desktop"))
    files = manifest.select(F.col("mobile").alias("path"), F.lit(10).alias("length")).unionByName(
        manifest.filter(page % 17 != 0).select(
            F.col("desktop").alias("path"), F.when(page % 19 == 0, 0).otherwise(10).alias("length"))).unionByName(
        manifest.select(F.col("source").alias("path"), F.lit(5).alias("length")).distinct())
    digests = manifest.select(
        F.col("source").alias("path"),
        F.when(F.col("project_ord") % 5 == 0, "changed").otherwise(F.sha2("project_id", 256)).alias("digest")).distinct()
    expected = manifest.select(
        "project_id", F.when(F.col("project_ord") % 6 == 0, -1).otherwise(F.col("project_ord")).alias("project_ord"),
        "page_count").distinct()
    return _counts(corpus.check_assets(manifest, files, digests, expected))


# -------------------------------------------------------------- authored claims
def _tables(t):
    return authored.flatten_dossiers(world.dossiers(t))


def _claim_chunks(t):
    return authored.claim_chunks(_tables(t), world.project_sources(t))


@query(f"""WITH {SQL_CLAIMS} SELECT 'claims' AS name, count(*) AS n FROM claims_ UNION ALL SELECT 'evidence', count(*) FROM evidence_
UNION ALL SELECT 'page_claims', count(*) FROM page_claims_ UNION ALL SELECT 'pages', 10 * count(*) FROM projects_ UNION ALL SELECT 'projects', count(*) FROM projects_
UNION ALL SELECT 'question_claims', count(*) FROM question_claims_ UNION ALL SELECT 'questions', count(*) FROM question_claims_ UNION ALL SELECT 'sections', count(*) FROM sections_""")
def flatten_dossiers(t):
    return common.union_all([
        rows.select(F.lit(name).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        for name, rows in _tables(t).items()])


@query(f"WITH {SQL_CLAIMS} SELECT project_id, claim_id, provenance FROM claims_ WHERE public AND provenance <> 'candidate_contribution'")
def publishable_claims(t):
    return authored.publishable_claims(_tables(t)["claims"]).select("project_id", "claim_id", "provenance")


@query("""SELECT g AS project_id, 'claim' AS claim_id, string_agg(q, '|' ORDER BY o) AS questions FROM (SELECT g, min(o) AS o, arg_min(q, o) AS q FROM
(SELECT p_partkey // 40 AS g, p_partkey AS o, p_name || CASE WHEN p_partkey % 2 = 0 THEN '?' ELSE ' ' || upper(p_type) END AS q,
 regexp_replace(lower(p_name || CASE WHEN p_partkey % 2 = 0 THEN '?' ELSE ' ' || upper(p_type) END), '[^a-z0-9]', '', 'g') AS k FROM part) GROUP BY g, k) GROUP BY g""")
def question_aliases(t):
    """All questions of a group of parts prefer one claim; equal keys repeat."""
    question = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "?").otherwise(F.concat(F.lit(" "), F.upper("p_type"))))
    rows = t.part.select(
        F.floor(F.col("p_partkey") / 40).alias("project_id"), F.lit("claim").alias("claim_id"),
        F.col("p_partkey").alias("question_ord"), question.alias("question"))
    return authored.question_aliases(rows).select(
        "project_id", "claim_id", F.array_join("question_aliases", "|").alias("questions"))


@query(f"""WITH {SQL_CLAIMS} SELECT project_id, claim_id, string_agg(page, ',' ORDER BY page) AS pages, min(page) AS page,
CASE min(page) WHEN 1 THEN 'overview' WHEN 2 THEN 'system-architecture' ELSE 'detail' END AS page_role FROM evidence_ GROUP BY ALL""")
def evidence_anchor(t):
    tables = _tables(t)
    return authored.evidence_anchor(tables["evidence"], tables["pages"]).select(
        "project_id", "claim_id", F.array_join("evidence_pages", ",").alias("pages"), "page", "page_role")


@query(f"""WITH {SQL_CLAIMS} SELECT 'evidence_without_backlink' AS rule, count(*) AS n FROM evidence_ WHERE part % 13 = 0""")
def broken_backlinks(t):
    tables = _tables(t)
    return _counts(authored.broken_backlinks(tables["evidence"], tables["page_claims"]))


@query(f"""WITH {SQL_CLAIMS} SELECT project_id || ':claim:' || claim_id AS id, list_min(pages) AS page, text,
title || CASE WHEN provenance = 'owner_statement' THEN ' · Owner-confirmed' ELSE ' · p. ' || list_min(pages) END AS citation_label,
CASE WHEN provenance = 'owner_statement' THEN 'owner-confirmed' ELSE CASE list_min(pages) WHEN 1 THEN 'overview' WHEN 2 THEN 'system-architecture' ELSE 'detail' END END AS page_role,
CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END AS n_questions,
len({sql_terms("concat_ws(' ', array_to_string(topics, ' '), array_to_string(intents, ' '), array_to_string(aliases, ' '), title, text, CASE WHEN part % 3 = 0 THEN question ELSE '' END)")}) AS n_terms
FROM claims_ JOIN projects_ USING (project_id) WHERE public AND provenance <> 'candidate_contribution'""")
def claim_chunks(t):
    return _claim_chunks(t).select(
        "id", "page", "text", "citation_label", "page_role", F.size("question_aliases").alias("n_questions"),
        F.size("terms").alias("n_terms"))


@query(f"""WITH {SQL_GLOSSARY}, rows_ AS (SELECT unnest(intents) AS intent, entry * 1000000 AS ord, canonical AS alias FROM glossary_
UNION ALL SELECT unnest(intents), entry * 1000000 + 1, aliases[1] FROM glossary_ UNION ALL SELECT unnest(intents), entry * 1000000 + 2, aliases[2] FROM glossary_)
SELECT intent, min(ord) AS ord, arg_min(alias, ord) AS alias FROM rows_ GROUP BY intent, lower(alias)""")
def intent_aliases(t):
    found = authored.intent_aliases(_glossary(t))
    return found.select("intent", (F.col("ord.entry").cast("bigint") * 1_000_000 + F.col("ord.term")).alias("ord"), "alias")


@query(f"""WITH {SQL_GLOSSARY}, o AS (SELECT entry, lower(canonical) || intents[1] AS owner, lower(aliases[1]) AS a, lower(canonical) AS c FROM glossary_),
terms AS (SELECT c AS k, owner FROM o UNION SELECT a, owner FROM o)
SELECT * FROM (SELECT 'duplicate_entry' AS rule, count(*) AS n FROM (SELECT owner, a FROM o GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'conflicting_term', count(*) FROM (SELECT k FROM terms GROUP BY k HAVING count(DISTINCT owner) > 1)) WHERE n > 0""")
def check_glossary(t):
    return _counts(authored.check_glossary(_glossary(t)))


@query(f"""WITH {SQL_CLAIMS}, refs AS (SELECT project_id, claim_id FROM sections_ UNION SELECT project_id, claim_id FROM page_claims_ UNION SELECT project_id, claim_id FROM question_claims_)
SELECT * FROM (SELECT 'public_candidate' AS rule, count(*) AS n FROM claims_ WHERE public AND provenance = 'candidate_contribution'
UNION ALL SELECT 'private_reference', (SELECT count(*) FROM claims_ WHERE NOT public AND part % 2 = 0) + (SELECT count(*) FROM claims_ WHERE NOT public AND part % 3 = 0)
UNION ALL SELECT 'evidence_without_backlink', count(*) FROM evidence_ WHERE part % 13 = 0
UNION ALL SELECT 'duplicate_question', count(*) FROM (SELECT project_id, lower(question) AS q FROM claims_ WHERE part % 3 = 0 GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'orphan_claim', count(*) FROM claims_ c WHERE public AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.project_id = c.project_id AND r.claim_id = c.claim_id)
UNION ALL SELECT 'missing_overview', count(*) FROM projects_ p WHERE NOT EXISTS (SELECT 1 FROM sections_ s JOIN claims_ c USING (project_id, claim_id) WHERE s.project_id = p.project_id AND s.intent = 'overview' AND c.public)
UNION ALL SELECT 'missing_section', 11 * (SELECT count(*) FROM projects_) - (SELECT count(*) FROM (SELECT DISTINCT project_id, intent FROM sections_))
UNION ALL SELECT 'pages_out_of_order', 0) WHERE n > 0""")
def check_dossiers(t):
    return _counts(authored.check_dossiers(_tables(t), world.project_sources(t)))
