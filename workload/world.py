"""Tables the operators expect, derived from the given ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.config import INTENTS
from evidentia.functions import text
from evidentia.schemas import DOSSIER
from workload.registry import Tables

# ---------------------------------------------------------------- SQL snippets
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def sql_norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{WS}]+', ' ', 'g'))"


def sql_terms(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+(?:[''-][a-z0-9]+)*', 0))"


def sql_query(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def sql_phrase(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


STOPS = "[" + ",".join(f"'{t}'" for t in text.STOP_TERMS) + "]"
SQL_INTENTS = "[" + ",".join(f"'{i}'" for i in INTENTS) + "]"


def sql_search_terms(c: str) -> str:
    return f"list_filter({sql_terms(c)}, lambda t: NOT list_contains({STOPS}, t))"


# ------------------------------------------------------------------- documents
def document_pages(t: Tables) -> DataFrame:
    """Every document is a page; its source is the document's source."""
    return t.documents.select(
        "doc_id", F.col("source").alias("source_id"),
        (F.floor(F.col("doc_id") / 20) + 1).cast("int").alias("page"), "text")


def document_sources(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("source_id")).agg(
        F.count(F.lit(1)).cast("int").alias("page_count")).select(
        "source_id", F.lit("project-pdf").alias("kind"),
        F.concat(F.lit("Collection "), "source_id").alias("title"),
        F.array(F.concat(F.lit("Shelf "), "source_id"), F.lit("that on")).alias("aliases"),
        F.array(F.lit("on the thin"), F.concat(F.lit("tag "), "source_id")).alias("tags"),
        F.concat(F.lit("files/"), "source_id").alias("file_path"),
        F.concat(F.lit("/files/"), "source_id").alias("public_href"),
        F.col("source_id").alias("project_id"), "page_count",
        F.lit(None).cast("string").alias("structured_text"),
        F.array().cast("array<int>").alias("visual_pages"),
        F.col("source_id").alias("ordinal"))


def document_meta(t: Tables) -> DataFrame:
    """Page density from the quality labels; unlabelled pages are medium."""
    pages = document_pages(t).join(t.labels, "doc_id", "left")
    density = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium")
    return pages.select(F.col("source_id").alias("project_id"), "page", F.lit("detail").alias("role"),
                        density.alias("density"))


def document_chunks(t: Tables) -> DataFrame:
    """Whole documents in the canonical chunk layout (no windows)."""
    strings = F.array().cast("array<string>")
    return document_pages(t).join(
        document_sources(t).drop("ordinal"), "source_id").select(
        text.chunk_id(F.col("source_id"), F.col("page"), F.lit(0)).alias("id"),
        "source_id", "project_id", "page", "title", text.normalize_text(F.col("text")).alias("text"),
        "aliases", "tags", F.lit("source-excerpt").alias("knowledge_kind"), strings.alias("intents"),
        F.lit("medium").alias("information_density"), F.lit("detail").alias("page_role"),
        F.lit(None).cast("string").alias("provenance"), F.array("page").alias("evidence_pages"),
        strings.alias("question_aliases"), "public_href",
        text.page_label(F.col("title"), F.col("page")).alias("citation_label"))


def benchmark_queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


SQL_PAGES = "pages_ AS (SELECT doc_id, source AS source_id, (doc_id // 20 + 1)::INT AS page, text FROM documents)"
SQL_SOURCES = (
    "sources_ AS (SELECT source AS source_id, count(*)::INT AS page_count, 'Collection ' || source AS title,"
    " ['Shelf ' || source, 'that on'] AS aliases, ['on the thin', 'tag ' || source] AS tags"
    " FROM documents GROUP BY source)")
SQL_CHUNKS = (
    f"{SQL_PAGES}, {SQL_SOURCES}, chunks_ AS (SELECT p.source_id || ':p' || p.page || ':c0' AS chunk_id,"
    f" p.source_id, p.page, s.title, s.aliases, s.tags, {sql_norm('p.text')} AS text"
    " FROM pages_ p JOIN sources_ s USING (source_id))")


def sql_lexical(chunks: str = SQL_CHUNKS, queries: str = "SELECT item_id AS query_id, text AS query FROM benchmark") -> str:
    """CTEs from chunks_ and queries up to scored(query_id, chunk_id, source_id, ...)."""
    boosts = " + ".join(
        f"CASE WHEN list_contains(f.{field}, q.term) THEN {boost} ELSE 0 END"
        for field, boost in (("title_terms", 1.5), ("alias_terms", 1.75), ("tag_terms", 1.25), ("source_terms", 1.0)))
    return f"""{chunks},
queries_ AS ({queries}),
body AS (SELECT chunk_id, source_id, text, {sql_terms('text')} AS terms FROM chunks_),
postings AS (SELECT chunk_id, source_id, unnest(terms) AS term, greatest(1, len(terms)) AS length FROM body),
stats AS (SELECT count(*) AS n, greatest(1.0, avg(greatest(1, len(terms)))) AS average FROM body),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
fields AS (SELECT chunk_id, source_id, {sql_terms('title')} AS title_terms,
  {sql_terms("array_to_string(aliases, ' ')")} AS alias_terms, {sql_terms("array_to_string(tags, ' ')")} AS tag_terms,
  {sql_terms('source_id')} AS source_terms, {sql_phrase('title')} AS title_phrase,
  list_transform(aliases, lambda a: {sql_phrase('a')}) AS alias_phrases, {sql_phrase('source_id')} AS source_phrase
  FROM chunks_),
qt AS (SELECT query_id, {sql_search_terms('query')} AS terms, {sql_phrase('query')} AS phrase FROM queries_
  WHERE {sql_phrase('query')} <> ''),
qterms AS (SELECT query_id, unnest(terms) AS term FROM qt),
bm AS (SELECT q.query_id, p.chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2
   / (1 + 1.2 * (0.25 + 0.75 * length / average))) AS bm25
  FROM qterms q JOIN postings p USING (term) JOIN df USING (term) CROSS JOIN stats GROUP BY ALL),
fb AS (SELECT q.query_id, f.chunk_id, sum({boosts}) AS boost FROM qterms q CROSS JOIN fields f GROUP BY ALL),
pb AS (SELECT q.query_id, f.chunk_id, (CASE WHEN q.phrase = f.title_phrase THEN 6 ELSE 0 END
   + CASE WHEN list_contains(f.alias_phrases, q.phrase) THEN 6 ELSE 0 END
   + CASE WHEN q.phrase = f.source_phrase THEN 4 ELSE 0 END) AS phrase_boost,
   len(q.terms) > 0 AND len(list_filter(q.terms, lambda t: NOT list_contains(f.alias_terms, t))) = 0 AS covered
  FROM qt q CROSS JOIN fields f),
scored AS (SELECT pb.query_id, pb.chunk_id, c.source_id, coalesce(bm25, 0) AS bm25, coalesce(boost, 0) AS boost,
   phrase_boost, covered,
   coalesce(bm25, 0) + coalesce(boost, 0) + phrase_boost + CASE WHEN covered THEN 1 ELSE 0 END AS score
  FROM pb JOIN chunks_ c USING (chunk_id) LEFT JOIN bm USING (query_id, chunk_id) LEFT JOIN fb USING (query_id, chunk_id))"""


# ---------------------------------------------------------------------- claims
CLAIMS_PER_PROJECT = 40
PAGES_PER_PROJECT = 10


def _intent(position: Column) -> Column:
    return F.get(F.array(*[F.lit(i) for i in INTENTS]), position.cast("int"))


def part_claims(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    provenance = F.get(F.array(*[F.lit(p) for p in (
        "document_fact", "document_synthesis", "owner_statement", "candidate_contribution")]), (key % 4).cast("int"))
    pages = F.array_distinct(F.array(F.col("p_size") % 10 + 1, (key % 10).cast("int") + 1))
    return t.part.select(
        key.alias("part"), F.concat(F.lit("proj"), F.floor(key / CLAIMS_PER_PROJECT).cast("string")).alias("project_id"),
        (key % CLAIMS_PER_PROJECT).cast("int").alias("claim_ord"),
        F.concat(F.lit("c"), key.cast("string")).alias("claim_id"),
        F.concat(F.lit("The "), "p_name", F.lit(" of "), "p_brand", F.lit(" is "), F.lower("p_type"),
                 F.lit(" sized "), (F.col("p_size") % 5).cast("string")).alias("text"),
        provenance.alias("provenance"),
        F.when(provenance != "owner_statement", pages).otherwise(F.array().cast("array<int>")).alias("pages"),
        F.array_distinct(F.array(_intent(key % 11), _intent(F.floor(key / 11) % 11))).alias("intents"),
        F.array("p_type", "p_brand").alias("topics"), (key % 5 != 0).alias("public"),
        F.concat(F.lit("What about the "), "p_name", F.lit(" by "), "p_brand", F.lit("?")).alias("question"))


SQL_CLAIMS = f"""claims_ AS (SELECT p_partkey AS part, 'proj' || (p_partkey // 40) AS project_id,
 (p_partkey % 40)::INT AS claim_ord, 'c' || p_partkey AS claim_id,
 'The ' || p_name || ' of ' || p_brand || ' is ' || lower(p_type) || ' sized ' || (p_size % 5) AS text,
 ['document_fact','document_synthesis','owner_statement','candidate_contribution'][(p_partkey % 4)::INT + 1] AS provenance,
 CASE WHEN p_partkey % 4 = 2 THEN [] WHEN p_size % 10 = p_partkey % 10 THEN [(p_size % 10 + 1)::INT]
   ELSE [(p_size % 10 + 1)::INT, (p_partkey % 10 + 1)::INT] END AS pages,
 CASE WHEN p_partkey % 11 = (p_partkey // 11) % 11 THEN [{SQL_INTENTS}[(p_partkey % 11)::INT + 1]]
   ELSE [{SQL_INTENTS}[(p_partkey % 11)::INT + 1], {SQL_INTENTS}[((p_partkey // 11) % 11)::INT + 1]] END AS intents,
 [p_type, p_brand] AS topics, p_partkey % 5 <> 0 AS public,
 'What about the ' || p_name || ' by ' || p_brand || '?' AS question FROM part),
projects_ AS (SELECT project_id, 'Project ' || substr(project_id, 5) AS title,
 ['Line ' || substr(project_id, 5), 'works ' || substr(project_id, 5)] AS aliases FROM claims_ GROUP BY project_id),
evidence_ AS (SELECT project_id, claim_id, part, unnest(pages) AS page FROM claims_),
page_claims_ AS (SELECT project_id, claim_id, page FROM evidence_ WHERE part % 13 <> 0),
question_claims_ AS (SELECT project_id, claim_ord AS question_ord, question, intents, claim_id FROM claims_ WHERE part % 3 = 0),
sections_ AS (SELECT project_id, intents[1] AS intent, claim_id FROM claims_ WHERE part % 2 = 0)"""


def dossiers(t: Tables) -> DataFrame:
    """Nested dossiers; a project has a fixed number of claims and pages."""
    claims = part_claims(t)
    project = "project_id"
    number = F.substring(F.col(project), F.lit(5), F.lit(20))
    claim = F.struct(
        F.col("claim_ord").alias("o"), F.struct(
            F.col("claim_id").alias("id"), "text", "provenance",
            F.transform("pages", lambda p: F.struct(F.col(project).alias("sourceId"), p.alias("page"))).alias("evidence"),
            "intents", "topics", "public").alias("v"))
    question = F.when(F.col("part") % 3 == 0, F.struct(
        F.col("claim_ord").alias("o"), F.struct(
            "question", F.lit("en").alias("locale"), "intents",
            F.array("claim_id").alias("preferredClaimIds")).alias("v")))
    bases = claims.groupBy(project).agg(
        F.transform(F.array_sort(F.collect_list(claim)), lambda x: x["v"]).alias("claims"),
        F.transform(F.array_sort(F.collect_list(question)), lambda x: x["v"]).alias("commonQuestions"))
    sections = claims.filter("part % 2 = 0").groupBy(project, F.get("intents", F.lit(0)).alias("intent")).agg(
        F.array_sort(F.collect_list("claim_id")).alias("ids")).groupBy(project).agg(
        F.map_from_entries(F.collect_list(F.struct("intent", "ids"))).alias("sectionClaims"))
    linked = claims.filter("part % 13 <> 0").select(project, "claim_id", F.explode("pages").alias("page")).groupBy(
        project, "page").agg(F.array_sort(F.collect_list("claim_id")).alias("ids"))
    all_pages = claims.select(project).distinct().select(
        project, F.explode(F.sequence(F.lit(1), F.lit(PAGES_PER_PROJECT))).alias("page"))
    strings = F.array().cast("array<string>")
    page = F.struct(
        "page", F.when(F.col("page") == 1, "overview").when(F.col("page") == 2, "system-architecture")
        .otherwise("detail").alias("role"),
        F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("page") % 3).alias("informationDensity"),
        F.concat(F.lit("Page "), F.col("page").cast("string")).alias("visualSummary"),
        strings.alias("entities"), strings.alias("relationships"),
        F.coalesce("ids", strings).alias("claimIds"))
    pages = all_pages.join(linked, [project, "page"], "left").groupBy(project).agg(
        F.array_sort(F.collect_list(page)).alias("pages"))
    return bases.join(sections, project, "left").join(pages, project).select(
        F.col(project).alias("projectId"), F.concat(F.lit("Project "), number).alias("title"),
        F.array(F.concat(F.lit("Line "), number), F.concat(F.lit("works "), number)).alias("aliases"),
        F.concat(F.lit("Summary of "), F.col(project)).alias("oneLine"),
        F.lit(PAGES_PER_PROJECT).alias("pageCount"), "claims", "sectionClaims", "pages", "commonQuestions"
    ).select(*[F.col(f.name).cast(f.dataType) for f in DOSSIER.fields])


def project_sources(t: Tables) -> DataFrame:
    return part_claims(t).select("project_id").distinct().select(
        F.col("project_id").alias("source_id"), F.lit("project-pdf").alias("kind"),
        F.array(F.lit("catalog"), "project_id").alias("tags"),
        F.concat(F.lit("/files/"), "project_id").alias("public_href"),
        F.lit(PAGES_PER_PROJECT).alias("page_count"),
        F.substring(F.col("project_id"), F.lit(5), F.lit(20)).cast("int").alias("ordinal"))


# Intent wording of the routing queries.
INTENT_WORDS = {
    "overview": ["what is", "standard"], "problem": ["not specified"], "research": ["medium"],
    "solution": ["economy"], "architecture": ["large"], "interaction": ["promo"], "technology": ["urgent"],
    "form": ["small"], "value": ["low"], "comparison": ["which project"], "contribution": ["your contribution"],
}
SQL_INTENT_WORDS = "intent_words AS (SELECT * FROM (VALUES " + ",".join(
    f"('{i}','{w}')" for i, ws in INTENT_WORDS.items() for w in ws) + ") v(intent, phrase))"


def intent_words(t: Tables) -> DataFrame:
    rows = [(i, n, w) for i, ws in INTENT_WORDS.items() for n, w in enumerate(ws)]
    return t.spark.createDataFrame(rows, "intent string, ord int, alias string").coalesce(1)


def customer_queries(t: Tables) -> DataFrame:
    """One question per customer, about the part with the customer's number."""
    key = F.col("c_custkey")
    projects = t.part.select(F.floor(F.max("p_partkey") / CLAIMS_PER_PROJECT) + 1).scalar()
    n = (key % projects).cast("string")
    kind = key % 6
    words = F.lower("c_mktsegment")
    return t.customer.join(t.part, key == F.col("p_partkey")).select(
        key.alias("query_id"),
        F.when(kind == 0, F.concat(F.lit("What is Project "), n, F.lit("?")))
        .when(kind == 1, F.concat(F.lit("Show the urgent "), F.lower("p_type"), F.lit(" part of Line "), n))
        .when(kind == 2, F.concat(F.lit("Which project has the most "), words, F.lit(" "), "p_name", F.lit("?")))
        .when(kind == 3, F.concat(F.lit("WHAT ABOUT THE "), F.upper("p_name"), F.lit(" by "), "p_brand"))
        .when(kind == 4, F.concat("p_name", F.lit(" "), F.lower("p_type")))
        .otherwise(F.concat(F.lit("your contribution with "), "p_name")).alias("query"))


SQL_QUERIES = """queries_ AS (SELECT c_custkey AS query_id, CASE c_custkey % 6
 WHEN 0 THEN 'What is Project ' || (c_custkey % (SELECT max(p_partkey) // 40 + 1 FROM part)) || '?'
 WHEN 1 THEN 'Show the urgent ' || lower(p_type) || ' part of Line ' || (c_custkey % (SELECT max(p_partkey) // 40 + 1 FROM part))
 WHEN 2 THEN 'Which project has the most ' || lower(c_mktsegment) || ' ' || p_name || '?'
 WHEN 3 THEN 'WHAT ABOUT THE ' || upper(p_name) || ' by ' || p_brand
 WHEN 4 THEN p_name || ' ' || lower(p_type)
 ELSE 'your contribution with ' || p_name END AS query FROM customer JOIN part ON c_custkey = p_partkey)"""


# ---------------------------------------------------------------------- events
def event_ms(c: str = "ts") -> Column:
    """Epoch milliseconds of a zone-free timestamp, independent of the session."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")


def event_requests(t: Tables) -> DataFrame:
    return t.events.select(
        F.sha2(F.col("user_id").cast("string"), 256).alias("visitor_key"),
        event_ms().alias("now_ms"), F.format_string("r%010d", "event_id").alias("request_id"))


SQL_REQUESTS = ("requests_ AS (SELECT sha256(user_id::VARCHAR) AS visitor_key, (epoch_us(ts) // 1000) AS now_ms,"
                " printf('r%010d', event_id) AS request_id FROM events)")
