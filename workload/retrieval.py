"""Lexical search, routing, structured ranking, evaluation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import evaluate as evaluation
from evidentia.operators import lexical, ranking, routing, sampling
from evidentia.operators.common import dealt, materialized, scratch_path
from evidentia.plans import search
from workload import world
from workload.corpus import SQL_CHUNKED, _claim_chunks, _excerpts
from workload.registry import query
from workload.world import SQL_CHUNKS, SQL_CLAIMS, SQL_INTENT_WORDS, SQL_QUERIES, sql_lexical, sql_query, sql_terms

_TOP = """, first_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY round(score, 9) DESC, chunk_id) AS sr FROM scored WHERE round(score, 9) > 0 AND round(score, 9) >= 2.5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM first_ WHERE sr <= 3)
SELECT query_id, rank, chunk_id, source_id, round(score, 6) AS score FROM ranked WHERE rank <= 8"""


def _document_index(t):
    return lexical.lexical_index(world.document_chunks(t))


def _rounded(results):
    return results.withColumn("score", F.round("score", 6))


# --------------------------------------------------------------------- lexical
@query(f"WITH {SQL_CHUNKS} SELECT field, count(*) AS n FROM (SELECT 'body' AS field, unnest({sql_terms('text')}) FROM chunks_ "
       + " ".join(f"UNION ALL SELECT '{f}', unnest({sql_terms(e)}) FROM chunks_" for f, e in (
           ("title", "title"), ("alias", "array_to_string(aliases, ' ')"), ("tag", "array_to_string(tags, ' ')"), ("source", "source_id")))
       + ") GROUP BY field")
def field_terms(t):
    entries = lexical.chunk_entries(_document_index(t)).filter(~F.col("key").startswith(lexical.PHRASE_MARK))
    return entries.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_CHUNKS} SELECT term, count(*) AS df FROM (SELECT unnest({sql_terms('text')}) AS term FROM chunks_) GROUP BY term")
def document_frequency(t):
    terms = lexical.described(world.document_chunks(t)).select(lexical.each_term().alias("key"))
    return lexical.document_frequency(terms).withColumnRenamed("key", "term")


@query(f"WITH {SQL_CHUNKS} SELECT count(*) AS n, greatest(1.0, avg(greatest(1, len({sql_terms('text')})))) AS average FROM chunks_")
def corpus_stats(t):
    return lexical.corpus_stats(lexical.chunk_stats(world.document_chunks(t)))


_PARTS = sql_lexical()


@query(f"WITH {_PARTS} SELECT query_id, chunk_id, round(bm25, 6) AS score FROM bm")
def bm25(t):
    return _rounded(lexical.bm25(lexical.query_keys(world.benchmark_queries(t)), _document_index(t)))


@query(f"WITH {_PARTS} SELECT query_id, chunk_id, boost::DOUBLE AS boost FROM fb WHERE boost > 0")
def field_boosts(t):
    index = _document_index(t)
    boosts = lexical.of_chunks(lexical.field_boosts(lexical.query_keys(world.benchmark_queries(t)), index), index)
    return boosts.groupBy("query_id", "chunk_id").agg(F.sum("boost").alias("boost"))


def _title_queries(t):
    """Titles, aliases and ids of the sources as queries, in other spellings."""
    sources = world.document_sources(t)
    return sources.select(F.explode(F.array(
        F.struct(F.concat(F.lit("t"), "source_id").alias("query_id"), F.upper("title").alias("query")),
        F.struct(F.concat(F.lit("a"), "source_id").alias("query_id"),
                 F.concat(F.get("aliases", F.lit(0)), F.lit("!")).alias("query")),
        F.struct(F.concat(F.lit("s"), "source_id").alias("query_id"),
                 F.concat(F.lit("("), "source_id", F.lit(")")).alias("query")))).alias("q")).select("q.*")


_TITLE_SQL = """SELECT 't' || source_id AS query_id, upper(title) AS query FROM sources_ UNION ALL SELECT 'a' || source_id, aliases[1] || '!' FROM sources_
UNION ALL SELECT 's' || source_id, '(' || source_id || ')' FROM sources_"""


@query(f"WITH {sql_lexical(queries=_TITLE_SQL)} SELECT query_id, chunk_id, phrase_boost::DOUBLE AS boost FROM pb WHERE phrase_boost > 0")
def phrase_boosts(t):
    index = _document_index(t)
    return lexical.of_chunks(lexical.phrase_boosts(lexical.query_keys(_title_queries(t)), index), index).select(
        "query_id", "chunk_id", "boost")


@query(f"WITH {sql_lexical(queries=_TITLE_SQL)} SELECT query_id, chunk_id FROM pb WHERE covered")
def alias_coverage(t):
    index = _document_index(t)
    return lexical.of_chunks(lexical.alias_coverage(lexical.query_keys(_title_queries(t)), index), index).select(
        "query_id", "chunk_id")


@query(f"WITH {sql_lexical(queries=_TITLE_SQL)}{_TOP}")
def title_search(t):
    return _rounded(lexical.lexical_search(_title_queries(t), _document_index(t)))


@query(f"WITH {_PARTS}{_TOP}")
def lexical_search(t):
    return _rounded(lexical.lexical_search(world.benchmark_queries(t), _document_index(t)))


@query(f"WITH RECURSIVE {sql_lexical(SQL_CHUNKED)}{_TOP}")
def chunked_search(t):
    """The flagship query: window the documents, index them, answer every query."""
    index = lexical.lexical_index(_excerpts(t))
    return _rounded(lexical.lexical_search(world.benchmark_queries(t), index))


@query(f"WITH {_PARTS}{_TOP}")
def stored_search(t):
    """Search of an index that was written with posting blocks and read again."""
    path = scratch_path(t.spark, "stored-index")
    _document_index(t).write(path)
    return _rounded(lexical.lexical_search(world.benchmark_queries(t), lexical.LexicalIndex.read(t.spark, path)))


@query(f"WITH {_PARTS} SELECT count(*) AS hits, count(DISTINCT struct_pack(a := query_id, b := chunk_id)) <= count(*) AS bounded FROM qterms JOIN postings USING (term)")
def search_work(t):
    """Scored rows against body hits read and first ids of boosted rows."""
    index, keys = _document_index(t), lexical.query_keys(world.benchmark_queries(t))
    hits = lexical.body_hits(materialized(lexical.weighted_keys(keys, index), "weighted"), index).agg(F.count(F.lit(1)).alias("hits"))
    rows = lexical.row_boosts(keys, index).agg(F.count(F.lit(1)).alias("rows"))
    scored = lexical.lexical_scores(keys, index).agg(F.count(F.lit(1)).alias("scored"))
    most = hits.select("hits").scalar() + 3 * rows.select("rows").scalar()
    return scored.select(hits.select("hits").scalar().alias("hits"), (F.col("scored") <= most).alias("bounded"))


@query("SELECT l_orderkey AS query_id, l_linenumber AS chunk_id, l_extendedprice AS score FROM lineitem WHERE round(l_extendedprice, 9) >= 50000")
def score_threshold(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("chunk_id"),
                             F.col("l_extendedprice").alias("score"))
    return lexical.above_minimum(rows, 50_000.0)


_LINES = """lines_ AS (SELECT l_suppkey AS query_id, l_returnflag || l_linestatus AS source_id, printf('%d-%d-%d', l_orderkey, l_partkey, l_linenumber) AS chunk_id, max(l_quantity) AS score FROM lineitem GROUP BY ALL)"""


def _line_scores(t):
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("query_id"), F.concat("l_returnflag", "l_linestatus").alias("source_id"),
        F.format_string("%d-%d-%d", "l_orderkey", "l_partkey", "l_linenumber").alias("chunk_id"), "l_quantity")
    return dealt(rows, "query_id", "source_id", "chunk_id").groupBy("query_id", "source_id", "chunk_id").agg(
        F.max("l_quantity").alias("score"))


_LINE_TOP = f"""WITH {_LINES}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, chunk_id) AS sr FROM lines_),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM a WHERE sr <= 3)"""


@query(f"{_LINE_TOP} SELECT query_id, source_id, chunk_id, score, rank FROM b WHERE rank <= 8")
def topk_capped(t):
    return lexical.topk_capped(_line_scores(t))


# --------------------------------------------------------------------- routing
def _claims(t):
    return materialized(_claim_chunks(t), "claims")


def _routing(t):
    return routing.routing_index(_claims(t), world.intent_words(t), F.struct("ordinal", "chunk_index")).materialized()


_PUBLISHED = f"""{SQL_CLAIMS}, published AS (SELECT *, substr(project_id, 5)::INT AS ordinal FROM claims_ JOIN projects_ USING (project_id) WHERE public AND provenance <> 'candidate_contribution'),
catalog AS (SELECT DISTINCT project_id, unnest([lower(title), lower(aliases[1]), aliases[2], project_id]) AS phrase FROM published)"""
_MATCHES = f"""{_PUBLISHED}, {SQL_INTENT_WORDS}, {SQL_QUERIES}, norm_ AS (SELECT query_id, query, {sql_query('query')} AS q FROM queries_),
named AS (SELECT DISTINCT query_id, project_id FROM norm_ JOIN catalog ON contains(' ' || q || ' ', ' ' || phrase || ' ')),
exact_ AS (SELECT DISTINCT query_id, project_id, intents FROM norm_ JOIN published ON part % 3 = 0 AND q = {sql_query('question')}),
hits_ AS (SELECT DISTINCT query_id, intent, phrase FROM norm_ JOIN intent_words w ON contains(' ' || q || ' ', ' ' || phrase || ' ') WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.phrase = w.phrase)),
intents_ AS (SELECT DISTINCT query_id, intent FROM hits_ h WHERE NOT EXISTS (SELECT 1 FROM hits_ o WHERE o.query_id = h.query_id AND o.intent <> h.intent AND length(o.phrase) > length(h.phrase) AND contains(o.phrase, h.phrase))),
r1 AS (SELECT query_id, q, (SELECT list(DISTINCT project_id) FROM (SELECT query_id, project_id FROM named UNION SELECT query_id, project_id FROM exact_) x WHERE x.query_id = n.query_id) AS p,
 (SELECT list(DISTINCT intent) FROM intents_ i WHERE i.query_id = n.query_id) AS i, (SELECT list(DISTINCT u) FROM (SELECT unnest(intents) AS u FROM exact_ e WHERE e.query_id = n.query_id)) AS x FROM norm_ n),
r2 AS (SELECT query_id, q, coalesce(p, []) AS p, CASE WHEN len(i) > 0 THEN i ELSE coalesce(x, []) END AS i FROM r1),
r3 AS (SELECT query_id, q, p, i, len(p) = 0 AND list_contains(i, 'comparison') AS everything FROM r2),
routes_ AS (SELECT query_id, q, list_sort(list_transform(p, lambda a: substr(a, 5)::INT)) AS p, everything, list_filter({world.SQL_INTENTS}, lambda a: list_contains(i, a) AND (len(p) > 0 OR everything OR a = 'contribution')) AS i FROM r3)"""


@query(f"WITH {_PUBLISHED} SELECT project_id, phrase FROM catalog")
def alias_catalog(t):
    return routing.alias_catalog(_claims(t))


@query(f"WITH {_PUBLISHED} SELECT DISTINCT {sql_query('question')} AS question, project_id, array_to_string(intents, ',') AS intents FROM published WHERE part % 3 = 0")
def question_routes(t):
    return routing.question_routes(_claims(t)).withColumn("intents", F.array_join("intents", ","))


@query(f"WITH {_MATCHES} SELECT DISTINCT query_id, phrase FROM norm_ JOIN catalog ON contains(' ' || q || ' ', ' ' || phrase || ' ')")
def match_phrases(t):
    queries = routing.normalized_queries(world.customer_queries(t))
    return routing.match_phrases(queries, routing.alias_catalog(_claims(t)))


@query(f"WITH {_MATCHES} SELECT query_id, intent FROM intents_")
def match_intents(t):
    return routing.match_intents(routing.normalized_queries(world.customer_queries(t)), _routing(t).phrases)


@query(f"WITH {_MATCHES} SELECT query_id, q AS normalized, array_to_string(p, ',') AS projects, everything AS all_projects, array_to_string(i, ',') AS intents FROM routes_")
def route_queries(t):
    routes = routing.route_queries(world.customer_queries(t), _routing(t))
    numbers = F.transform("project_ids", lambda p: F.substring(p, F.lit(5), F.lit(20)))
    return routes.select("query_id", "normalized", F.array_join(numbers, ",").alias("projects"), "all_projects",
                         F.array_join("intents", ",").alias("intents"))


def _guarded(t):
    key = F.col("c_custkey") % 3
    return t.customer.select(
        F.col("c_custkey").alias("query_id"),
        F.when(key == 0, F.concat(F.lit("When is "), "c_name", F.lit(" free?")))
        .when(key == 1, F.concat(F.lit("什么时候 "), "c_name")).otherwise(F.concat(F.lit("Show "), "c_name")).alias("query"))


_NAMES = ["customer 00000000", "customer 00000011"]


@query("SELECT c_custkey AS query_id FROM customer WHERE c_custkey % 3 < 2 AND (c_name LIKE 'Customer#00000000%' OR c_name LIKE 'Customer#00000011%')")
def blocked_queries(t):
    return routing.blocked_queries(_guarded(t), _NAMES)


# ----------------------------------------------------------- structured ranking
def _combined(t):
    """Published claims plus one excerpt chunk per project page and a profile page."""
    claims = _claims(t).drop("terms")
    excerpts = world.part_claims(t).select(
        F.concat("project_id", F.lit(":p"), (F.col("claim_ord") % 10 + 1).cast("string"), F.lit(":c"),
                 F.floor(F.col("claim_ord") / 10).cast("string")).alias("id"),
        F.col("project_id").alias("source_id"), (F.col("claim_ord") % 10 + 1).alias("page"),
        F.concat(F.lit("Project "), F.substring(F.col("project_id"), F.lit(5), F.lit(20))).alias("title"),
        F.concat("question", F.lit(" "), "text").alias("text"), "claim_ord")
    strings = F.array().cast("array<string>")
    excerpts = excerpts.select(
        "id", "source_id", F.col("source_id").alias("project_id"), "page", "title", "text",
        strings.alias("aliases"), strings.alias("tags"), text.page_label(F.col("title"), F.col("page")).alias("citation_label"),
        F.lit("/x").alias("public_href"), F.lit("source-excerpt").alias("knowledge_kind"), strings.alias("intents"),
        F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("page") % 3).alias("information_density"),
        F.when(F.col("page") == 1, "overview").otherwise("detail").alias("page_role"),
        F.lit(None).cast("string").alias("provenance"), F.array("page").alias("evidence_pages"),
        strings.alias("question_aliases"),
        F.lit(0).alias("ordinal"), F.col("claim_ord").alias("chunk_index"))
    return materialized(claims.unionByName(excerpts), "combined")


SQL_COMBINED = f"""{_MATCHES}, combined AS (SELECT project_id || ':claim:' || claim_id AS chunk_id, project_id AS source_id, ordinal AS pn, title, aliases, ['catalog', project_id] AS tags, text,
 true AS claim, provenance, intents AS ci, 'high' AS density, CASE WHEN provenance = 'owner_statement' THEN 'owner-confirmed' ELSE CASE list_min(pages) WHEN 1 THEN 'overview' WHEN 2 THEN 'system-architecture' ELSE 'detail' END END AS role,
 CASE WHEN part % 3 = 0 THEN question ELSE '' END AS question FROM published
 UNION ALL SELECT project_id || ':p' || (claim_ord % 10 + 1) || ':c' || (claim_ord // 10), project_id, substr(project_id, 5)::INT, 'Project ' || substr(project_id, 5), [], [], question || ' ' || text, false, NULL, [],
 ['low','medium','high'][(claim_ord % 10 + 1) % 3 + 1], CASE WHEN claim_ord % 10 = 0 THEN 'overview' ELSE 'detail' END, '' FROM claims_),
facts_ AS (SELECT *, {sql_terms('text')} AS body, {sql_terms('title')} AS tt, {sql_terms("array_to_string(aliases, ' ')")} AS alt, {sql_terms("array_to_string(tags, ' ')")} AS gt, {sql_terms('source_id')} AS st,
 {sql_terms('question')} AS qt, {sql_query('question')} AS qn, {sql_query('text')} AS tk FROM combined),
stats AS (SELECT count(*) AS n, greatest(1.0, avg(greatest(1, len(body)))) AS average FROM facts_),
bt AS (SELECT chunk_id, unnest(body) AS term, greatest(1, len(body)) AS length FROM facts_), df AS (SELECT term, count(*) AS df FROM bt GROUP BY term),
w_ AS (SELECT chunk_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / average)) AS w FROM bt JOIN df USING (term) CROSS JOIN stats
 UNION ALL SELECT chunk_id, unnest(tt), 1.5 FROM facts_ UNION ALL SELECT chunk_id, unnest(alt), 1.75 FROM facts_ UNION ALL SELECT chunk_id, unnest(gt), 1.25 FROM facts_
 UNION ALL SELECT chunk_id, unnest(st), 1.0 FROM facts_ UNION ALL SELECT chunk_id, unnest(qt), 3.0 FROM facts_),
terms_ AS (SELECT query_id, unnest({world.sql_search_terms('query')}) AS term FROM queries_),
lex AS (SELECT query_id, chunk_id, sum(w) AS lex FROM terms_ JOIN (SELECT chunk_id, term, sum(w) AS w FROM w_ GROUP BY ALL) USING (term) GROUP BY ALL),
pairs AS (SELECT r.query_id, f.*, r.i, (everything OR list_contains(p, pn)) AND (pn IN (SELECT ordinal FROM published) OR NOT everything) AS routed, len(p) > 0 OR everything AS explicit, coalesce(lex, 0) AS lex, lex IS NOT NULL AS has_lex,
 qn <> '' AND qn = r.q AS exact FROM routes_ r CROSS JOIN facts_ f LEFT JOIN lex USING (query_id, chunk_id)),
structured AS (SELECT query_id, chunk_id, claim, tk, CASE WHEN routed AND explicit THEN 20 ELSE 0 END + lex + CASE WHEN claim THEN 12 + 8 * len(list_intersect(i, ci)) ELSE 0 END + CASE WHEN exact THEN 12 ELSE 0 END
 + CASE density WHEN 'high' THEN 4 WHEN 'low' THEN -8 ELSE 0 END + CASE WHEN list_contains(i, 'overview') AND role = 'overview' THEN 8 ELSE 0 END
 + CASE WHEN list_contains(i, 'architecture') AND role = 'system-architecture' THEN 8 ELSE 0 END - CASE WHEN NOT list_contains(i, 'contribution') AND claim AND list_contains(ci, 'contribution') THEN 10 ELSE 0 END AS score
 FROM pairs WHERE (NOT explicit OR routed) AND (NOT list_contains(i, 'contribution') OR coalesce(provenance = 'owner_statement', false))
 AND ((routed AND explicit) OR has_lex OR (claim AND len(list_intersect(i, ci)) > 0) OR exact))"""


def _search_index(t):
    return search.search_index(_combined(t), world.intent_words(t), F.struct("ordinal", "chunk_index"))


@query(f"""WITH {SQL_COMBINED} SELECT query_id, arg_min(chunk_id, (-round(score, 6), chunk_id)) AS chunk_id, max(round(score, 5)) AS score
FROM structured WHERE score > 0 AND score >= 2.5 GROUP BY query_id""")
def structured_best(t):
    """Best structured score per query over all eligible chunks."""
    index = _search_index(t)
    queries = world.customer_queries(t)
    routes = materialized(routing.route_queries(queries, index.routing), "routes")
    return ranking.best_candidates(*ranking.stored_pairs(queries, routes, index.facts, index.lexical))


@query()
def structured_search(t):
    """Evidence packets; the multi-pass choice has no SQL form."""
    return _rounded(search.structured_search(world.customer_queries(t), _search_index(t)))


@query("SELECT lang AS query_id, k AS text_key, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id FROM (SELECT *, sha256(" + sql_query("text") + ") AS k FROM documents) GROUP BY ALL")
def dedup_claims(t):
    rows = t.documents.select(
        F.col("lang").alias("query_id"), F.sha2(text.normalize_query(F.col("text")), 256).alias("text_key"),
        F.format_string("%010d", "doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score"))
    return ranking.dedup_claims(rows).select("query_id", "text_key", F.col("chunk_id").cast("bigint").alias("doc_id"))


@query()
def select_packet(t):
    """Diverse packets over line items as candidates."""
    key = F.col("l_partkey")
    rows = t.lineitem.groupBy(
        F.col("l_suppkey").alias("query_id"), F.format_string("%d-%d", "l_orderkey", "l_linenumber").alias("chunk_id")
    ).agg(F.min(F.struct("l_returnflag", "l_linestatus", (key % 11).alias("i"), (key % 7).alias("p"), "l_quantity")).alias("v"))
    return ranking.select_packet(rows.select(
        "query_id", "chunk_id", F.concat("v.l_returnflag", "v.l_linestatus").alias("source_id"),
        world._intent(F.col("v.i")).alias("intent"), F.when(F.col("v.p") > 0, F.col("v.p")).cast("int").alias("page"),
        (F.col("v.p") == 1).alias("is_overview"), F.col("v.l_quantity").alias("score"),
        (F.col("query_id") % 2 == 0).alias("pin_overview"), (F.col("query_id") % 3 == 0).alias("comparison")))


@query(f"WITH {SQL_CLAIMS} SELECT 'candidate_published' AS rule, project_id || ':' || claim_id AS key FROM claims_ WHERE provenance = 'candidate_contribution'")
def unpublished_claims(t):
    rows = world.part_claims(t).select(F.concat("project_id", F.lit(":"), "claim_id").alias("id"), "provenance")
    return ranking.has_candidate_contribution(rows).select("rule", "key")


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id AS id, sha256(text) AS digest FROM chunks_ WHERE source_id = 'src3' AND text <> ''")
def profile_facts(t):
    chunks = world.document_chunks(t).withColumn(
        "source_id", F.when(F.col("source_id") == "src3", "profile").otherwise(F.col("source_id")))
    return ranking.profile_facts(chunks).select("id", F.sha2("text", 256).alias("digest"))


@query("""SELECT project_id IS NULL AS profile, routed, count(*) AS n, min(CASE WHEN project_id IS NULL OR NOT explicit THEN 0 WHEN routed THEN 20 ELSE -20 END)::DOUBLE AS score FROM
(SELECT CASE WHEN doc_id % 10 <> 0 THEN source END AS project_id, source IN ('src1', 'src2') AND doc_id % 10 <> 0 AND doc_id % 3 <> 0 AS routed, doc_id % 3 <> 0 AS explicit FROM documents) GROUP BY ALL""")
def project_route(t):
    rows = t.documents.select(
        F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("project_id"), F.lit(True).alias("in_catalog"),
        F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("src1"), F.lit("src2"))).otherwise(
            F.array().cast("array<string>")).alias("project_ids"), F.lit(False).alias("all_projects"))
    scored = rows.select("project_id", ranking.project_route().alias("r"))
    return scored.select(
        F.col("project_id").isNull().alias("profile"), (F.col("r.score") > 0).alias("routed"), "r.score"
    ).groupBy("profile", "routed").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))


@query(f"""{_LINE_TOP}, top_ AS (SELECT * FROM b WHERE rank <= 8), g AS (SELECT query_id, list(chunk_id) AS ids, count(DISTINCT source_id) AS sources, list(DISTINCT source_id) AS names FROM top_ GROUP BY query_id),
cases AS (SELECT s_suppkey, 'c' || s_suppkey AS case_id FROM supplier)
SELECT c.case_id, k.check, CASE k.check WHEN 'required_sources' THEN coalesce(list_contains(names, 'NO'), false) ELSE coalesce(sources, 0) >= 3 END AS ok
FROM cases c LEFT JOIN g ON g.query_id = s_suppkey CROSS JOIN (VALUES ('required_sources'), ('distinct_sources')) k("check") WHERE s_suppkey % 5 <> 0
UNION ALL SELECT c.case_id, 'expect_none', g.query_id IS NULL FROM cases c LEFT JOIN g ON g.query_id = s_suppkey WHERE s_suppkey % 5 = 0""")
def evaluate(t):
    none = F.col("s_suppkey") % 5 == 0
    strings = F.lit(None).cast("array<string>")
    cases = t.supplier.select(
        F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("case_id"), F.col("s_suppkey").alias("query_id"),
        strings.alias("required_chunk_ids"), F.array(F.lit("NO")).alias("required_source_ids"),
        strings.alias("forbidden_primary_ids"), F.lit(3).alias("minimum_sources"), none.alias("expect_none"))
    return evaluation.evaluate(lexical.topk_capped(_line_scores(t)), cases)


# -------------------------------------------------------------------- sampling
@query("""SELECT doc_id, lang, n_chars FROM documents WHERE n_chars >= 200
AND ('0x' || substr(sha256(doc_id::VARCHAR || ':7'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE <= least(1.0::DOUBLE, n_chars / 4000.0::DOUBLE)""")
def acceptance_sample(t):
    return sampling.acceptance_sample(
        t.documents.select("doc_id", "lang", "n_chars"), F.col("doc_id"), F.least(F.lit(1.0), F.col("n_chars") / 4000), 7,
        F.col("n_chars") >= 200)


@query("""WITH totals AS (SELECT o_orderpriority AS g, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT * FROM (VALUES (0, 'micro', 0.65::DOUBLE), (1, 'medium', 0.25::DOUBLE), (2, 'large', 0.08::DOUBLE), (3, 'splash', 0.02::DOUBLE)) v(i, band, share)),
e AS (SELECT g, n, i, band, floor(n * share) AS base, n * share - floor(n * share) AS rem FROM totals CROSS JOIN s),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rem DESC, i) AS rn, n - sum(base) OVER (PARTITION BY g) AS missing FROM e)
SELECT g, n, band, (base + CASE WHEN rn <= missing THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def quotas(t):
    totals = t.orders.groupBy(F.col("o_orderpriority").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.quota_table(totals)


@query()
def assign_bands(t):
    """Documents by language as regions, by label shares as edge score."""
    region = F.when(F.col("lang") == "en", "core").when(F.col("lang") == "fr", "face").otherwise("edge")
    rows = t.documents.select("doc_id", region.alias("region"), ((F.col("n_chars") % 100) / 300).alias("edge_score"))
    return sampling.assign_bands(rows, "doc_id", 11)
