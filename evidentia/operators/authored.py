"""Reviewed claims: dossier flattening, checks, glossary and claim chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.config import DENSITIES, INTENTS, PROVENANCES
from evidentia.functions import privacy, text
from evidentia.operators.common import check_unique, materialized, row_violations, union_all, violations

_STRINGS = "array<string>"


def flatten_dossiers(dossiers: DataFrame) -> dict[str, DataFrame]:
    """Nested dossiers to relational tables; every array keeps its ordinal."""
    project = F.col("projectId").alias("project_id")
    projects = dossiers.select(
        project, "title", "aliases", F.col("oneLine").alias("one_line"),
        F.col("pageCount").alias("page_count"))
    claims = dossiers.select(project, F.posexplode("claims").alias("claim_ord", "c")).select(
        "project_id", "claim_ord", F.col("c.id").alias("claim_id"), "c.text", "c.provenance",
        "c.evidence", "c.intents", "c.topics", "c.public")
    pages = dossiers.select(project, F.posexplode("pages").alias("page_ord", "p")).select(
        "project_id", "page_ord", "p.page", "p.role",
        F.col("p.informationDensity").alias("density"),
        F.col("p.visualSummary").alias("summary"), "p.entities", "p.relationships",
        F.col("p.claimIds").alias("claim_ids"))
    questions = dossiers.select(
        project, F.posexplode("commonQuestions").alias("question_ord", "q")).select(
        "project_id", "question_ord", "q.question", "q.locale", "q.intents",
        F.col("q.preferredClaimIds").alias("claim_ids"))
    sections = dossiers.select(project, F.explode("sectionClaims").alias("intent", "ids"))
    return {
        "projects": projects,
        "claims": claims.drop("evidence"),
        "evidence": claims.select(
            "project_id", "claim_id", F.posexplode("evidence").alias("evidence_ord", "e")).select(
            "project_id", "claim_id", "evidence_ord",
            F.col("e.sourceId").alias("source_id"), "e.page"),
        "sections": sections.select(
            "project_id", "intent", F.posexplode("ids").alias("section_ord", "claim_id")),
        "section_names": dossiers.select(project, F.coalesce(F.map_keys("sectionClaims"), F.array().cast(_STRINGS)).alias("names")),
        "pages": pages.drop("claim_ids"),
        "page_claims": pages.select(
            "project_id", "page", F.posexplode("claim_ids").alias("ref_ord", "claim_id")),
        "questions": questions.drop("claim_ids"),
        "question_claims": questions.select(
            "project_id", "question_ord", "question", "intents",
            F.posexplode("claim_ids").alias("ref_ord", "claim_id")),
    }


def page_meta(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["pages"].select("project_id", "page", "role", "density")


def publishable_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("public") & (F.col("provenance") != "candidate_contribution"))


def question_aliases(question_claims: DataFrame) -> DataFrame:
    """Cleaned questions per claim in order; the first of equal keys wins.

    Duplicates fall to one row per key before anything is collected.
    """
    cleaned = question_claims.select(
        "project_id", "claim_id", "question_ord",
        text.normalize_text(F.col("question")).alias("question"),
        text.unique_key(F.col("question")).alias("key")).filter("key <> ''")
    first = cleaned.groupBy("project_id", "claim_id", "key").agg(
        F.min(F.struct("question_ord", "question")).alias("q"))
    return first.groupBy("project_id", "claim_id").agg(
        F.transform(F.array_sort(F.collect_list("q")), lambda q: q["question"])
        .alias("question_aliases"))


def evidence_anchor(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct ordered evidence pages per claim and the role of the first one."""
    spans = evidence.groupBy("project_id", "claim_id").agg(
        F.array_sort(F.collect_set("page")).alias("evidence_pages"), F.min("page").alias("page"))
    roles = pages.select("project_id", "page", F.col("role").alias("page_role"))
    return spans.join(roles, ["project_id", "page"], "left")


def broken_backlinks(evidence: DataFrame, page_claims: DataFrame) -> DataFrame:
    """Evidence and page references that do not name each other."""
    keys = ["project_id", "claim_id", "page"]
    cited = evidence.select(*keys).distinct()
    linked = page_claims.select(*keys).distinct()
    key = F.concat(F.col("project_id"), F.lit(":"), F.col("claim_id"))
    return union_all([
        violations(cited.join(linked, keys, "left_anti"), "evidence_without_backlink", key, F.col("page")),
        violations(linked.join(cited, keys, "left_anti"), "backlink_without_evidence", key, F.col("page")),
    ])


def claim_chunks(tables: dict[str, DataFrame], sources: DataFrame) -> DataFrame:
    """Published claims in the canonical chunk layout, plus their order columns."""
    claims = publishable_claims(tables["claims"])
    keys = ["project_id", "claim_id"]
    manifest = sources.filter("kind = 'project-pdf'").select(
        F.col("source_id"), "tags", "public_href", F.col("ordinal"))
    projects = tables["projects"].select("project_id", "title", "aliases")
    rows = (
        claims.join(projects, "project_id")
        .join(manifest, F.col("project_id") == F.col("source_id"))
        .join(question_aliases(tables["question_claims"]), keys, "left")
        .join(evidence_anchor(tables["evidence"], tables["pages"]), keys, "left")
        .withColumn("text", text.normalize_text(F.col("text")))
        .withColumn("question_aliases", F.coalesce("question_aliases", F.array().cast(_STRINGS)))
    )
    owner = F.col("provenance") == "owner_statement"
    words = F.concat_ws(
        " ", F.array_join("topics", " "), F.array_join("intents", " "),
        F.array_join("aliases", " "), "title", "text", F.array_join("question_aliases", " "))
    return rows.select(
        text.claim_id(F.col("project_id"), F.col("claim_id")).alias("id"),
        "source_id", "project_id",
        F.when(~owner, F.col("page")).cast("int").alias("page"),
        "title", "text", text.build_terms(words).alias("terms"), "aliases", "tags",
        F.when(owner, text.owner_label(F.col("title")))
        .otherwise(text.page_label(F.col("title"), F.col("page"))).alias("citation_label"),
        "public_href", F.lit("authored-claim").alias("knowledge_kind"), "intents",
        F.lit("high").alias("information_density"),
        F.when(owner, "owner-confirmed").otherwise(F.col("page_role")).alias("page_role"),
        "provenance",
        F.when(owner, F.array().cast("array<int>")).otherwise(F.col("evidence_pages"))
        .alias("evidence_pages"),
        "question_aliases", "ordinal", F.col("claim_ord").alias("chunk_index"),
    )


def intent_aliases(glossary: DataFrame) -> DataFrame:
    """(intent, ord, alias): terms per intent, the first of equal keys wins.

    ``ord`` is (entry, term), which sorts like the glossary, so no intent is ranked
    in one task.
    """
    terms = F.concat(F.array("canonical"), "aliases")
    rows = glossary.select("entry", "intents", F.posexplode(terms).alias("term_ord", "term")).select(
        F.explode("intents").alias("intent"),
        F.struct("entry", F.col("term_ord").alias("term")).alias("ord"),
        text.js_trim(text.nfkc(F.col("term"))).alias("alias"))
    return rows.groupBy("intent", F.lower("alias").alias("key")).agg(
        F.min(F.struct("ord", "alias")).alias("first")
    ).select("intent", "first.ord", "first.alias")


def check_glossary(glossary: DataFrame) -> DataFrame:
    """Shape rules, repeated entries and terms that two owners claim."""
    terms = glossary.select(
        "entry", "canonical", "intents",
        F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("term_ord", "term"),
    ).withColumn("key", text.term_key(F.col("term")))
    owners = glossary.select(
        "entry", F.concat_ws(
            "\u0001", text.term_key(F.col("canonical")), F.array_sort(F.array_distinct("intents"))
        ).alias("owner"))
    # An entry's own aliases, bounded by the entry it came from.
    signatures = terms.filter("term_ord > 0").groupBy("entry").agg(
        F.array_join(F.array_sort(F.collect_set("key")), "\u0002").alias("alias_keys"))
    signed = owners.join(signatures, "entry", "left").withColumn(
        "signature", F.concat_ws("\u0003", "owner", F.coalesce("alias_keys", F.lit(""))))
    conflicts = terms.join(owners, "entry").groupBy("key").agg(
        F.min("owner").alias("low"), F.max("owner").alias("high"))
    valid = F.array(*[F.lit(i) for i in INTENTS])
    return union_all([
        row_violations(glossary, F.col("entry"), {
            "version": F.coalesce("version", F.lit(0)) != 1,
            "blank_canonical": text.js_trim(F.coalesce("canonical", F.lit(""))) == "",
            "invalid_intents": (F.size("intents") < 1)
            | (F.size(F.array_except("intents", valid)) > 0)
            | (F.size(F.array_distinct("intents")) != F.size("intents")),
        }),
        violations(terms.filter("key = '' AND term_ord > 0"), "blank_term", F.col("entry")),
        check_unique(signed, "signature", rule="duplicate_entry"),
        violations(conflicts.filter("low <> high"), "conflicting_term", F.col("key")),
    ])


def check_dossiers(tables: dict[str, DataFrame], sources: DataFrame | None = None,
                   allow: list[str] = []) -> DataFrame:
    """Shape, reference, backlink, uniqueness and coverage findings.

    The flattened tables are stored once, so the rules never unfold a dossier again.
    """
    t = {name: materialized(frame, f"dossier-{name}") for name, frame in tables.items()}
    claim_key = F.concat(F.col("project_id"), F.lit(":"), F.col("claim_id"))
    project = F.col("project_id")
    pages_of = t["projects"].select("project_id", "page_count")
    intents = F.array(*[F.lit(i) for i in INTENTS])
    blank = lambda c: text.js_trim(F.coalesce(c, F.lit(""))) == ""
    ids = ["project_id", "claim_id"]
    known = t["claims"].select(
        *ids, F.col("public").alias("_public"), F.col("intents").alias("_intents"))
    documented = F.col("provenance").isin("document_fact", "document_synthesis")
    with_evidence = t["evidence"].select(*ids).distinct()

    references = union_all([
        t["sections"].select(*ids, F.lit("section").alias("via"), F.array("intent").alias("intents")),
        t["page_claims"].select(*ids, F.lit("page").alias("via"), F.lit(None).cast(_STRINGS).alias("intents")),
        t["question_claims"].select(*ids, F.lit("question").alias("via"), "intents"),
    ])
    resolved = references.join(known, ids, "left")
    published = resolved.filter(F.col("_public").isNotNull() & (F.col("via") != "page"))
    placed = t["evidence"].join(pages_of, "project_id")
    counted = pages_of.join(
        t["pages"].groupBy("project_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("page") != F.col("page_ord") + 1).alias("misplaced")),
        "project_id", "left")
    alias_rows = t["projects"].select("project_id", F.explode("aliases").alias("alias")).select(
        "project_id", text.unique_key(F.col("alias")).alias("key"))
    question_rows = t["questions"].select(
        "project_id", text.unique_key(F.col("question")).alias("key"))
    public_claims = known.filter("_public")
    overview = t["sections"].filter("intent = 'overview'").join(public_claims, ids, "left_semi")
    texts = union_all([
        t["claims"].select(claim_key.alias("k"), F.col("text").alias("v")),
        t["claims"].select(claim_key.alias("k"), F.array_join("topics", "\n").alias("v")),
        t["pages"].select(
            F.concat_ws(":p", "project_id", F.col("page").cast("string")).alias("k"),
            F.concat_ws("\n", "summary", F.array_join("entities", "\n"),
                        F.array_join("relationships", "\n")).alias("v")),
        t["questions"].select(project.alias("k"), F.col("question").alias("v")),
        t["projects"].select(
            project.alias("k"),
            F.concat_ws("\n", "title", "one_line", F.array_join("aliases", "\n")).alias("v")),
    ])
    found = [
        row_violations(t["claims"], claim_key, {
            "blank_claim": blank(F.col("claim_id")) | blank(F.col("text")),
            "invalid_provenance": ~F.coalesce(F.col("provenance").isin(*PROVENANCES), F.lit(False)),
            "public_candidate": F.col("public") & (F.col("provenance") == "candidate_contribution"),
            "invalid_intents": F.size(F.array_except("intents", intents)) > 0,
            "blank_topic": F.exists("topics", blank),
        }),
        row_violations(t["projects"], project, {
            "blank_project": blank(project) | blank(F.col("title")) | blank(F.col("one_line")),
            "blank_alias": F.exists("aliases", blank),
            "invalid_page_count": ~F.coalesce(F.col("page_count") >= 1, F.lit(False)),
        }),
        violations(t["section_names"].select("project_id", F.explode(F.array_except("names", intents)).alias("name")),
                   "unknown_section", project, F.col("name")),
        violations(t["section_names"].select("project_id", F.explode(F.array_except(intents, "names")).alias("name")),
                   "missing_section", project, F.col("name")),
        row_violations(t["pages"], F.concat_ws(":p", "project_id", F.col("page").cast("string")), {
            "invalid_density": ~F.coalesce(F.col("density").isin(*DENSITIES), F.lit(False)),
            "blank_page_text": blank(F.col("role")) | blank(F.col("summary")),
        }),
        row_violations(t["questions"], F.concat_ws("?", "project_id", "question"), {
            "invalid_locale": ~F.coalesce(F.col("locale").isin("zh", "en"), F.lit(False)),
            "blank_question": blank(F.col("question")),
            "invalid_question_intents": F.size(F.array_except("intents", intents)) > 0,
        }),
        check_unique(t["claims"], *ids, rule="duplicate_claim"),
        violations(
            t["claims"].filter(documented).join(with_evidence, ids, "left_anti"),
            "missing_evidence", claim_key),
        violations(
            t["claims"].filter("provenance = 'owner_statement'").join(with_evidence, ids, "left_semi"),
            "owner_with_evidence", claim_key),
        violations(
            placed.filter("source_id <> project_id OR page < 1 OR page > page_count"),
            "invalid_evidence", claim_key, F.col("page")),
        violations(resolved.filter("_public IS NULL"), "unknown_reference", claim_key, F.col("via")),
        violations(published.filter("NOT _public"), "private_reference", claim_key, F.col("via")),
        violations(
            published.filter(F.col("_public") & ~F.arrays_overlap("intents", "_intents")),
            "intent_mismatch", claim_key, F.col("via")),
        violations(counted.filter("n IS NULL OR n <> page_count OR misplaced > 0"),
                   "pages_out_of_order", project),
        broken_backlinks(t["evidence"], t["page_claims"]),
        violations(union_all([alias_rows, question_rows]).filter("key = ''"), "blank_key", project),
        check_unique(alias_rows.filter("key <> ''"), "project_id", "key", rule="duplicate_alias"),
        check_unique(question_rows.filter("key <> ''"), "project_id", "key", rule="duplicate_question"),
        violations(public_claims.join(references, ids, "left_anti"), "orphan_claim", claim_key),
        violations(t["projects"].join(overview, "project_id", "left_anti"), "missing_overview", project),
        violations(texts.filter(privacy.has_private(text.nfkc(F.col("v")), allow)),
                   "private_contact", F.col("k")),
    ]
    if sources is not None:
        manifest = sources.filter("kind = 'project-pdf'").select(
            F.col("source_id").alias("project_id"), F.col("page_count").alias("_pages"))
        joined = t["projects"].join(manifest, "project_id", "left")
        found.append(violations(
            joined.filter("NOT (_pages <=> page_count)"), "manifest_page_count", project))
    return union_all(found)
