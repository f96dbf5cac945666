import copy

from pyspark.sql import functions as F

from evidentia.config import INTENTS
from evidentia.operators import authored, corpus, verify
from evidentia.schemas import DOSSIER


def dossier():
    return {
        "projectId": "lamp", "title": "Lamp", "aliases": ["Desk lamp", "桌灯"], "oneLine": "A lamp", "pageCount": 2,
        "claims": [
            {"id": "c1", "text": "  It  lights. ", "provenance": "document_fact",
             "evidence": [{"sourceId": "lamp", "page": 2}, {"sourceId": "lamp", "page": 1}, {"sourceId": "lamp", "page": 2}],
             "intents": ["overview"], "topics": ["light"], "public": True},
            {"id": "c2", "text": "I built it.", "provenance": "owner_statement", "evidence": [],
             "intents": ["contribution"], "topics": [], "public": True},
            {"id": "c3", "text": "Maybe.", "provenance": "candidate_contribution", "evidence": [],
             "intents": ["contribution"], "topics": [], "public": False},
        ],
        "sectionClaims": {i: {"overview": ["c1"], "contribution": ["c2"]}.get(i, []) for i in INTENTS},
        "pages": [
            {"page": n, "role": role, "informationDensity": "high", "visualSummary": "v", "entities": [],
             "relationships": [], "claimIds": ["c1"]} for n, role in ((1, "overview"), (2, "detail"))],
        "commonQuestions": [
            {"question": "What is it?", "locale": "en", "intents": ["overview"], "preferredClaimIds": ["c1"]},
            {"question": "Why light", "locale": "en", "intents": ["overview"], "preferredClaimIds": ["c1"]}],
    }


def row(value, kind):
    if hasattr(kind, "fields"):
        return tuple(row(value[f.name], f.dataType) for f in kind.fields)
    if hasattr(kind, "elementType"):
        return [row(v, kind.elementType) for v in value]
    return value


def tables(spark, *dossiers):
    return authored.flatten_dossiers(spark.createDataFrame([row(d, DOSSIER) for d in dossiers], DOSSIER))


def manifest(spark):
    return spark.createDataFrame(
        [("lamp", "project-pdf", "Lamp", ["tag"], "/lamp.pdf", 2, 0)],
        "source_id string, kind string, title string, tags array<string>, public_href string, page_count int, ordinal int")


def test_claim_chunks(spark):
    rows = {r["id"]: r for r in authored.claim_chunks(tables(spark, dossier()), manifest(spark)).collect()}
    assert set(rows) == {"lamp:claim:c1", "lamp:claim:c2"}
    first, owner = rows["lamp:claim:c1"], rows["lamp:claim:c2"]
    assert (first["text"], first["page"], first["evidence_pages"], first["page_role"], first["citation_label"]) == (
        "It lights.", 1, [1, 2], "overview", "Lamp · p. 1")
    assert first["question_aliases"] == ["What is it?", "Why light"]
    assert first["terms"][:5] == ["light", "overview", "desk", "lamp", "桌灯"]
    assert (owner["page"], owner["evidence_pages"], owner["page_role"], owner["citation_label"]) == (
        None, [], "owner-confirmed", "Lamp · Owner-confirmed")


def test_each_mutation_breaks_its_rule(spark):
    base = dossier()
    mutations = {
        "public_candidate": lambda d: d["claims"][2].update(public=True),
        "missing_evidence": lambda d: d["claims"][0].update(evidence=[]),
        "unknown_reference": lambda d: d["sectionClaims"]["form"].append("zz"),
        "private_reference": lambda d: d["sectionClaims"]["contribution"].append("c3"),
        "intent_mismatch": lambda d: d["sectionClaims"]["form"].append("c1"),
        "evidence_without_backlink": lambda d: d["pages"][1].update(claimIds=[]),
        "backlink_without_evidence": lambda d: d["pages"][0]["claimIds"].append("c2"),
        "pages_out_of_order": lambda d: d["pages"].reverse(),
        "duplicate_claim": lambda d: d["claims"].append(copy.deepcopy(d["claims"][1])),
        "duplicate_alias": lambda d: d["aliases"].append("desk-LAMP"),
        "duplicate_question": lambda d: d["commonQuestions"].append({**d["commonQuestions"][0], "question": "what is it"}),
        "orphan_claim": lambda d: d["sectionClaims"].update(contribution=[]),
        "missing_overview": lambda d: d["sectionClaims"].update(overview=[]),
        "invalid_provenance": lambda d: d["claims"][1].update(provenance="rumour"),
        "invalid_density": lambda d: d["pages"][0].update(informationDensity="huge"),
        "invalid_locale": lambda d: d["commonQuestions"][0].update(locale="fr"),
        "invalid_evidence": lambda d: d["claims"][0]["evidence"].append({"sourceId": "lamp", "page": 9}),
        "private_contact": lambda d: d["claims"][1].update(text="call 13800138000"),
        "manifest_page_count": lambda d: d.update(pageCount=3),
        "owner_with_evidence": lambda d: d["claims"][1].update(evidence=[{"sourceId": "lamp", "page": 1}]),
        "blank_project": lambda d: d.update(oneLine=" \n"),
        "blank_alias": lambda d: d["aliases"].append(" "),
        "blank_topic": lambda d: d["claims"][0].update(topics=["x", ""]),
        "invalid_question_intents": lambda d: d["commonQuestions"][0].update(intents=["overview", "mood"]),
        "unknown_section": lambda d: d["sectionClaims"].update(mood=[]),
        "missing_section": lambda d: d["sectionClaims"].pop("form"),
    }
    dossiers, wanted = [base], {}
    sources = [("lamp", 2)]
    for n, (rule, change) in enumerate(mutations.items()):
        name = f"lamp{n}"
        changed = copy.deepcopy(base)
        changed["projectId"] = name
        for claim in changed["claims"]:
            for evidence in claim["evidence"]:
                evidence["sourceId"] = name
        change(changed)
        if rule in ("invalid_evidence", "owner_with_evidence"):
            for claim in changed["claims"]:
                for evidence in claim["evidence"]:
                    evidence["sourceId"] = name
        dossiers.append(changed)
        wanted[name] = rule
        sources.append((name, 2))
    frame = spark.createDataFrame(
        [(s, "project-pdf", p) for s, p in sources], "source_id string, kind string, page_count int")
    found = {}
    for r in authored.check_dossiers(tables(spark, *dossiers), frame).collect():
        found.setdefault(r["key"].split(":")[0].split("?")[0].split("|")[0], set()).add(r["rule"])
    assert "lamp" not in found
    assert {n: rule for n, rule in wanted.items() if rule not in found.get(n, ())} == {}


def test_glossary(spark):
    rows = [(1, 0, "Form", ["Shape", "shape "], ["form"]), (1, 1, "Value", ["SHAPE"], ["value"]),
            (1, 2, " form", ["shape"], ["form"]), (1, 3, "x", [""], [])]
    frame = spark.createDataFrame(rows, "version int, entry int, canonical string, aliases array<string>, intents array<string>")
    rules = {r["rule"] for r in authored.check_glossary(frame).collect()}
    assert rules == {"duplicate_entry", "conflicting_term", "blank_term", "invalid_intents"}
    aliases = [r["alias"] for r in authored.intent_aliases(frame).filter("intent = 'form'").orderBy("ord").collect()]
    assert aliases == ["Form", "Shape"]


def test_built_index_verifies_itself(spark):
    claims = authored.claim_chunks(tables(spark, dossier()), manifest(spark))
    sources = manifest(spark).select(
        "*", F.array(F.lit("Desk lamp")).alias("aliases"), F.col("source_id").alias("project_id"),
        F.array().cast("array<int>").alias("visual_pages"), F.lit(None).cast("string").alias("structured_text"))
    pages = spark.createDataFrame([("lamp", 1, "one"), ("lamp", 2, "two 13800138000")], "source_id string, page int, text string")
    excerpts = corpus.excerpt_chunks(pages, sources, authored.page_meta(tables(spark, dossier())))
    built = corpus.build_index(excerpts, claims)
    assert built["violations"].isEmpty()
    assert [r["id"] for r in built["quarantined"].collect()] == ["lamp:p2:c0"]
    assert verify.verify_index(built["index"], built["index"]).isEmpty()
    damaged = built["index"].withColumn("title", F.lit("x"))
    assert {(r["rule"], r["detail"]) for r in verify.verify_index(damaged, built["index"]).collect()} >= {("differs", "title")}


def test_glossary_documents_stay_apart(spark, tmp_path):
    from evidentia.sources import readers

    for name, term in (("a", "Form"), ("b", "Value")):
        (tmp_path / f"{name}.json").write_text('{"version": 1, "entries": [{"canonical": "%s", "aliases": ["%s x"], "intents": ["form"]}]}' % (term, term))
    read = readers.read_glossary(spark, str(tmp_path))
    assert read.select("entry").distinct().count() == 2
    assert authored.check_glossary(read).count() == 0
    assert authored.intent_aliases(read).select("ord").distinct().count() == 4
