import random

import pytest
from pyspark.sql import functions as F

from evidentia.config import RetrievalConfig
from evidentia.operators import evaluate as ev
from evidentia.operators import lexical, ranking, routing
from evidentia.operators.common import materialized
from evidentia.plans import search
from evidentia.schemas import CHUNKS
from tests.naive import INTENTS, Corpus
from workload import retrieval  # noqa: F401  (registers its queries)
from workload.registry import QUERIES


def chunk(id, source="s1", text="body", kind="source-excerpt", project=None, **extra):
    row = dict(
        id=id, source_id=source, project_id=project, page=1, title=f"Title {source}", text=text, terms=[],
        aliases=[], tags=[], citation_label="label", public_href="#x", knowledge_kind=kind, intents=[],
        information_density="high" if kind == "authored-claim" else "medium", page_role="detail",
        provenance="document_fact" if kind == "authored-claim" else None, evidence_pages=[1],
        question_aliases=[])
    row.update(extra)
    return row


def frame(spark, rows):
    order = {f.name: n for n, f in enumerate(CHUNKS.fields)}
    data = [tuple(r[f] for f in order) + (n,) for n, r in enumerate(rows)]
    return materialized(
        spark.createDataFrame(data, CHUNKS.simpleString()[7:-1] + ",position int").coalesce(1), "chunks")


def asked(spark, queries):
    return materialized(spark.createDataFrame(
        list(enumerate(queries)), "query_id int, query string").coalesce(1), "asked")


def packets(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["source_id"], round(r["score"], 6)))
    return out


def expected(answers):
    return {n: [(a, b, round(s, 6)) for a, b, s in rows] for n, rows in enumerate(answers) if rows}


WORDS = "alpha beta gamma delta lamp seat cabin sensor signal breath mirror fruit form growth".split()


def random_corpus(seed, sources=6, size=90):
    rng = random.Random(seed)
    rows = []
    for s in range(sources):
        project = f"proj{s}"
        aliases = [f"{rng.choice(WORDS)} {rng.choice(WORDS)}", "智能灯" if s == 1 else f"Unit {s}"]
        tags = rng.sample(WORDS, 2)
        for n in range(size // sources):
            kind = rng.choice(["source-excerpt", "authored-claim", "authored-claim"])
            page = rng.randint(1, 4)
            body = " ".join(rng.choices(WORDS, k=rng.randint(2, 9)))
            extra = dict(aliases=aliases, tags=tags, page=page, evidence_pages=[page], title=f"Project {s}",
                         page_role=rng.choice(["overview", "system-architecture", "detail"]),
                         information_density=rng.choice(["low", "medium", "high"]))
            if kind == "authored-claim":
                extra.update(
                    intents=rng.sample(INTENTS, rng.randint(1, 3)), information_density="high",
                    provenance=rng.choice(["document_fact", "owner_statement"]),
                    question_aliases=[f"Why {rng.choice(WORDS)} {rng.choice(WORDS)}?"] if rng.random() < .4 else [])
                if extra["provenance"] == "owner_statement":
                    extra.update(page=None, evidence_pages=[], page_role="owner-confirmed")
                if rng.random() < .5:
                    body = f"Repeated  {rng.choice(WORDS)}!"
            rows.append(chunk(f"{project}:{n:02d}", project, body, kind, project, **extra))
    for n in range(3):
        rows.append(chunk(f"profile:{n}", "profile", " ".join(rng.choices(WORDS, k=5)), page_role="profile"))
    return rows


ALIASES = {i: [i, f"{i} please"] for i in INTENTS}
ALIASES["comparison"] = ["compare", "哪个项目"]
ALIASES["overview"] = ["是什么", "what is"]
ALIASES["contribution"] = ["contribution", "did you do"]


def random_queries(rows, seed, count):
    rng = random.Random(seed)
    names = sorted({a for r in rows for a in r["aliases"]} | {r["title"] for r in rows})
    questions = sorted({q for r in rows for q in r["question_aliases"]})
    out = ["", "??", "the of"]
    while len(out) < count:
        parts = rng.choices(WORDS, k=rng.randint(0, 3))
        if rng.random() < .6:
            parts.append(rng.choice(names))
        if rng.random() < .7:
            parts.append(rng.choice(rng.choice(list(ALIASES.values()))))
        if rng.random() < .15 and questions:
            parts = [rng.choice(questions).upper()]
        rng.shuffle(parts)
        out.append(" ".join(parts))
    return out


def intent_frame(spark):
    return materialized(spark.createDataFrame(
        [(i, n, a) for i, group in ALIASES.items() for n, a in enumerate(group)],
        "intent string, ord int, alias string").coalesce(1), "intents")


def test_lexical_matches_naive_model(spark):
    rows = random_corpus(3)
    queries = random_queries(rows, 4, 40)
    queries += [rows[0]["title"], rows[0]["aliases"][0], "proj2"]
    index = lexical.lexical_index(frame(spark, rows))
    got = packets(lexical.lexical_search(asked(spark, queries), index))
    assert got == expected([Corpus(rows).lexical(q) for q in queries])


def test_lexical_caps_ties_and_thresholds(spark):
    rows = [chunk(f"{s}{n}", s, "alpha filler", title="x") for s in "abcd" for n in range(4)]
    index = lexical.lexical_index(frame(spark, rows))
    config = RetrievalConfig(minimum_score=0.0)
    got = packets(lexical.lexical_search(asked(spark, ["alpha", " ", "nothing"]), index, config))
    assert [c for c, _, _ in got[0]] == ["a0", "a1", "a2", "b0", "b1", "b2", "c0", "c1"]
    assert set(got) == {0}
    assert lexical.lexical_search(asked(spark, ["alpha"]), index, config, limit=0).isEmpty()
    for limit in (-1, 1.5, float("inf")):
        with pytest.raises(ValueError):
            lexical.lexical_search(asked(spark, ["alpha"]), index, config, limit=limit)


def test_lexical_parts_add_up(spark):
    rows = random_corpus(5)
    index = lexical.lexical_index(frame(spark, rows))
    keys = lexical.query_keys(asked(spark, random_queries(rows, 6, 15))).persist()
    members = index.chunks.select("chunk_id", "row_id")
    of_rows = [lexical.field_boosts(keys, index), lexical.phrase_boosts(keys, index),
               lexical.alias_coverage(keys, index).withColumn("boost", F.lit(1.0))]
    parts = [lexical.bm25(keys, index).withColumnRenamed("score", "v")]
    parts += [p.join(members, "row_id").select("query_id", "chunk_id", F.col("boost").alias("v")) for p in of_rows]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    summed = {(r[0], r[1]): round(r[2], 6) for r in union.groupBy("query_id", "chunk_id").agg(F.sum("v")).collect()}
    scored = {(r[0], r[1]): round(r[2], 6) for r in lexical.lexical_scores(keys, index).select("query_id", "chunk_id", "score").collect()}
    assert scored.items() <= summed.items()
    assert {(r[0], r[1]) for r in lexical.bm25(keys, index).collect()} <= set(scored)


@pytest.mark.parametrize("seed, per, minimum", [(21, 3, 2.5), (22, 2, 0.0), (23, 12, 0.0)])
def test_bounded_search_reads_less_and_finds_the_same(spark, tmp_path, monkeypatch, seed, per, minimum):
    monkeypatch.setattr(lexical, "OPENING_BLOCKS", 4)
    rng = random.Random(seed)
    rows = random_corpus(seed, size=600)
    for r in rows:
        r["text"] += " the filler words" * 2 + "".join(f" only{rng.randint(0, 9**6)}" for _ in range(rng.randint(0, 60)))
    queries = asked(spark, random_queries(rows, seed, 30) + ["alpha beta gamma signal only1", "mirror fruit"])
    config = RetrievalConfig(max_per_source=per, minimum_score=minimum)
    index = lexical.lexical_index(frame(spark, rows))
    index.write(str(tmp_path / "index"), block=4)
    stored = lexical.LexicalIndex.read(spark, str(tmp_path / "index"))
    assert packets(lexical.lexical_search(queries, stored, config)) == packets(lexical.lexical_search(queries, index, config))
    keys = materialized(lexical.query_keys(queries), "keys")
    weighted, boosts = lexical.weighted_keys(keys, stored), lexical.row_boosts(keys, stored)
    size = F.sum(F.size("postings"))
    read = lexical.readable_blocks(weighted, boosts, stored, 8, per, minimum).agg(size).first()[0]
    everything = stored.blocks.join(weighted.filter("idf IS NOT NULL"), "key").agg(size).first()[0]
    assert read <= everything


def test_long_postings_are_not_read(spark, tmp_path):
    texts = ["alpha beta"] * 12 + ["alpha beta " + " ".join(f"w{n}x{i}" for i in range(80)) for n in range(300)]
    rows = [chunk(f"s{n % 4}:{n:03d}", f"s{n % 4}", t, title="x") for n, t in enumerate(texts)]
    index, queries = lexical.lexical_index(frame(spark, rows)), ["alpha beta", "beta"]
    index.write(str(tmp_path / "index"), block=8)
    stored, config = lexical.LexicalIndex.read(spark, str(tmp_path / "index")), RetrievalConfig(minimum_score=0.0)
    got = packets(lexical.lexical_search(asked(spark, queries), stored, config))
    assert got == expected([Corpus(rows).lexical(q, minimum=0.0) for q in queries])
    keys = materialized(lexical.query_keys(asked(spark, queries)), "keys")
    blocks = lexical.readable_blocks(lexical.weighted_keys(keys, stored), lexical.row_boosts(keys, stored), stored, 8, 3, 0.0)
    # Twelve short postings of each of three query terms, of 312.
    assert blocks.agg(F.sum(F.size("postings"))).first()[0] < 60


def test_scored_rows_are_bounded_by_hits_and_first_ids(spark):
    rows = [chunk(f"s{n % 5}:{n:03d}", f"s{n % 5}", "alpha" if n % 50 == 0 else "filler", title="beta gamma") for n in range(400)]
    index = lexical.lexical_index(frame(spark, rows))
    keys = materialized(lexical.query_keys(asked(spark, ["alpha beta", "gamma"])), "keys")
    # Eight body hits; five boosted rows for each query, three ids each.
    assert lexical.lexical_scores(keys, index, 3).count() <= 8 + 2 * 5 * 3
    got = packets(lexical.lexical_search(asked(spark, ["alpha beta", "gamma"]), index, RetrievalConfig(minimum_score=0.0)))
    assert got == expected([Corpus(rows).lexical(q, minimum=0.0) for q in ["alpha beta", "gamma"]])
    assert index.rows.count() == 5 and index.fields.filter("field = 'title'").count() == 5 * 3


def test_topk_plan_limits_groups_before_the_shuffle(spark):
    index = lexical.lexical_index(frame(spark, random_corpus(1)))
    plan = lexical.lexical_search(asked(spark, ["alpha"]), index)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stored_index_gives_the_same_results(spark, tmp_path):
    rows = random_corpus(8)
    queries = asked(spark, random_queries(rows, 9, 10))
    index = lexical.lexical_index(frame(spark, rows))
    index.write(str(tmp_path / "index"))
    stored = lexical.LexicalIndex.read(spark, str(tmp_path / "index"))
    assert packets(lexical.lexical_search(queries, stored)) == packets(lexical.lexical_search(queries, index))


@pytest.mark.parametrize("seed", [11, 12])
def test_routing_matches_naive_model(spark, seed):
    rows = random_corpus(seed)
    queries = random_queries(rows, seed, 60)
    routes = routing.route_queries(asked(spark, queries), routing.routing_index(
        frame(spark, rows), intent_frame(spark), F.col("position")).materialized())
    corpus = Corpus(rows)
    catalog = corpus.route("compare", ALIASES)[0]
    for r in routes.collect():
        projects = catalog if r["all_projects"] else r["project_ids"]
        assert (projects, r["intents"]) == corpus.route(queries[r["query_id"]], ALIASES), queries[r["query_id"]]


def test_routing_fixtures(spark):
    rows = [
        chunk("first:claim:1", "first-light", "x", "authored-claim", "first-light", title="First Light",
              aliases=["未来出行"], intents=["overview"]),
        chunk("lampseat:claim:1", "lampseat", "x", "authored-claim", "lampseat", title="LampSeat",
              aliases=["Seat", "智能座舱"], intents=["overview"], question_aliases=["它解决了什么？"]),
    ]
    queries = ["LampSeat是什么", "哪个项目最能体现系统思考？", "seat design", "system design", "contribution",
               "它解决了什么", "我想看智能座舱"]
    routes = {r["query_id"]: r for r in routing.route_queries(
        asked(spark, queries), routing.routing_index(
            frame(spark, rows), intent_frame(spark), F.col("position")).materialized()).collect()}
    assert (routes[0]["project_ids"], routes[0]["intents"]) == (["lampseat"], ["overview"])
    assert routes[1]["all_projects"] and routes[1]["intents"] == ["comparison"]
    assert (routes[2]["project_ids"], routes[2]["intents"]) == ([], [])
    assert (routes[3]["project_ids"], routes[3]["intents"]) == ([], [])
    assert (routes[4]["project_ids"], routes[4]["intents"]) == ([], ["contribution"])
    assert (routes[5]["project_ids"], routes[5]["intents"]) == (["lampseat"], ["overview"])
    assert routes[6]["project_ids"] == ["lampseat"]


@pytest.mark.parametrize("seed,limit,per", [(21, 8, 3), (22, 3, 1), (23, 5, 2)])
def test_structured_search_matches_naive_model(spark, seed, limit, per):
    rows = random_corpus(seed)
    queries = random_queries(rows, seed, 60)
    index = search.search_index(frame(spark, rows), intent_frame(spark), F.col("position"))
    config = RetrievalConfig(max_results=limit, max_per_source=per)
    got = packets(search.structured_search(asked(spark, queries), index, config=config))
    want = expected([Corpus(rows).structured(q, ALIASES, limit=limit, per=per) for q in queries])
    assert {queries[k]: v for k, v in got.items()} == {queries[k]: v for k, v in want.items()}


def test_guard_blocks_named_availability(spark):
    rows = [chunk("profile:1", "profile", "jane roe works weekends", page_role="profile")]
    chunks = frame(spark, rows)
    queries = ["When is Jane Roe free?", "Jane Roe works", "王小明什么时候有空"]
    blocked = routing.blocked_queries(asked(spark, queries), ["jane roe", "王小明"])
    assert sorted(r[0] for r in blocked.collect()) == [0, 2]
    got = packets(search.structured_search(
        asked(spark, queries), search.search_index(chunks, intent_frame(spark), F.col("position")),
        ["jane roe"], RetrievalConfig(minimum_score=0.0)))
    assert set(got) == {1}


def test_unpublished_claims_are_refused(spark):
    rows = [chunk("a", kind="authored-claim", project="p", provenance="candidate_contribution")]
    assert ranking.has_candidate_contribution(frame(spark, rows)).count() == 1
    with pytest.raises(ValueError):
        ranking.assert_publishable(frame(spark, rows))


def test_profile_facts(spark):
    rows = [chunk("p1", "profile", "fact"), chunk("p2", "profile", " 　"), chunk("o", "other", "x")]
    assert [r["text"] for r in ranking.profile_facts(frame(spark, rows)).collect()] == ["fact"]


def test_evaluation(spark):
    results = spark.createDataFrame(
        [(1, 1, "a", "s1"), (1, 2, "b", "s2"), (2, 1, "c", "s1")],
        "query_id int, rank int, chunk_id string, source_id string")
    cases = spark.createDataFrame(
        [("ok", 1, ["a"], ["s2"], ["b"], 2, False), ("bad", 2, ["a"], ["s9"], ["c"], 2, False),
         ("none", 3, None, None, None, None, True), ("some", 2, None, None, None, None, True)],
        "case_id string, query_id int, required_chunk_ids array<string>, required_source_ids array<string>, "
        "forbidden_primary_ids array<string>, minimum_sources int, expect_none boolean")
    got = {(r["case_id"], r["check"]): r["ok"] for r in ev.evaluate(results, cases).collect()}
    assert got == {
        **{("ok", c): True for c in ("required_chunks", "required_sources", "forbidden_primary", "distinct_sources")},
        **{("bad", c): False for c in ("required_chunks", "required_sources", "forbidden_primary", "distinct_sources")},
        ("none", "expect_none"): True, ("some", "expect_none"): False}
    counts = {r["check"]: (r["passed"], r["failed"]) for r in ev.pass_counts(ev.evaluate(results, cases)).collect()}
    assert counts["expect_none"] == (1, 1)


def test_structured_pairs_are_narrow_and_single(spark):
    rows = random_corpus(31)
    index = search.search_index(frame(spark, rows), intent_frame(spark), F.col("position"))
    queries = asked(spark, random_queries(rows, 32, 20))
    numbered = ranking.numbered_facts(index.facts)
    pairs = ranking.structured_pairs(queries, routing.route_queries(queries, index.routing), numbered, index.lexical)
    assert pairs.columns == ["query_id", "chunk_number", "score"] and pairs.count() > 0
    assert pairs.count() == pairs.select("query_id", "chunk_number").distinct().count()


def test_leading_sources_keep_the_shortlist(spark):
    rng = random.Random(33)
    rows = [(q, f"c{n:03d}", f"s{rng.randint(0, 9)}", rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]), rng.random() < .05,
             float(rng.randint(1, 6))) for q in range(4) for n in range(120)]
    frame_ = spark.createDataFrame(rows, "query_id int, chunk_id string, source_id string, intent string, page int, is_overview boolean, score double")
    kept = ranking.leading_sources(frame_, 3)
    assert kept.count() < len(rows)
    some = lambda f: sorted(map(tuple, ranking.shortlist(f, ["query_id"], ranking._by_score(), 3).collect()), key=repr)
    assert some(kept) == some(frame_)


@pytest.mark.parametrize("name", ["field_terms", "field_boosts", "phrase_boosts", "alias_coverage"])
def test_metadata_queries_return_every_chunk(spark, tmp_path, name):
    """Three documents of a source are three chunks with its terms and boosts."""
    documents = [(20 * n, f"text {n} on the thin tag", f"src{n % 2}") for n in range(6)]
    spark.createDataFrame(documents, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "collection src0"), (2, "thin shelf")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    if name == "field_terms":
        assert {r.field: r.n for r in rows} == {"body": 36, "title": 12, "alias": 24, "tag": 30, "source": 6}
        return
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r.chunk_id)
    of = lambda source: [f"src{source}:p{n + 1}:c0" for n in range(source, 6, 2)]
    expected = {
        "field_boosts": {1: of(0) + of(1), 2: of(0) + of(1)},
        "phrase_boosts": {f"{kind}src{s}": of(s) for s in (0, 1) for kind in "tas"},
        "alias_coverage": {f"{kind}src{s}": of(s) for s in (0, 1) for kind in "as"}}[name]
    assert {q: sorted(c) for q, c in found.items()} == {q: sorted(c) for q, c in expected.items()}


def test_terms_are_counted_without_a_second_tokenization(spark, tmp_path):
    """Spark infers a filter from a bare exploded column and pushes it, with the tokenizer, into the scan."""
    rows = [(i, f"alpha beta w{i % 3}", "s") for i in range(9)] + [(9, "", "s"), (10, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["document_frequency"](spark, str(tmp_path))
    assert "size(array_distinct" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["term"]: r["df"] for r in found.collect()} == {"alpha": 9, "beta": 9, "w0": 3, "w1": 3, "w2": 3}


def test_blocks_hold_numbers_and_copies_of_an_id_add_up(spark, tmp_path):
    rows = [chunk(f"s{n % 2}:{n % 40:03d}", f"s{n % 2}", f"alpha beta w{n % 7}" + " pad" * (n % 5), title="x") for n in range(60)]
    index, queries = lexical.lexical_index(frame(spark, rows)), asked(spark, ["alpha w3", "beta w1 w5", "pad"])
    index.write(str(tmp_path / "index"), block=8)
    stored, config = lexical.LexicalIndex.read(spark, str(tmp_path / "index")), RetrievalConfig(minimum_score=0.0)
    assert set(stored.blocks.select(F.inline("postings")).columns) == {"body_length", "number", "row_id"}
    assert stored.blocks.agg(F.max(F.size("postings"))).first()[0] <= 8
    assert stored.chunks.select("chunk_id", "number").distinct().count() == stored.chunks.select("number").distinct().count() == 40
    assert packets(lexical.lexical_search(queries, stored, config)) == packets(lexical.lexical_search(queries, index, config))


def test_hits_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    index = lexical.lexical_index(frame(spark, random_corpus(41)))
    queries = asked(spark, random_queries(random_corpus(41), 42, 10))
    want = packets(lexical.lexical_search(queries, index))
    monkeypatch.setattr(lexical, "TASK_HITS", 16)
    keys = materialized(lexical.query_keys(queries), "keys")
    weighted = lexical.weighted_keys(keys, index)
    hits = lexical.body_hits(weighted, index).count()
    assert lexical.hit_tasks(weighted) == -(-hits // 16) > 4
    assert packets(lexical.lexical_search(queries, index)) == want


def test_best_candidates_compare_only_pairs_of_the_best_score(spark, monkeypatch):
    facts = spark.createDataFrame([
        (0, "a", "t", True), (1, "b", "t", True), (2, "c", "u", False), (3, "d", "", False), (4, "e", None, False),
        (5, "f", "v", True), (6, "g", "v", True)], "chunk_number long, chunk_id string, text_key string, copied boolean")
    pairs = spark.createDataFrame([
        (1, 0, 5.0), (1, 1, 5.0000002), (1, 2, 5.0000001), (1, 3, 9.0),     # b displaces its copy a, blank texts drop
        (2, 2, 4.0), (2, 4, 4.0), (2, 0, 3.0), (3, 5, 2.5), (3, 6, 2.5), (4, 3, 7.0), (5, 6, 3.1), (5, 5, 3.2),
    ], "query_id long, chunk_number long, score double")
    compared, plain = [], ranking.distinct_candidates
    monkeypatch.setattr(ranking, "distinct_candidates", lambda rows: (compared.append(rows.count()), plain(rows))[1])
    got = sorted(map(tuple, ranking.best_candidates(pairs, facts).collect()))
    assert got == [(1, "b", 5.0), (2, "c", 4.0), (3, "f", 2.5), (5, "f", 3.2)] and compared == [8]
