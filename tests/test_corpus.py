import random

import pytest
from pyspark.sql import functions as F

from evidentia.config import ChunkingConfig
from evidentia.operators import corpus, privacy, verify
from evidentia.sources import readers, writers


def pages(spark, texts):
    return spark.createDataFrame(
        [("s", n + 1, t) for n, t in enumerate(texts)], "source_id string, page int, text string")


def windows(spark, texts, config=ChunkingConfig()):
    rows = corpus.chunk_pages(pages(spark, texts), config).orderBy("page", "chunk_index").collect()
    return [(r["page"], r["chunk_index"], r["text"]) for r in rows]


def test_windows_overlap_and_never_mix_pages(spark):
    got = windows(spark, ["FIRST " + "甲" * 1_350, "SECOND " + "乙" * 1_350, " \n "])
    assert [(p, i) for p, i, _ in got] == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert len(got[0][2]) == 1_200 and got[0][2][-150:] == got[1][2][:150]
    assert "乙" not in got[1][2]
    got = windows(spark, ["A" * 1_199 + " " + "B" * 200])
    assert [len(t) for _, _, t in got] == [1_199, 351]


def test_windows_without_a_boundary_are_reported(spark):
    config = ChunkingConfig(4, 3)
    frame = pages(spark, ["a b c d e f g", "abcdefgh"])
    assert [r["key"] for r in corpus.unchunkable_pages(frame, config).collect()] == ["s:p1"]
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            ChunkingConfig(size, overlap)


def test_windows_are_made_without_python(spark):
    frame = spark.createDataFrame([(1, "abcd efghij klm \U0001F600\U0001F600 nopq"), (2, ""), (3, None), (4, "x")], "page int, text string")
    chunks = corpus.chunk_pages(frame, ChunkingConfig(8, 3))
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    # Only the normal form of characters it could change leaves the JVM.
    assert "split(" not in plan and plan.count("ArrowEvalPython") == 1
    got = [tuple(r) for r in chunks.orderBy("page", "chunk_index").collect()]
    whole = frame.first()["text"]
    assert all(whole[start:start + len(value)] == value for page, _, start, value in got if page == 1)
    assert got[-1] == (4, 0, 0, "x") and not [r for r in got if r[0] in (2, 3)]


def test_audit_accepts_windows_and_rejects_mutations(spark):
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefghij ") for _ in range(2_400))
    body = " ".join(body.split())
    base = windows(spark, [body])
    assert len(base) == 3

    def rules(rows):
        frame = spark.createDataFrame([("s", *r) for r in rows], "source_id string, page int, chunk_index int, text string")
        return {r["rule"] for r in verify.audit_chunks(frame).collect()}

    assert rules(base) == set()
    swap = lambda n, value: [(p, i, value if i == n else t) for p, i, t in base]
    assert "chunk_too_long" in rules(swap(1, base[1][2] + "x" * 300))
    assert "chunk_overlap" in rules(swap(1, "zz" + base[1][2][2:]))
    assert "chunk_progression" in rules(swap(1, base[1][2][:700]))
    assert "short_final_chunk" in rules(swap(2, base[2][2][:100]))
    assert "chunk_sequence" in rules([base[0], base[2]])


def test_leak_scan_matches_containment(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "a1", "长文本", "x-y", "q"]
    sentence = lambda n: " ".join(rng.choices(words, k=n))
    targets = [f"pre{sentence(30)}post" for _ in range(40)] + ["id src1:p2:c0.", "甲乙丙丁" * 30]
    values = [t[5:5 + rng.randint(3, 90)] for t in targets] + ["src1:p2:c0", "乙丙丁甲" * 5, "missing value", "a"]
    frame = spark.createDataFrame(list(enumerate(targets)), "id int, t string")
    sentinels = spark.createDataFrame([(v,) for v in values if v.strip()], "value string")
    want = {(i, v) for i, t in enumerate(targets) for v in values if v.strip() and v in t}
    hashed = {r[0]: r[1] for r in sentinels.select(F.sha2("value", 256), "value").collect()}
    got = {(r["id"], hashed[r["sentinel_sha256"]]) for r in privacy.leak_scan(frame, sentinels, "id", "t").collect()}
    assert got == want


def test_page_routing_threshold(spark):
    rows = [("n" * 40, None, False), ("n" * 39, " ocr\ttext ", False), ("n", None, True), ("n", None, False)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, native_text string, ocr_text string, visual boolean")
    got = [tuple(r)[1:] for r in corpus.route_page_text(frame).orderBy("i").collect()]
    assert got == [("n" * 40, "pdf-text", False), ("ocr text", "ocr", False), ("n", "pdf-text", False), (None, "ocr", True)]


def test_fingerprint_ignores_partitioning_and_sees_changes(spark):
    frame = spark.range(500).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    value = lambda df: corpus.corpus_digest(df, F.col("h")).first()["digest"]
    assert value(frame.coalesce(1)) == value(frame.repartition(7))
    assert value(frame) != value(frame.filter("id <> 3")) != value(frame.unionByName(frame.filter("id = 3")))


def test_index_publication_replaces_or_keeps(spark, tmp_path):
    path = str(tmp_path / "index")
    assert writers.write_index(spark.range(5), path, ["id"]) == 1
    bound = writers.read_index(spark, path)
    assert writers.write_index(spark.range(9), path, ["id"]) == 2
    assert writers.read_index(spark, path).count() == 9 and bound.count() == 5
    with pytest.raises(Exception):
        writers.write_index(spark.range(3).select(F.raise_error(F.lit("boom")).alias("id")), path, ["id"])
    assert writers.read_index(spark, path).count() == 9
    for n in (12, 15):
        writers.write_index(spark.range(n), path, ["id"])
    assert [writers.read_index(spark, path, k).count() for k in writers.Publication(spark, path).numbers()] == [12, 15]


@pytest.mark.parametrize("step", ["materialized", "stage", "point", "retire"])
def test_a_crash_at_any_step_leaves_the_old_or_the_new_index(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "index")
    writers.write_index(spark.range(5), path, ["id"])

    def crash(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(writers if step == "materialized" else writers.Publication, step, crash)
        with pytest.raises(OSError):
            writers.write_index(spark.range(9), path, ["id"])
    assert writers.read_index(spark, path).count() == (9 if step == "retire" else 5)
    writers.write_index(spark.range(7), path, ["id"])
    assert writers.read_index(spark, path).count() == 7


def test_of_two_writers_one_is_told(spark, tmp_path):
    target = writers.Publication(spark, str(tmp_path / "index"))
    first, second = (target.stage(spark.range(n), ["id"]) for n in (3, 4))
    target.point([first], 1)
    with pytest.raises(writers.PublicationConflict):
        target.point([second], 1)
    assert writers.read_index(spark, target.path).count() == 3
    with pytest.raises(FileNotFoundError):
        writers.read_index(spark, str(tmp_path / "nothing"))


def test_rebuild_equals_a_full_build_and_writes_changed_buckets_only(spark, tmp_path):
    path = str(tmp_path / "index")
    table = lambda rows: spark.createDataFrame(rows, "source_id string, n int, text string")
    before = {f"s{i}": [(f"s{i}", k, f"text {i} {k}") for k in range(3)] for i in range(200)}
    now = {**before, "s7": [("s7", 0, "new")], "s300": [("s300", 0, "added")], "s8": before["s8"] + [("s8", 9, "more")]}
    del now["s5"]
    flat = lambda sources: sorted(r for rows in sources.values() for r in rows)
    writers.write_buckets(table(flat(before)), path, ["source_id", "n"])
    status = {"s7": "changed", "s300": "added", "s8": "changed", "s5": "removed"}
    drift = spark.createDataFrame([(s, status.get(s, "same")) for s in {*before, *now}], "source_id string, status string")
    built = []

    def build(sources):
        names = {r.source_id for r in sources.collect()}
        built.append(names)
        return table([r for s in names for r in now[s]])

    assert writers.rebuild_index(drift, build, path, ["source_id", "n"]) == 2
    assert built == [{"s7", "s300", "s8"}]
    assert sorted(map(tuple, writers.read_index(spark, path).collect())) == flat(now)
    assert sorted(map(tuple, writers.read_index(spark, path, 1).collect())) == flat(before)
    target = writers.Publication(spark, path)
    assert 1 <= len(set(target.parts(2)) - set(target.parts(1))) <= 4
    same = drift.withColumn("status", F.lit("same"))
    writers.rebuild_index(same, lambda sources: table([("x", 0, "x")]).limit(0), path, ["source_id", "n"])
    assert target.parts(3) == target.parts(2)


def test_order_header_and_ranges(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = [("a", None), ("a", 1), ("a", 3), ("b", 2), ("b", 2), ("c", 9)]
    found = lambda data: spark.createDataFrame(data, "s string, n int").coalesce(1).write.mode("overwrite").parquet(path) or [
        r.key.split("#")[1] for r in verify.check_order(spark.read.parquet(path), ["s", "n"]).collect()]
    assert found(rows) == []
    assert found([rows[1], rows[0], *rows[2:]]) == ["1"]
    spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path + "2")
    assert verify.check_order(spark.read.parquet(path + "2"), ["id"]).count() == 0
    spark.range(500).withColumn("id", F.col("id") % 100).coalesce(1).write.mode("overwrite").parquet(path)
    assert verify.check_order(spark.read.parquet(path), ["id"]).count() == 4
    meta = spark.createDataFrame([(2, {"a": "1", "b": "2"})], "version int, source_digests map<string,string>")
    digests = spark.createDataFrame([("a", "1"), ("b", "2")], "source_id string, digest string")
    assert verify.check_meta(meta, digests).count() == 0
    frame = spark.range(300).withColumn("leaf", F.col("id") % 7)
    tree = lambda df: verify.digest_tree(df, F.col("leaf"), F.sha2(F.concat_ws(":", "id", "leaf"), 256))
    other = frame.withColumn("id", F.when(F.col("id") == 10, 17).when(F.col("id") == 17, 10).otherwise(F.col("id")))
    assert verify.differing_leaves(tree(frame.repartition(5)), tree(frame)).count() == 0
    assert verify.differing_leaves(tree(other), tree(frame)).count() == 0  # the same rows, in a set
    moved = frame.withColumn("id", F.when(F.col("id") == 10, -1).otherwise(F.col("id")))
    assert [r.key for r in verify.differing_leaves(tree(moved), tree(frame.filter("leaf < 6"))).collect()] in (["3", "6"], ["6", "3"])


def test_file_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"a","kind":"profile","title":"T","structuredText":"x"}\n{broken\n')
    rows = readers.read_sources(spark, str(tmp_path / "a.json")).collect()
    assert rows[0]["source_id"] == "a" and rows[0]["aliases"] == [] and rows[1]["_corrupt_record"] == "{broken"
    (tmp_path / "d.json").write_text('{"projectId":"p","pageCount":1,"claims":[],"sectionClaims":{"overview":["c"]}}')
    assert readers.read_dossiers(spark, str(tmp_path / "d.json")).first()["sectionClaims"] == {"overview": ["c"]}
    (tmp_path / "g.json").write_text('{"version":1,"entries":[{"canonical":"A","aliases":["b"],"intents":["form"]}]}')
    assert readers.read_glossary(spark, str(tmp_path / "g.json")).first()["canonical"] == "A"
    listing = readers.read_asset_listing(spark, str(tmp_path))
    assert {r["path"] for r in listing.collect()} == {"/a.json", "/d.json", "/g.json"}
    assert "content" not in listing._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
