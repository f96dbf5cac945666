"""Operators that work inside tasks, next to plain models."""

import random
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import (
    benchmark_decontamination, minhash_join, packing, secret_scan, suffix_dedup, toxicity, warc_index,
)
from tests.llm import naive


# Secrets

def _base(spans):
    return [(s.kind, s.start, s.end) for s in spans if s.kind in secret_scan.BASE_KINDS]


def test_secrets_equal_plain_model(sample, odd_documents):
    for df in (sample[1], odd_documents):
        rows = secret_scan.scan(df, owner=F.col("source")).collect()
        got = sorted(repr((r.doc_id, _base(r.spans))) for r in rows)
        assert got == sorted(repr((r.doc_id, naive.secrets(r.text))) for r in df.collect())
    assert secret_scan.scan(odd_documents.limit(0)).count() == 0


def test_secret_ownership_separates_examples(spark):
    example, own = "token = example0123456789abc", "token = q9Zt7LmN2xVb4KpR8sWd"
    rows = [(i, example, f"owner{i % 4}", f"repo{i}") for i in range(8)]
    rows += [(10, own, "a", "a/1"), (11, own, "a", "a/2"), (12, "token = zzzzzzzzzzzzzzzz ghp_" + "z1" * 20, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    found = {r.doc_id: r.spans for r in secret_scan.scan(docs, owner=F.col("owner"), repository=F.col("repo")).collect()}
    assert {s["class"] for i in range(8) for s in found[i]} == {"copied"}
    assert (found[0][0].n_documents, found[0][0].n_owners, found[0][0].n_repositories) == (8, 4, 8)
    assert (found[10][0]["class"], found[10][0].n_owners, found[10][0].n_repositories) == ("live", 1, 2)
    assert [(s.kind, s["class"]) for s in found[12]] == [("assign", "weak"), ("github", "weak")]


# Archives

def test_archive_round_trip(spark, tmp_path):
    htmls = ["<p>ä</p>", "", None, "same", "same", "other\r\n\r\nbody", "same", "x" * 200_000]
    urls = ["http://A.example.org/x?q=1#f", None, "", "http://b.org/ü y", "http://b.org/ü y", "no scheme", "http://b.org/\n", "http://z.org"]
    rows = [(i, urls[i], h, 0) for i, h in enumerate(htmls)] + [(4, urls[4], "same", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first int")
    root = str(tmp_path / "archive")
    captures = warc_index.write_archives(pages, root, file_bytes=300)
    assert captures.select("file").distinct().count() > 1
    index = warc_index.write_index(captures, root + "/index", block_lines=2)
    found = warc_index.lookup(warc_index.keys_of(pages), index)
    assert found.count() == len(rows)
    records = warc_index.read_records(found, root, payloads=True).collect()
    first = {}
    for i, h in enumerate(htmls):
        first.setdefault(h or "", i)
    assert sorted(r.page_id for r in records) == sorted(r[0] for r in rows)
    for r in records:
        body = htmls[r.page_id] or ""
        same = first[body] == r.page_id
        assert (r.payload_bytes, r.record_type, r.refers_to) == (
            len(body.encode()), "response" if same else "revisit", None if same else first[body])
        assert r.payload_digest == warc_index.payload_digest(body.encode())
        assert r.payload == (body if same else "")


def test_archive_small_payloads_unknown_keys_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", "tiny") for i in range(4)], "page_id long, url string, html string")
    captures = warc_index.write_archives(pages, str(tmp_path / "a"), least_bytes=100)
    kinds = [r.record_type for r in warc_index.read_records(captures, str(tmp_path / "a")).collect()]
    assert kinds == ["response"] * 4
    index = warc_index.write_index(captures, str(tmp_path / "i"))
    asked = spark.createDataFrame([("",), ("zzz",), ("org,a)/1 " + format(1, "020d"),)], "key string")
    assert [r.page_id for r in warc_index.lookup(asked, index).collect()] == [1]
    none = warc_index.write_archives(pages.limit(0), str(tmp_path / "b"))
    empty = warc_index.write_index(none, str(tmp_path / "j"))
    assert none.count() == 0 and warc_index.lookup(asked, empty).count() == 0


def test_damaged_record_is_noticed():
    raw = warc_index.record(1, "http://a.org", b"payload", None)
    with pytest.raises(ValueError):
        warc_index.parse_record(raw.replace(b"payload", b"pAyload"))


# Near duplicates

def _linked(df, size, percent, by_id):
    got = minhash_join.near_duplicates(df, size, percent).collect()
    want = naive.components(by_id, size, percent)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}, want


def test_near_duplicates_equal_plain_model(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(2, 120))]
        docs.append(base)
        for _ in range(rng.randint(0, 14)):
            w = list(rng.choice([base, docs[-1]]))
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append(w[:rng.randint(max(1, len(w) * 4 // 5), len(w))])
    rng.shuffle(docs)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    for size, percent in ((3, 85), (5, 80), (1, 70)):
        got, want = _linked(spark.createDataFrame(rows, "doc_id long, text string"), size, percent, rows)
        assert got == want


def test_near_duplicates_of_the_smallest_table_and_odd_rows(sample, odd_documents):
    got, want = _linked(sample[1], 3, 85, sample[0])
    assert got == want
    rows = {r.doc_id: r.text for r in odd_documents.collect() if r.doc_id is not None}
    got, want = _linked(odd_documents, 3, 85, list(rows.items()))
    assert got == want
    assert minhash_join.near_duplicates(odd_documents.limit(0)).count() == 0


def test_group_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "BLOCK_SHINGLES", 300)
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1:])) for k in range(30)]
    got, want = _linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, rows)
    assert got == want


# Toxicity

def test_chain_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity.fit_chain(docs, labels, ["low_quality", "toxic"], sample_rows=2500)
    used = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2500).select("doc_id")
    rest = labels.join(used, "doc_id", "left_anti").join(docs, "doc_id")
    scored = chain.score(toxicity.with_features(rest).select("doc_id", "low_quality", "toxic", "words")).toPandas()
    assert len(scored) > 1000
    # Low quality shows in repetition and symbols more than in words.
    for c, least, found in (("low_quality", 0.7, 0.7), ("toxic", 0.97, 0.85)):
        guess = scored[f"p_{c}"] >= 0.5
        right, caught = (guess == (scored[c] == 1)).mean(), guess[scored[c] == 1].mean()
        assert right > least and caught > found, (c, right, caught)


def test_chain_feeds_earlier_probabilities(spark):
    rows = [(i, f"red apple {i}" if i % 2 else f"blue stone {i}", i % 2, i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, b int")
    chain = toxicity.fit_chain(docs.select("doc_id", "text"), docs.select("doc_id", "a", "b"), ["a", "b"], features=256)
    assert [len(m.earlier) for _, m in chain.models] == [0, 1] and chain.models[1][1].earlier[0] > 0


def test_chain_without_labels_or_words(odd_documents):
    labels = odd_documents.select("doc_id", F.lit(None).cast("int").alias("toxic")).limit(3)
    chain = toxicity.fit_chain(odd_documents, labels, ["toxic"], features=64)
    scored = chain.score(toxicity.with_features(odd_documents, features=64))
    assert scored.count() == odd_documents.count() and scored.filter("p_toxic > 1e-6").count() == 0
    assert chain.score(toxicity.with_features(odd_documents.limit(0), features=64)).count() == 0


# Repeated strings

@pytest.mark.parametrize("letters,most", [(1, 40), (2, 60), (4, 80)])
def test_suffix_array_and_prefixes(letters, most):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        data = rng.integers(0, letters, int(rng.integers(1, most))).astype(np.uint8)
        raw = data.tobytes()
        order, rank = suffix_dedup.suffix_array(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        cut = len(raw) // 2
        lcp = suffix_dedup.common_prefixes(data, order, rank, np.array([0, cut]), np.array([cut, len(raw)]), 200)
        for k in range(1, len(raw)):
            a, b = raw[order[k]:], raw[order[k - 1]:]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _cut(df):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())


def _cut_plainly(texts):
    return sorted((n, removed, spans, naive.sha(kept)) for n, removed, spans, kept in naive.cut(texts))


@pytest.mark.parametrize("piece", [suffix_dedup.PIECE_SEGMENTS, 2])
def test_repeats_equal_plain_model(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE_SEGMENTS", piece)
    rng = random.Random(piece)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (199, 200, 230, 700)]
    texts = [text(rng.randint(0, 300)) + rng.choice(passages) + text(rng.randint(0, 300)) + rng.choice(passages) for _ in range(40)]
    texts += [None, "", "a" * 199, "b" * 201, "b" * 500, texts[0], texts[1] + "z", "\x00" * 450]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert _cut(df) == _cut_plainly(texts)


def test_repeats_of_odd_rows(odd_documents):
    texts = [r.text for r in odd_documents.collect()]
    assert _cut(odd_documents) == _cut_plainly(texts)
    assert suffix_dedup.remove_repeats(odd_documents.limit(0)).count() == 0


# Packing

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_word_encoder_equals_tokenizer(tokenizer, sample, odd_documents):
    encoder = packing.WordEncoder(tokenizer, cached=500)
    rng = random.Random(1)
    odd = ["İstanbul's ΣΑΣ ß<|endoftext|>x é.́ a b c\x1fd \x85e", "don't WE'LL x.'s", "1234 5a6 ½ ²", "a≠b", "ﬁ Ǆ ŉ ſ K"]
    alphabet = string.printable + "éßİıΣςσ̸́ 中文🙂½"
    odd += ["".join(rng.choice(alphabet) for _ in range(80)) for _ in range(300)]
    texts = odd + [t or "" for _, t in sample[0]] + [r.text or "" for r in odd_documents.collect()]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing_is_gapless_complete_and_tight(tokenizer, sample, odd_documents):
    for df in (sample[1], odd_documents):
        rows = packing.pack_documents(df, packing.default_tokenizer()).collect()
        want = [p for r in df.collect() for p in naive.pieces(tokenizer, r.doc_id, r.text)]
        assert sorted(map(repr, [tuple(r)[:5] for r in rows])) == sorted(map(repr, want))
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= 2048
        total = sum(p[3] for p in want)
        assert len(bins) <= -(-total // 2048) + max(1, len(bins) // 50)


def test_plan_against_exhaustive_search():
    rng = random.Random(2)
    for _ in range(100):
        counts = {rng.randint(1, 20): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 30)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        chosen = packing.fullest(counts, room)
        assert sum(n * k for n, k in chosen) == max(sums) and all(k <= counts[n] for n, k in chosen)
        used = defaultdict(int)
        for combination, times in packing.plan(counts, 30):
            assert sum(n * k for n, k in combination) <= 30
            for n, k in combination:
                used[n] += k * times
        assert dict(used) == counts


def test_packing_of_nothing(odd_documents):
    assert packing.pack_documents(odd_documents.limit(0), packing.default_tokenizer()).count() == 0


# Decontamination

def _hits(docs, items, spark):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return benchmark_decontamination.find_contamination(docs, bench).collect()


def test_windows_equal_plain_model(spark, sample, odd_documents):
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    bench += [(900, None), (901, "..."), (902, "the cat"), (903, "the cat"), (904, "Licence 2")]
    found = naive.windows(bench)
    for df in (sample[1], odd_documents):
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in _hits(df, bench, spark)]
        want = [(r.doc_id, *naive.contamination(r.text, found)) for r in df.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_small_segments_blocks_and_proximity(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh")
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 4)))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = benchmark_decontamination.build_index(frame, segment_tokens=50, gap=30)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = benchmark_decontamination.search(index, bench, window=3, block_windows=5).collect()
    found = naive.windows(items, 3)
    want = sorted((i, *naive.contamination(t, found)) for i, t in docs)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == want
    near = spark.createDataFrame([(1, "zeta alpha omega filler beta"), (2, "zeta " + "filler " * 40 + "omega alpha")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha omega zeta")], "item_id long, text string")
    rows = {r.doc_id: (r.n_hit, r.n_near) for r in benchmark_decontamination.search(
        benchmark_decontamination.build_index(near), asked, window=3, slop=5).collect()}
    assert rows[1][0] == 0 and rows[1][1] > 0 and rows[2] == (0, 0)


def test_empty_benchmark_and_corpus(spark, odd_documents):
    rows = _hits(odd_documents, [], spark)
    assert len(rows) == odd_documents.count() and not any(r.n_hit for r in rows)
    assert _hits(odd_documents.limit(0), [(1, "a b")], spark) == []


def test_stored_index_is_written_in_groups_of_few_segments(spark, monkeypatch):
    import pyarrow.parquet as pq

    build, index = benchmark_decontamination.build_index, []
    monkeypatch.setattr(benchmark_decontamination, "build_index", lambda docs: build(docs, segment_tokens=1))
    monkeypatch.setattr(benchmark_decontamination, "search", lambda df, *a, **k: index.append(df))
    docs = spark.createDataFrame([(i, f"a{i} b") for i in range(40)], "doc_id long, text string").coalesce(1)
    benchmark_decontamination.find_contamination(docs, None)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index[0].inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == 40 and max(groups) <= benchmark_decontamination.GROUP_SEGMENTS


def test_windows_in_turns_of_few_postings(monkeypatch):
    """A worker keeps an item by its words, not by its windows; turns do not change the matches."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdef") for _ in range(200)) for _ in range(8)]
    segment = benchmark_decontamination._Segment(64)
    for i, t in enumerate(texts):
        segment.add(i, t.encode().split())
    row = segment.row()
    windows = benchmark_decontamination.Windows([*enumerate(texts * 2), (99, "a b c"), (100, "")], 5)
    assert sum(getattr(v, "nbytes", 0) for v in vars(windows).values()) < 13 * len(windows.owner)
    once = benchmark_decontamination.match_windows(windows, row["terms"], row["list_starts"], row["postings"])
    monkeypatch.setattr(benchmark_decontamination, "CANDIDATES", 50)
    turns = benchmark_decontamination.match_windows(windows, row["terms"], row["list_starts"], row["postings"])
    assert len(once[0]) > len(texts) * 196 * 2 and all((a == b).all() for a, b in zip(once, turns))


def test_words_with_special_tokens_keep_their_case():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["<|ENDOFTEXT|>", "A <|EndOfText|> b", "Ab,C<|EndOfText|>D.E", "x<|endoftext|>Y <|StartOfText|>, Z", "a<| B |>"]
    for t in texts:
        got = np.frombuffer(packing.WordEncoder(tokenizer).encode(t), "<u4").tolist()
        assert got == tokenizer.encode(t, add_special_tokens=False).ids, t
