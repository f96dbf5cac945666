"""The pipeline next to a plain model on a small corpus."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from evidentia.llm import packing, quality_rules, secret_scan
from tests.llm import naive


def _corpus():
    rng = random.Random(11)
    words = "the of and to in that is with for was".split() + [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words[:10] if rng.random() < 0.3 else words) for _ in range(n))
    items = [(k, text(30)) for k in range(4)]
    docs = [text(rng.randint(5, 200)) for _ in range(60)]
    for d in docs[:15]:
        w = d.split()
        w[len(w) // 2] = "changed"
        docs.append(" ".join(w))
    docs += [docs[0], docs[0], docs[3] + " " + items[1][1] + " end", text(40) + " *** $$$ " * 30, "a b c " * 50, None, ""]
    docs += [text(60) + " token = q9Zt7LmN2xVb4KpR8sWd " + text(20)]
    docs += [text(60) + " password: example0123456789abc " + text(20) for _ in range(4)]
    rows = [(i, t, "en", f"s{i % 5}", None if t is None else len(t)) for i, t in enumerate(docs)]
    return rows, items


def _model(rows, items, tokenizer):
    limits = {"symbols": 0.30, "stop": 0.03, "lines": 0.50}
    kept = []
    for r in rows:
        n, chars, symbols, dups, repeats, failed = naive.quality(r[1])
        if failed or symbols > limits["symbols"] * n or not 2 * n <= chars <= 14 * n:
            continue
        stops = sum(w.lower() in quality_rules.STOP_WORDS for w in naive.SPACE_WORDS.findall(r[1]))
        lines = sum(bool(naive.SPACE_WORDS.search(x)) for x in r[1].split("\n"))
        if stops + 1 >= limits["stop"] * n and dups <= limits["lines"] * lines:
            kept.append(r)
    groups = naive.components([(r[0], r[1]) for r in kept], 5, 80)
    kept = [r for r in kept if groups[r[0]][1] == r[0]]
    found = naive.windows(items)
    kept = [r for r in kept if not naive.contamination(r[1], found)[1]]
    owners, out = defaultdict(set), []
    for r in kept:
        for _, _, _, a, b in secret_scan.spans_of(r[1]):
            owners[r[1][a:b]].add(r[3])
    for r in kept:
        text = r[1]
        for _, _, _, a, b in reversed(secret_scan.spans_of(text)):
            value = text[a:b]
            if len(owners[value]) < secret_scan.COPIED_OWNERS and secret_scan.entropy(value) >= secret_scan.LIVE_BITS:
                text = text[:a] + corpus_pipeline.REDACTED + text[b:]
        out.append((r[0], text, r[2], r[3], len(text)))
    return out


def test_pipeline_equals_plain_model(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = _corpus()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = _model(rows, items, tokenizer)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
    assert sorted(tuple(r) for r in docs.collect()) == sorted(want)
    assert any(corpus_pipeline.REDACTED in r[1] for r in want) and any("example0123456789abc" in r[1] for r in want)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = [p for r in want for p in naive.pieces(tokenizer, r[0], r[1])]
    assert sorted(tuple(r)[:5] for r in packed) == sorted(pieces)


def test_stages_on_odd_and_empty_tables(spark, tmp_path, odd_documents):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_documents.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[2:4]:
        rows = stage(spark, docs, str(tmp_path)).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect()), name
    rows = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert len([r for r in rows if r.doc_id is None]) == 1 and {5, 0, 1} <= {r.doc_id for r in rows} and 6 not in {r.doc_id for r in rows}


def test_cutting_overlapping_values():
    cuts = [{"a": 5, "b": 9}, {"a": 2, "b": 6}, {"a": 2, "b": 4}, {"a": 9, "b": 10}]
    assert corpus_pipeline._cut("0123456789ab", cuts) == "01<SECRET><SECRET>ab"
    assert corpus_pipeline._cut(None, cuts) is None and corpus_pipeline._cut("x", None) == "x"


def test_near_dedup_of_repeated_and_missing_ids(spark, tmp_path):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    turned = lambda t, *at: " ".join("changed" if i in at else w for i, w in enumerate(t.split()))
    a = text(100)
    rows = [(7, text(k)) for k in range(20)]                                # one id, texts that resemble nothing
    rows += [(7, text(3)), (8, turned(text(4), 59))]                        # a repeated row, a near copy of one of them
    rows += [(None, text(50)), (None, turned(text(50), 0))]                 # near copies without ids
    rows += [(21, turned(a, 0, 1, 2, 3)), (None, a), (20, turned(a, 56, 57, 58, 59))]  # linked only through the middle one
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect())
    assert max(kept.values()) == 1
    assert {t for i, t in kept if i == 7} == {text(k) for k in range(20)}
    assert {i for i, _ in kept if i is not None} == {7, 20}
    assert sum(i is None for i, _ in kept) == 1 and (None, a) not in kept
    found = corpus_pipeline.minhash_join.near_duplicates(docs, 5, 80).collect()
    names = {(r.doc_id, r.component_id) for r in found}
    assert names == {(7, 7), (8, 7), (20, 20), (21, 20), (None, 20), (None, None)}
