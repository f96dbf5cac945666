"""Vector codes, spelling variants and language models next to plain models."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import language_id, spelling_variants, vector_codes
from tests.llm import naive

# Vector codes

VECTORS = "label int, vec_id long, embedding array<float>, code string, x int"


def _vectors(n=150, length=8):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.4) for _ in range(length)] for _ in range(9)]
    rows = [(i, rng.choice([0, 1, None]), [float(np.float32(c + rng.gauss(0, 0.02))) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(n, 1, None), (n + 1, 1, []), (n + 2, 1, [None] * length), (n + 3, 0, [float("nan")] + [0.0] * (length - 1)),
             (n + 4, 0, [float("-inf")] + [0.0] * (length - 1)), (n + 5, 0, [0.5] * (length - 1)), (None, 2, [0.25] * length),
             (5, 1, [-0.25] * length), (5, 1, [-0.25] * length), (n + 6, None, [0.0] * length)]
    return rows


@pytest.mark.parametrize("parts, entries, length", [(4, 8, 8), (4, 16, 10), (2, 300, 8)])
def test_codes_equal_full_rescans(spark, parts, entries, length):
    rows = _vectors(length=length)
    frame = spark.createDataFrame([(label, i, v, "x", 1) for i, label, v in rows], VECTORS).repartition(5)
    coded, books = vector_codes.compress(frame, parts=parts, entries=entries)
    want, plain_books = naive.vector_codes(rows, parts, entries)
    assert sorted(map(repr, [tuple(r) for r in coded.collect()])) == sorted(map(repr, want))
    assert books.tolist() == plain_books
    totals = defaultdict(int)
    for _, label, _, error in want:
        totals[label] += error
    for r in vector_codes.with_label_error(coded).collect():
        assert r.label_error == totals[r.label]


def test_active_entries_keep_ties_and_stored_distances():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, book = rng.integers(-3, 4, (40, 2)), rng.integers(-3, 4, (6, 2))
        code, distance = vector_codes.assign(x, book)
        after = book.copy()
        moved = rng.random(6) < 0.4
        after[moved] += rng.integers(-2, 3, (moved.sum(), 2))
        got = vector_codes.reassign(x, after, (after != book).any(1), code, distance)
        assert all((g == w).all() for g, w in zip(got, vector_codes.assign(x, after)))


def test_codes_of_huge_components_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, 1, [3e38, -3e38, 0.0, 1.0], "a", 1), (0, 2, [1.0, 2.0, 3.0, 4.0], "a", 1)], VECTORS)
    coded, _ = vector_codes.compress(frame, parts=2, entries=1)
    assert all(0 <= r.error < 1 << 63 for r in coded.collect())
    for empty in (frame.limit(0), frame.withColumn("embedding", F.lit(None).cast("array<float>"))):
        assert vector_codes.with_label_error(vector_codes.compress(empty)[0]).count() == 0


# Spelling variants

def _check_variants(frame, rows, **options):
    got = spelling_variants.group_variants(frame, **options).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == naive.variants(rows)
    assert len({r.word for r in got}) == len(got)


@pytest.mark.parametrize("tile", [512, 3])
def test_variants_equal_plain_model(spark, tile):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab"]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 2, 3, 30, 400])
        for _ in range(4):
            at = rng.randrange(len(w))
            words += [rng.choice([w[:at] + w[at + 1:], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1:]])] * rng.choice([1, 2, 3, 30])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40]).title() if i % 3 else "-".join(words[i::40])) for i in range(40)]
    _check_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows, tile=tile)


def test_variants_of_odd_rows(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    _check_variants(odd_documents, rows)
    assert spelling_variants.group_variants(odd_documents.limit(0)).count() == 0
    long = [(i, "x" * 40000 + "y" * (i % 2) + " ÀÉÎÕÜ×÷ÿ àÉÎÕÜ×÷ÿ") for i in range(6)]
    _check_variants(spark.createDataFrame(long, "doc_id long, text string"), long)


def test_near_words_by_prefix_and_suffix():
    rng = random.Random(6)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(2))
        m = max(len(a), len(b))
        if a != b and abs(len(a) - len(b)) < 2:
            p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            s = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
            assert naive.edit_apart(a, b) == (p + s >= m - 1)


def test_long_chains_reach_their_root(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)], "word string, form string")
    assert {r.root for r in spelling_variants.roots(forms, 11).collect()} == {"w11"}


# Language models

def _texts(spark, n=240):
    rng = random.Random(7)
    kinds = {"xx": ["lorem", "dolor", "ipsum", "sit"], "yy": ["straße", "über", "grün", "fünf"], "zz": ["москва", "река", "дом", "лес"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(kinds))
        rows.append((i, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 30))), lang, "s", 1))
    rows += [(None, "lorem", "xx", None, 1), (n, None, "yy", "s", 1), (n + 1, "12 --", "yy", "s", 1), (n + 2, "", None, "s", 1),
             (n + 3, "lorem dolor", None, "s", 1), rows[0]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, entropy int")


def test_cross_entropies_equal_plain_model(spark):
    rows, frame = _texts(spark)
    models = language_id.LanguageModels.of(language_id.fit(language_id.count_grams(frame)).toArrow())
    symbol = language_id.symbol_table()
    sequence = lambda t: naive.symbol_sequence(t, lambda c: int(symbol[ord(c)]))
    texts = ["Lorem  ipsum, fünf!", "москва", "q", " 7 lorem", "x" * 50]
    got, sizes = language_id.cross_entropies(models, texts)
    for column, lang in enumerate(models.languages):
        p = naive.kneser_ney([sequence(t or "") for _, t, code, *_ in rows if code == lang])
        for row, t in enumerate(texts):
            s = sequence(t)
            grams = [tuple(s[i - 3:i + 1]) for i in range(3, len(s))]
            assert sizes[row] == len(grams)
            assert got[row, column] == pytest.approx(-sum(map(math.log, map(p, grams))) / len(grams), rel=1e-9)
    # Probabilities after one context sum to one.
    context = np.int32(int(symbol[ord("l")]) << 6 | int(symbol[ord("o")]))
    after = (np.int32(0) << 18 | context << 6 | np.arange(64)).astype(np.int32)
    assert np.exp(-models.surprise(0, after)).sum() == pytest.approx(1)


@pytest.mark.parametrize("block", [1 << 24, 1])
def test_languages_are_found_and_held_out_labels_unused(spark, block):
    rows, frame = _texts(spark)
    got = language_id.identify(frame, block_grams=block).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r for r in rows}
    for r in got:
        _, text, lang, *_ = truth[r.doc_id]
        part = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5
        assert r.held_out == (part == 0) and 0 <= r.score <= 1
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, False)
        else:
            assert r.lang_pred == (lang or "xx")
    # Labels of held-out rows change nothing.
    other = frame.withColumn("lang", F.when(language_id.part_of(F.col("doc_id")) == 0, F.lit("qq")).otherwise(F.col("lang")))
    again = language_id.identify(other, block_grams=block).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_strange_texts_are_rejected(spark):
    rows, frame = _texts(spark, 2000)
    strange = spark.createDataFrame([(10**6, "zzqx xqzz kkqq zxqk " * 5, None, "s", 1)], frame.schema)
    got = language_id.identify(frame.union(strange)).collect()
    assert [r.rejected for r in got if r.doc_id == 10**6] == [True]
    assert sum(r.rejected for r in got) < 0.05 * len(got)


def test_nothing_to_learn_from(odd_documents):
    assert language_id.identify(odd_documents.limit(0)).count() == 0
    blank = language_id.identify(odd_documents.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in blank} == {("und", 0.0)} and len(blank) == odd_documents.count()


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, rejected, n = joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.98 and rejected < 0.1


def test_symbols_of_texts():
    s, ends = language_id.symbols(["ab, c", "", "  É"])
    assert (ends - np.append(0, ends[:-1])).tolist() == [7, 3, 4]
    assert s[:3].tolist() == [0, 0, 0] and s[3] != s[4] and s[5] == 0
    assert pa.array(s).type == pa.int32()


def test_chain_does_not_depend_on_partitions_or_repeated_rows(spark):
    from evidentia.llm import toxicity

    rng = random.Random(12)
    rows = [(i % 60, " ".join(rng.choice(["bad", "vile"] if i % 60 % 3 == 0 else ["good", "fine"]) + str(rng.randint(0, 3)) for _ in range(12)))
            for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 0)], "doc_id long, toxic int")
    fitted = [toxicity.fit_chain(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, ["toxic"], sample_rows=100)
              for r, n in ((rows, 1), (rows[::-1], 7), (rows + rows, 5))]
    for chain in fitted[1:]:
        assert (chain.models[0][1].words == fitted[0].models[0][1].words).all()
