"""Privacy gate, redaction, secret scan and protected-text leak scan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.config import SENTINEL_CODE_POINTS
from evidentia.functions import privacy
from evidentia.functions.text import SPACE, WHITE, nfkc, sha256_hex
from evidentia.operators.common import materialized, top_per, union_all


def privacy_findings(df: DataFrame, key: str, column: str, allow: list[str] = []) -> DataFrame:
    """(key, rule, value) per hit; every rule reads the text once."""
    def tagged(rule: str, values: Column) -> Column:
        return F.transform(
            F.coalesce(values, F.array().cast("array<string>")),
            lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("value")))

    hits = [tagged(rule, values) for rule, values in privacy.rules(F.col("_safe"), allow).items()]
    return df.select(key, nfkc(F.col(column)).alias("_safe")).select(key, F.inline(F.concat(*hits)))


def privacy_gate(df: DataFrame, column: str, allow: list[str] = []) -> dict[str, DataFrame]:
    """Split rows by a predicate of their own text; no join is needed."""
    private = F.coalesce(privacy.has_private(nfkc(F.col(column)), allow), F.lit(False))
    return {"safe": df.filter(~private), "quarantined": df.filter(private)}


def redact_contacts(df: DataFrame, column: str, allow: list[str] = []) -> DataFrame:
    """Replace contact values, then audit again: ``clean`` is false where a rule
    still hits."""
    redacted = df.withColumn(column, privacy.redact(nfkc(F.col(column)), allow))
    return redacted.withColumn("clean", ~privacy.has_private(F.col(column), allow))


def secret_findings(df: DataFrame, key: str, column: str, known: list[str] = []) -> DataFrame:
    """Secret-shaped and configured values; only their digests are reported."""
    hits = df.select(key, F.explode(privacy.secret_hits(F.col(column), known)).alias("_value"))
    return hits.select(key, sha256_hex(F.col("_value")).alias("secret_sha256")).distinct()


SHORT_GRAM = 6
SKETCH_ROWS = 2
SKETCH_SLOTS = 1 << 20


# A word with the white space behind it, or white space at the start. Ranges come first: they settle most characters.
_PIECE = rf"([!-~[^{SPACE}]]++){WHITE}*+|{WHITE}++"


def _pieces(c: Column) -> Column:
    """The text cut before each word: joined again they give the text, so lengths add up to positions. Words
    keep the white space behind them; white space at the start is a piece of its own."""
    return F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0))


def _words(c: Column) -> Column:
    """The word of each piece, empty for white space at the start."""
    return F.regexp_extract_all(c, F.lit(_PIECE), F.lit(1))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _sums_before(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda n: (np.cumsum(n) - n).astype("int32"), na_action="ignore")


def _starts(c: Column) -> Column:
    """Where each piece starts, by one sum over the lengths of a text."""
    return _sums_before(F.transform(_pieces(c), F.char_length))


def _pair_hash(first: Column, second: Column) -> Column:
    return F.xxhash64(F.lit("pair"), first, second)


def _pairs(words: Column, starts: Column) -> Column:
    """(at, start, hash) of neighbouring words by the number and the start of the first one."""
    count = F.size(words) - 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
        i.alias("at"), F.get(starts, i).alias("start"), _pair_hash(F.get(words, i), F.get(words, i + 1)).alias("anchor")))).otherwise(
        F.array().cast("array<struct<at:int,start:int,anchor:bigint>>"))


def _singles(words: Column, starts: Column) -> Column:
    return F.transform(words, lambda w, i: F.struct(
        i.alias("at"), F.get(starts, i).alias("start"), F.xxhash64(F.lit("word"), w).alias("anchor")))


def _inside(words: Column, starts: Column, size: int) -> Column:
    """(at, start, hash) of every run of ``size`` characters inside a word."""
    grams = lambda w, i: F.transform(
        F.sequence(F.lit(0), F.greatest(F.char_length(w) - size, F.lit(0))),
        lambda g: F.struct(i.alias("at"), (F.get(starts, i) + g).alias("start"),
                           F.xxhash64(F.lit("part"), F.substring(w, g + 1, F.lit(size))).alias("anchor")))
    marked = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.char_length(x["w"]) >= size)
    return F.flatten(F.transform(marked, lambda x: grams(x["w"], x["i"])))


def _slot(hashed: Column, row: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), hashed), F.lit(SKETCH_SLOTS)).cast("int")


def pair_sketch(texts: DataFrame, column: str) -> DataFrame:
    """(sketch, slot, n): a frequency sketch of neighbouring words. Sketches of parts add up; a pair occurs at
    most as often as the smallest of its slots, whatever the size of the table."""
    words = texts.select(_words(F.col(column)).alias("_words"))
    neighbours = F.transform(F.sequence(F.lit(1), F.size("_words") - 1), lambda i: _pair_hash(F.get("_words", i - 1), F.get("_words", i)))
    pairs = words.filter(F.size("_words") > 1).select(F.explode(neighbours).alias("_pair"))
    slots = F.inline(F.array(*[F.struct(F.lit(r).alias("sketch"), _slot(F.col("_pair"), r).alias("slot")) for r in range(SKETCH_ROWS)]))
    return pairs.select(slots).groupBy("sketch", "slot").agg(F.count(F.lit(1)).alias("n"))


def sentinels_of(index: DataFrame, digests: DataFrame) -> DataFrame:
    """Values that must not leave the corpus: digests, chunk ids and long texts."""
    return union_all([
        digests.select(F.col("digest").alias("value")),
        index.select(F.col("id").alias("value")),
        index.filter(F.char_length("text") >= SENTINEL_CODE_POINTS).select(F.col("text").alias("value")),
    ])


def _anchored(sentinels: DataFrame, short_gram: int) -> tuple[DataFrame, DataFrame]:
    """(digest, length, kind, size, offset, anchor) for sentinels of up to three words, and the same with all
    inner pairs of longer ones. ``offset`` is where the anchor starts in the sentinel."""
    values = sentinels.filter("value <> ''").select(
        sha256_hex(F.col("value")).alias("digest"), F.char_length("value").alias("length"),
        _words(F.col("value")).alias("_words"), _starts(F.col("value")).alias("_starts"))
    first = F.when(F.get("_words", F.lit(0)) == "", 1).otherwise(0)
    values = values.withColumn("_first", first).withColumn("_n", F.size("_words") - F.col("_first")).filter("_n > 0")
    kept = ["digest", "length"]
    long = values.filter("_n >= 4").select(
        *kept, F.explode(F.filter(_pairs(F.col("_words"), F.col("_starts")), lambda p: (p["at"] > F.col("_first")) & (
            p["at"] + 1 < F.size("_words") - 1))).alias("p")).select(
        *kept, F.lit("pair").alias("kind"), F.lit(0).alias("size"), F.col("p.start").alias("offset"), F.col("p.anchor").alias("anchor"))
    middle = F.col("_first") + 1
    three = values.filter("_n = 3").select(
        *kept, F.lit("word").alias("kind"), F.lit(0).alias("size"), F.get("_starts", middle).alias("offset"),
        F.xxhash64(F.lit("word"), F.get("_words", middle)).alias("anchor"))
    marked = F.transform("_words", lambda w, i: F.struct(F.char_length(w).alias("l"), (-i).alias("before"), w.alias("w")))
    short = values.filter("_n <= 2").withColumn("_longest", F.array_max(marked)).withColumn(
        "size", F.least(F.col("_longest.l"), F.lit(short_gram))).select(
        *kept, F.lit("part").alias("kind"), "size", F.get("_starts", -F.col("_longest.before")).alias("offset"),
        F.xxhash64(F.lit("part"), F.substring(F.col("_longest.w"), F.lit(1), F.col("size"))).alias("anchor"))
    return three.unionByName(short), long


def _rarest(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The inner pair of each sentinel that the sketch holds for rarest."""
    slots = F.inline(F.array(*[F.struct(F.lit(r).alias("sketch"), _slot(F.col("anchor"), r).alias("slot")) for r in range(SKETCH_ROWS)]))
    keys = ["digest", "length", "kind", "size", "offset", "anchor"]
    judged = pairs.distinct().select(*keys, slots).join(sketch, ["sketch", "slot"], "left")
    estimate = judged.groupBy(*keys).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
    # A pair in an empty slot occurs nowhere, and its sentinel with it.
    return top_per(estimate, ["digest"], [F.col("n"), F.col("offset")], 1, "_r").filter("n > 0").select(*keys)


def leak_scan(targets: DataFrame, sentinels: DataFrame, key: str, column: str,
              short_gram: int = SHORT_GRAM) -> DataFrame:
    """(key, sentinel_sha256) for every sentinel contained in a target.

    Containment becomes an equi-join on an anchor that each containing text must also hold:

    * four words or more: two neighbouring words between the first and the last, of all such pairs the one that
      is rarest in the targets by a frequency sketch. Inner words are delimited inside a sentinel, so they are
      whole words of the target;
    * three words: the middle one;
    * one or two words: the first ``short_gram`` characters of the longest, looked up inside all words.

    Only keys, positions, hashes and digests are joined. An anchor's position and the sentinel's length name one
    stretch of the target, whose SHA-256 settles the case, so texts of sentinels are never moved and those of
    targets only for candidates.
    """
    few, pairs = _anchored(sentinels, short_gram)
    few = materialized(few.distinct(), "leak-anchors")
    pairs = materialized(pairs, "leak-pairs")
    # Which anchor kinds and gram lengths occur decides what targets explode to: a handful of small integers.
    kinds = {(r.kind, r.size) for r in few.select("kind", "size").distinct().collect()}
    words, parts = (F.col("_words"), F.col("_starts")), []
    if not pairs.isEmpty():
        sketch = materialized(pair_sketch(targets, column), "leak-sketch")
        few = materialized(few.unionByName(_rarest(pairs, sketch)), "leak-anchors")
        parts.append(_pairs(*words))
    if ("word", 0) in kinds:
        parts.append(_singles(*words))
    parts += [_inside(*words, size) for kind, size in sorted(kinds) if kind == "part"]
    if not parts:
        return targets.select(key, F.lit(None).cast("string").alias("sentinel_sha256")).limit(0)
    cut = targets.select(F.col(key), _words(F.col(column)).alias("_words"), _starts(F.col(column)).alias("_starts"))
    posted = cut.select(key, F.inline(F.concat(*parts)))
    candidates = posted.join(few.select("anchor", "digest", "length", "offset"), "anchor").select(
        key, (F.col("start") - F.col("offset")).alias("_begin"), "digest", "length")
    found = materialized(candidates.filter("_begin >= 0"), "leak-candidates")
    texts = targets.select(key, F.col(column).alias("_text"))
    stretch = F.substring(F.col("_text"), F.col("_begin") + 1, F.col("length"))
    return (
        found.join(texts, key).filter(sha256_hex(stretch) == F.col("digest"))
        .select(key, F.col("digest").alias("sentinel_sha256")).distinct()
    )
