"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A text is a sequence of symbols: letters in lower case, runs of anything else as one border. Symbols have six
bits (the border, the letters of ``ALPHABET``, all other letters hashed over what is left), so the number of a
gram of up to four symbols is its own perfect hash of at most 24 bits. Each language has a model of order four:
discounted counts for the longest grams and, below, the number of different symbols that precede a gram,
interpolated down to the uniform distribution. A text gets the language with the lowest cross-entropy per
symbol, its score is that language's share of exp(-sharpness * cross-entropy), and it counts as rejected where
that cross-entropy is higher than for 99 percent of the language's texts of the same length class.

Rows are dealt by their id: part 0 is held out, part 1 calibrates (the sharpness with the least log loss, the
limits of rejection), parts 2 to 4 give the counts. Language labels of part 0 are never read.

Scale: counting is one pass over the training texts; each task counts grams slice by slice and only
(language, gram, count) rows are shuffled. All statistics are aggregations of that table. What is sent to tasks
are sorted key arrays with their values; 24-bit keys bound a language to ``2^24`` grams, and languages go out in
blocks of at most ``BLOCK_GRAMS``, measured before, with one more pass over the rows of running best values for
each further block. Scoring is one pass without a shuffle: a slice's distinct grams are looked up by binary
search once, whatever their number of occurrences.

Defined results: a null text or one without a letter is ``und`` with score 0 and not rejected; so is every text
if there is nothing to learn from. Of equal cross-entropies the smallest language wins. A null id is treated as
the empty text when rows are dealt. Rows with a null language are scored like others. Repeated rows count again.
A language without calibration rows never rejects. An empty table gives an empty table. Columns other than id,
text and language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import query, table
from evidentia.operators.common import materialized

ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýœ"  # fixed symbols 1 to 55
ORDER, BITS = 4, 6
SYMBOLS = 1 << BITS
PARTS, HELD_OUT, CALIBRATION = 5, 0, 1
BLOCK_GRAMS = 1 << 24
SLICE_BYTES = 4 << 20
SHARPNESS = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0]
ACCEPTED = 0.99
CLASS_ROWS = 100  # length classes with fewer calibration texts use the limit of their language
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """The symbol of each code point; 0 for anything but letters."""
    fixed = {c: i for i, c in enumerate(ALPHABET, 1)}
    rest = SYMBOLS - 1 - len(fixed)
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = fixed.get(low) or 1 + len(fixed) + (ord(low[0]) * 2654435761 >> 7) % rest
    return out


_TABLE: list[np.ndarray] = []


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each behind ``ORDER - 1`` borders, and where each text ends."""
    if not _TABLE:
        _TABLE.append(symbol_table())
    pad = " " * (ORDER - 1)
    points = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
    s = _TABLE[0][points]
    ends = np.cumsum(np.array(list(map(len, texts)), np.int64) + len(pad))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    starts = ends - np.diff(ends, prepend=0)
    for i in range(len(pad)):
        keep[starts + i] = True
    # The border that opens a text is part of its padding.
    opens = starts + len(pad)
    opens = opens[opens < ends]
    keep[opens] &= s[opens] > 0
    return s[keep].astype(np.int32), np.cumsum(keep)[ends - 1] if len(ends) else ends


def grams(s: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each symbol of each text, and where each text's grams end."""
    g = np.zeros(len(s), np.int32)
    for back in range(ORDER):
        g[back:] |= s[:len(s) - back] << (BITS * back)
    first = np.append(0, ends[:-1])
    real = np.ones(len(s), bool)
    for i in range(ORDER - 1):
        real[first + i] = False
    return g[real], ends - (ORDER - 1) * np.arange(1, len(ends) + 1)


def part_of(id_column: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(PARTS)).cast("int")


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    texts = pc.fill_null(column, "")
    group = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)) // SLICE_BYTES
    cuts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, texts.slice(a, b - a).to_pylist()


def count_grams(docs: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """(lang, gram, c) over all texts with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).dictionary_encode()
            number = names.indices.to_numpy()
            for first, texts in _slices(batch.column(0)):
                own = number[first:first + len(texts)]
                for lang in np.unique(own).tolist():
                    s, ends = symbols([texts[i] for i in np.nonzero(own == lang)[0].tolist()])
                    found, n = np.unique(grams(s, ends)[0], return_counts=True)
                    label = pa.repeat(names.dictionary[lang], len(found))
                    yield pa.RecordBatch.from_arrays([label, pa.array(found, pa.int32()), pa.array(n, pa.int64())], ["lang", "gram", "c"])

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(language).cast("string").alias("lang")).filter("lang IS NOT NULL")
    return rows.mapInArrow(run, "lang string, gram int, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d): the absolute discount n1 / (n1 + 2 n2) of one order."""
    n1, n2 = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    return counts.groupBy("lang").agg(F.when(n1 > 0, n1 / (n1 + 2 * n2)).otherwise(0.5).alias("d"))


def fit(counts: DataFrame) -> DataFrame:
    """(lang, level, key, value) of the interpolated models.

    Level 2k holds the discounted share of grams of k symbols after their context, level 2k + 1 the weight
    that a context of k symbols leaves to the shorter grams.
    """
    levels, level = [], counts
    for k in range(ORDER, 0, -1):
        level = materialized(level, f"grams-{k}")
        context = F.shiftright("gram", BITS).alias("key") if k > 1 else F.lit(0).alias("key")
        total = level.groupBy("lang", context).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        d = _discounts(level)
        after = total.join(d, "lang")
        share = level.select("lang", context, "gram", "c").join(after, ["lang", "key"])
        levels.append(share.select("lang", F.lit(2 * k).alias("level"), F.col("gram").alias("key"),
                                   (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("value")))
        levels.append(after.select("lang", F.lit(2 * k - 1).alias("level"), "key", (F.col("d") * F.col("kinds") / F.col("total")).alias("value")))
        # Below, a gram counts as often as different symbols stand before it.
        shorter = F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1).alias("gram")
        level = level.groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("c"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return materialized(out, "language-models")


@dataclass
class LanguageModels:
    """Sorted keys and their values by language and level."""

    languages: list[str]
    arrays: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: pa.Table) -> LanguageModels:
        names = rows["lang"].combine_chunks().dictionary_encode()
        languages = sorted(names.dictionary.to_pylist(), key=lambda x: x.encode())
        rank = np.array([languages.index(x) for x in names.dictionary.to_pylist()], np.int64)
        lang = rank[names.indices.to_numpy()] if len(rank) else np.zeros(0, np.int64)
        level, key, value = (rows[c].to_numpy() for c in ("level", "key", "value"))
        order = np.lexsort((key, level, lang))
        lang, level, key, value = lang[order], level[order], key[order], value[order]
        arrays = {}
        for i in range(len(languages)):
            for k in range(1, 2 * ORDER + 1):
                a, b = np.searchsorted(lang * 16 + level, [i * 16 + k, i * 16 + k + 1])
                arrays[i, k] = key[a:b].astype(np.int32), value[a:b]
        return LanguageModels(languages, arrays)

    def _values(self, lang: int, level: int, keys: np.ndarray, missing: float) -> np.ndarray:
        known, values = self.arrays[lang, level]
        at = np.searchsorted(known, keys)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == keys[hit]
        out = np.full(len(keys), missing)
        out[hit] = values[at[hit]]
        return out

    def surprise(self, lang: int, found: np.ndarray) -> np.ndarray:
        """-log probability of the last symbol of each gram after the others."""
        p = np.full(len(found), 1 / SYMBOLS)
        for k in range(1, ORDER + 1):
            gram = found & ((1 << BITS * k) - 1)
            p = self._values(lang, 2 * k, gram, 0.0) + self._values(lang, 2 * k - 1, gram >> BITS, 1.0) * p
        return -np.log(p)


_PLACE = []


def cross_entropies(models: LanguageModels, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Nats per symbol (text, language) and the number of symbols of each text."""
    s, ends = symbols(texts)
    g, ends = grams(s, ends)
    if not _PLACE:
        _PLACE.append(np.zeros(1 << ORDER * BITS, np.int32))
    place = _PLACE[0]
    place[g] = 1
    found = np.nonzero(place)[0].astype(np.int32)
    place[found] = np.arange(len(found), dtype=np.int32)
    at = place[g]
    place[found] = 0
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(texts), len(models.languages)))
    for lang in range(len(models.languages)):
        sums = np.append(0.0, np.cumsum(models.surprise(lang, found)[at]))
        out[:, lang] = np.diff(sums[np.append(0, ends)]) / np.maximum(sizes, 1)
    return out, sizes


RUNNING = "lang_pred string, entropy double, own double, mass array<double>"


def _score(rows: DataFrame, models: LanguageModels, first: bool) -> DataFrame:
    """Add the languages of one block to the running best language, its cross-entropy, the cross-entropy under
    the row's own language (calibration rows) and the log mass of all languages for each sharpness."""
    sent = rows.sparkSession.sparkContext.broadcast(models)
    sharp = np.array(SHARPNESS)
    kept = ["doc_id", "part", "lang", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        number = {x: i for i, x in enumerate(model.languages)}
        for batch in batches:
            own_names, old = batch.column(2).to_pylist(), None if first else batch.slice(0)
            for at, texts in _slices(batch.column(3)):
                n = len(texts)
                h, sizes = cross_entropies(model, texts)
                best = h.argmin(1)
                low = h[np.arange(n), best]
                names = np.array(model.languages, object)[best]
                own = np.array([h[i, number[x]] if x in number else np.nan for i, x in enumerate(own_names[at:at + n])])
                z = -h[:, :, None] * sharp
                top = z.max(1)
                mass = top + np.log(np.exp(z - top[:, None]).sum(1))
                if old is not None:
                    b_name, b_low, b_own = (old.column(4 + i).slice(at, n).to_pylist() for i in range(3))
                    b_mass = np.asarray(old.column(7).slice(at, n).flatten()).reshape(n, -1)
                    earlier = np.array([b < x or b == x and a.encode() < y.encode() for a, b, x, y in zip(b_name, b_low, low, names)], bool)
                    names, low = np.where(earlier, np.array(b_name, object), names), np.where(earlier, b_low, low)
                    own = np.where(np.isnan(own), np.array([np.nan if x is None else x for x in b_own]), own)
                    mass = np.logaddexp(mass, b_mass)
                offsets = pa.array(np.arange(0, n * len(sharp) + 1, len(sharp), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(at, n) for i in range(4)]
                    + [pa.array(names.tolist(), pa.string()), pa.array(low), pa.array(own, pa.float64(), mask=np.isnan(own)),
                       pa.ListArray.from_arrays(offsets, pa.array(mass.ravel()))], kept + ["lang_pred", "entropy", "own", "mass"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, part int, lang string, text string, {RUNNING}")


def _blocks(models: DataFrame, most: int) -> list[list[str]]:
    """Languages in order, in blocks of at most ``most`` grams (one language alone is bounded by its keys)."""
    sizes = models.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    out, size = [], 0
    for r in sorted(sizes, key=lambda r: r.lang.encode()):
        if not out or size + r.n > most:
            out.append([])
            size = 0
        out[-1].append(r.lang)
        size += r.n
    return out


def _length_class() -> Column:
    return F.floor(F.log2(F.greatest(F.char_length("text"), F.lit(1)))).cast("int")


def identify(docs: DataFrame, id_column: str = "doc_id", text: str = "text", language: str = "lang",
             block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, rejected) of every row."""
    part = part_of(F.col(id_column))
    rows = docs.select(F.col(id_column).alias("doc_id"), part.alias("part"),
                       F.when(part != HELD_OUT, F.col(language).cast("string")).alias("lang"), F.col(text).cast("string").alias("text"))
    models = fit(count_grams(rows.filter(~F.col("part").isin(HELD_OUT, CALIBRATION))))
    blocks = _blocks(models, block_grams)
    lettered = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    columns = ["doc_id", "part", "lang", "size", "lang_pred", "entropy", "own", "mass"]
    scored = rows.filter(lettered).withColumn("lang", F.when(F.col("part") == CALIBRATION, F.col("lang")))
    for i, block in enumerate(blocks):
        arrays = LanguageModels.of(models.filter(F.col("lang").isin(block)).toArrow())
        scored = _score(scored, arrays, first=i == 0)
    if not blocks:
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (c.split(" ") for c in RUNNING.split(", "))]
        scored = rows.limit(0).select("*", *nothing)
    scored = materialized(scored.withColumn("size", _length_class()).select(*columns), "language-scores")
    sharp, limits = _calibration(scored)
    limits = materialized(limits, "language-limits")
    by_class = limits.filter(f"size IS NOT NULL AND n >= {CLASS_ROWS}").select("lang_pred", "size", "most")
    by_language = limits.filter("size IS NULL").select("lang_pred", F.col("most").alias("usual"))
    mass = F.element_at("mass", sharp + 1)
    judged = scored.join(by_class, ["lang_pred", "size"], "left").join(by_language, "lang_pred", "left").select(
        "doc_id", (F.col("part") == HELD_OUT).alias("held_out"), "lang_pred",
        F.least(F.exp(-SHARPNESS[sharp] * F.col("entropy") - mass), F.lit(1.0)).alias("score"), "entropy",
        F.coalesce(F.col("entropy") > F.coalesce("most", "usual"), F.lit(False)).alias("rejected"))
    silent = rows.filter(~lettered if blocks else F.lit(True)).select(
        "doc_id", (F.col("part") == HELD_OUT).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
        F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("rejected"))
    return judged.unionByName(silent)


def _calibration(scored: DataFrame) -> tuple[int, DataFrame]:
    """The index of the sharpness with the least log loss, and (lang_pred, size, n, most): the cross-entropy that
    99 percent of the ``n`` calibration texts of a language and length class do not exceed; size is null for all
    of a language's texts, whose limit stands in for classes with few texts.

    Quantiles are Spark's mergeable summaries, so no group is gathered in one task.
    """
    known = scored.filter(f"part = {CALIBRATION} AND own IS NOT NULL")
    loss = known.agg(*[F.avg(s * F.col("own") + F.element_at("mass", i + 1)).alias(str(i)) for i, s in enumerate(SHARPNESS)]).first()
    sharp = 0 if loss[0] is None else min(range(len(SHARPNESS)), key=lambda i: (loss[i], i))
    most = F.percentile_approx("own", ACCEPTED, 10_000).alias("most")
    named = known.select(F.col("lang").alias("lang_pred"), "size", "own")
    return sharp, named.rollup("lang_pred", "size").agg(F.count(F.lit(1)).alias("n"), most).filter("lang_pred IS NOT NULL")


@query("op11_language_id")
def op11_language_id(spark, folder: str) -> DataFrame:
    """Languages of all documents, learnt from those that are not held out."""
    return identify(table(spark, folder, "documents"))
