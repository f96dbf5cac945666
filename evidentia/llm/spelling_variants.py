"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles, and the frequent form each follows.

Two different words with lengths that differ by at most one are one edit apart exactly if their common prefix
and common suffix together reach the longer length minus one. Words stand as padded rows of code-point
matrices, one from the left and one from the right; a tile compares all rows of two blocks at once.

Which words meet: let m be the longer length and p the common prefix of a pair. The positions 0 to m - 1 are cut
into ``RANGES`` runs; if p lies in the run [a, b), the pair shares its first a and its last m - b characters.
Every word is posted under these characters for each run, as the longer and as the shorter word, and only words
under one key are compared. Each pair is accepted in the run that holds its prefix alone, so it is found once.

Scale: occurrences are counted with map-side combination, so a frequent word is one row a task. Keys keep two
thirds of a word's characters, which makes nearly all groups tiny; these are compared many at a time. A group
beyond ``TILE`` words is dealt into blocks by a hash and its block pairs are spread over all tasks, so no task
holds more than two blocks of a group. That part is quadratic in a group of words which agree in two thirds of
their characters; only pairs that are near leave a tile. A form is ``factor`` times as frequent as its word, so
chains are short, and roots are found by a number of doublings that follows from the largest count.

Defined results: a null or empty text has no words; a null id counts as an empty text in the hash of a run;
repeated rows count again; of equally frequent near words the smallest in code-point order is the form; a word
without a near word has ``n_near`` 0 and is its own root; an empty table gives an empty table. Columns other
than id and text are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import query, table, text_or_empty
from evidentia.operators.common import materialized

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST = 7
LEAST = 2
FACTOR = 10
DROPPED_OF = 31  # one run in so many, by hash of document and run, loses a character
RANGES = 3
TILE = 512
CELLS = 1 << 23  # matrix bytes compared at once


def words_of(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(word), one row for each run of letters that gives a word of at least ``shortest`` code points."""
    runs = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text_or_empty(docs, text), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    # Runs of ASCII letters take the faster function; in others only A-Z may change.
    ascii_run = F.octet_length("run") == F.char_length("run")
    low = runs.select("id", F.when(ascii_run, F.lower("run")).otherwise(
        F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % DROPPED_OF == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= shortest)


def frequent(words: DataFrame, least: int = LEAST) -> DataFrame:
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _bounds(m: Column, k: int) -> tuple[Column, Column]:
    return F.floor(m * k / RANGES).cast("int"), F.floor(m * (k + 1) / RANGES).cast("int")


def _postings(words: DataFrame) -> DataFrame:
    """(key, m, a, b, word, n): each word under the ends it would share with a near word, run by run."""
    w, length = F.col("word"), F.char_length("word")
    posts = []
    for longer in (0, 1):
        m = length + longer
        for k in range(RANGES):
            a, b = _bounds(m, k)
            head, tail = F.substring(w, F.lit(1), a), F.substring(w, length - (m - b) + 1, m - b)
            posts.append(F.struct(F.xxhash64(m, F.lit(k), head, tail).alias("key"), m.alias("m"), a.alias("a"), b.alias("b")))
    return words.select(F.inline(F.array(*posts)), "word", "n")


def _tiles(words: DataFrame, tile: int) -> DataFrame:
    """Postings with the block of their word and the block pair they are compared in."""
    large = _postings(words).groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > tile)
    large = materialized(large.select("key", F.ceil(F.col("size") / tile).cast("int").alias("blocks")), "large-groups")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = _postings(words).join(large, "key", "left").select(
        "key", "m", "a", "b", "word", "n", blocks.alias("blocks"), F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select("*", other).select(
        "m", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "a", "b", "word", "n")


def _matrices(words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points from the left and from the right, filled up with zeros. Letters end at U+00FF, one byte each."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    used = np.arange(lengths.max()) < lengths[:, None]
    left, right = np.zeros(used.shape, np.uint8), np.zeros(used.shape, np.uint8)
    left[used] = letters
    right[used] = np.frombuffer("".join(w[::-1] for w in words).encode("latin-1"), np.uint8)
    return left, right


def _common(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common start of rows i and j; different words always differ somewhere."""
    return (rows[i] == rows[j]).argmin(1)


def _near(words: list[str], lengths: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], m: np.ndarray, a: np.ndarray,
          b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of row numbers that are one edit apart and belong to this run."""
    left, right = _matrices(words, lengths)
    for i, j in pairs:
        fit = np.maximum(lengths[i], lengths[j]) == m[i]
        i, j = i[fit], j[fit]
        p = _common(left, i, j)
        own = (a[i] <= p) & (p < b[i])
        i, j, p = i[own], j[own], p[own]
        near = p + _common(right, i, j) >= m[i] - 1
        yield i[near], j[near]


def _group_pairs(starts: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside groups of rows, tiles of one size taken together, at most about ``most`` pairs at once."""
    for size in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, most // len(i))
        for k in range(0, len(at), step):
            base = at[k:k + step, None]
            yield (base + i).ravel(), (base + j).ravel()


def _block_pairs(start: int, block: np.ndarray, low: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs between the two blocks of one group."""
    first, second = start + np.nonzero(block == low)[0], start + np.nonzero(block != low)[0]
    step = max(1, most // max(len(second), 1))
    for k in range(0, len(first) if len(second) else 0, step):
        some = first[k:k + step]
        yield np.repeat(some, len(second)), np.tile(second, len(some))


def _compared(rows: pa.Table, factor: int) -> Iterator[pa.RecordBatch]:
    """Both directions of the near pairs inside whole groups of rows."""
    column = {c: rows[c].to_numpy() for c in ("m", "key", "low", "high", "block", "a", "b", "n")}
    change = np.ones(rows.num_rows, bool)
    change[1:] = (np.diff(column["key"]) != 0) | (np.diff(column["low"]) != 0) | (np.diff(column["high"]) != 0) | (np.diff(column["m"]) != 0)
    starts = np.nonzero(change)[0]
    sizes = np.diff(np.append(starts, rows.num_rows))
    # Rows of groups with company only, a limited number of matrix cells at a time.
    cells = np.cumsum(np.where(sizes > 1, sizes * column["m"][starts], 0)) // CELLS
    for part in np.unique(cells).tolist():
        groups = np.nonzero((cells == part) & (sizes > 1))[0]
        if not len(groups):
            continue
        size = sizes[groups]
        local = np.cumsum(size) - size
        take = np.repeat(starts[groups] - local, size) + np.arange(size.sum())
        words = rows["word"].take(pa.array(take)).to_pylist()
        strings = pa.array(words, pa.string())
        lengths = np.array(list(map(len, words)), np.int64)
        c = {k: v[take] for k, v in column.items()}
        most = max(1, CELLS // int(lengths.max()))
        inside = c["low"][local] == c["high"][local]

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from _group_pairs(local[inside], size[inside], most)
            for at, n in zip(local[~inside].tolist(), size[~inside].tolist()):
                yield from _block_pairs(at, c["block"][at:at + n], c["low"][at], most)

        for i, j in _near(words, lengths, pairs(), c["m"], c["a"], c["b"]):
            if len(i):
                i, j = np.concatenate([i, j]), np.concatenate([j, i])
                follows = c["n"][j] >= factor * c["n"][i]
                form = pa.array(c["n"][j], pa.int64(), mask=~follows)
                named = strings.take(pa.array(j, pa.int64(), mask=~follows))
                yield pa.RecordBatch.from_arrays([strings.take(pa.array(i)), form, named], ["word", "form_n", "form"])


def near_pairs(words: DataFrame, factor: int = FACTOR, tile: int = TILE) -> DataFrame:
    """(word, form_n, form), a row for each near word of each word; the last two where it is frequent enough."""
    order = ["m", "key", "low", "high", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*rest, batch]).combine_chunks()
            key, low, high = (rows[c].to_numpy() for c in ("key", "low", "high"))
            # The last group may go on in the next batch.
            ended = np.nonzero((key != key[-1]) | (low != low[-1]) | (high != high[-1]))[0]
            cut = int(ended[-1]) + 1 if len(ended) else 0
            rest = rows.slice(cut).to_batches()
            if cut:
                yield from _compared(rows.slice(0, cut).combine_chunks(), factor)
        if rest:
            yield from _compared(pa.Table.from_batches(rest).combine_chunks(), factor)

    dealt = _tiles(words, tile).repartition("key", "low", "high").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "word string, form_n bigint, form string")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) by doubling: after k turns 2^k forms have been followed."""
    found = forms.select("word", F.col("form").alias("root"))
    for turn in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        found = materialized(found, f"roots-{turn}")
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = found.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return found


def group_variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST,
                   factor: int = FACTOR, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs ``least`` times."""
    if factor < 2 or least < 1:
        raise ValueError("a form must be more frequent than its word")
    words = materialized(frequent(words_of(docs, id_column, text, shortest), least), "words")
    none = F.lit(None)
    own = words.select("word", "n", F.lit(0).cast("bigint").alias("near"), F.struct(none.cast("bigint").alias("less"), none.cast("string").alias("form")).alias("best"))
    met = near_pairs(words, factor, tile).select(
        "word", none.cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("near"), F.struct((-F.col("form_n")).alias("less"), "form").alias("best"))
    best = F.min(F.when(F.col("best.form").isNotNull(), F.col("best")))
    rows = own.unionByName(met).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best"))
    rows = materialized(rows.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "variants")
    largest = rows.agg(F.max("n")).first()[0] or 1
    steps = math.floor(math.log(max(largest / least, 1), factor) + 1e-9)
    chains = roots(rows.filter("form IS NOT NULL"), steps)
    return rows.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CRC_TABLE = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i)))"""

SQL = f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{SHORTEST},}}')) AS run FROM documents),
low AS (
  SELECT doc_id, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run, count(*) AS k FROM runs GROUP BY ALL),
coded AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda s: CASE WHEN ord(s) < 128 THEN [ord(s)::BIGINT] ELSE [(192 | (ord(s) >> 6))::BIGINT, (128 | (ord(s) & 63))::BIGINT] END))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM low, crc_table),
formed AS (
  SELECT CASE WHEN h % {DROPPED_OF} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, k FROM coded),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM formed WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(k) >= {LEAST}),
cuts AS (
  SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
ranked AS (
  SELECT word, n, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r,
         count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS (SELECT word, other AS form, other_n AS form_n FROM ranked WHERE r = 1 AND other_n >= {FACTOR} * n),
chain AS (
  SELECT word, form AS tip FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.tip),
ends AS (SELECT word, tip AS root FROM chain WHERE tip NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(r.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1 LEFT JOIN forms f ON f.word = w.word LEFT JOIN ends e ON e.word = w.word"""


@query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark, folder: str) -> DataFrame:
    """Words of all documents with the frequent words they are variants of."""
    return group_variants(table(spark, folder, "documents"))
