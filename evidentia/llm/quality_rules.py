"""Quality rules: a threshold table compiled into one Spark projection, no user functions.

``measures`` adds text statistics, ``judge`` applies a table of thresholds. Both are row-local:
no shuffle, and work grows with the length of the text (sorting repeated windows: n log n).

Defined results: a null text counts as empty; an empty text has zero for every count and ratio and
fails ``n_words``; repeated rows are judged one by one; columns of the input stay as they are, but for
one with the name asked for statistics or verdicts, which these replace; helper columns take names that are free; an empty table gives an
empty table. Windows of five words are compared by a 64-bit hash inside one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import SPACE, fresh, let, query, table, text_or_empty

WINDOW = 5

# Frequent function words of the corpus languages (English, French, German, Spanish).
STOP_WORDS = [
    "a", "all", "an", "and", "are", "as", "at", "au", "auf", "aux", "avec", "be", "by", "ce", "con",
    "dans", "das", "de", "del", "dem", "den", "der", "des", "die", "du", "e", "ein", "eine", "el", "en",
    "es", "est", "et", "für", "have", "ich", "il", "im", "in", "is", "ist", "it", "la", "las", "le",
    "les", "lo", "los", "mit", "ne", "nicht", "no", "of", "on", "or", "par", "pas", "por", "pour", "que",
    "qui", "se", "sie", "sich", "su", "sur", "that", "the", "this", "to", "un", "und", "une", "von",
    "was", "were", "with", "y", "zu",
]


@dataclass(frozen=True)
class Threshold:
    """A rule fails where its measure is below ``least`` or above ``most``."""

    rule: str
    measure: str
    least: float | None = None
    most: float | None = None


# The production table. Limits are inclusive.
THRESHOLDS = [
    Threshold("n_words", "n_words", least=10),
    Threshold("repeated_windows", "repeat_share", most=0.20),
    Threshold("symbols_per_word", "symbols_per_word", most=0.30),
    Threshold("mean_word_length", "mean_word_length", least=2, most=14),
    Threshold("stop_word_share", "stop_word_share", least=0.03),
    Threshold("duplicate_lines", "dup_line_share", most=0.50),
    Threshold("bullet_lines", "bullet_line_share", most=0.90),
    Threshold("ellipsis_lines", "ellipsis_line_share", most=0.30),
]


def _repeat_words(words: Column, grams: Column) -> Column:
    """Words inside windows that occur at least twice; ``grams`` are the window hashes in order."""

    def from_sorted(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda a, b: s[a]["h"] == s[b]["h"]
        at = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: (F.when(k > 0, same(k - 1, k)).otherwise(F.lit(False))
                       | F.when(k < last, same(k, k + 1)).otherwise(F.lit(False))))
        return F.sort_array(F.transform(at, lambda k: s[k]["i"]))

    def covered(p: Column) -> Column:
        # From one start to the next a window adds its length at most.
        return F.aggregate(
            p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")),
            lambda a, i: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n"),
                (i + WINDOW).alias("end")),
            lambda a: a["n"])

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, from_sorted), covered)


def measures(df: DataFrame, text: str = "text", out: str = "measures") -> DataFrame:
    """Add a struct of text statistics. Counts are longs, shares are doubles (0 for an empty text)."""
    body = text_or_empty(df, text)
    w, lines, grams, counts = fresh(df, "__words", "__lines", "__grams", "__count")
    df = df.withColumn(w, F.array_remove(F.split(body, SPACE, -1), ""))
    df = df.withColumn(lines, F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(w)
    df = df.withColumn(grams, F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW),
                    lambda i: F.xxhash64(*[F.col(w)[i + k] for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>")))
    distinct = F.size(F.array_distinct(grams)) == F.size(grams)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n_lines = F.size(lines)
    stops = F.size(F.filter(F.col(w), lambda x: F.lower(x).isin(STOP_WORDS)))
    count = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(distinct, F.lit(0)).otherwise(_repeat_words(F.col(w), F.col(grams))),
        "n_stop_words": stops,
        "n_bullet_lines": F.size(F.filter(F.col(lines), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•▪][\x20\x09-\x0D]"))),
        "n_ellipsis_lines": F.size(F.filter(F.col(lines), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
    }
    df = df.withColumn(counts, F.struct(*[v.cast("long").alias(k) for k, v in count.items()]))
    c = lambda k: F.col(counts)[k]
    ratio = {
        "mean_word_length": share(c("word_chars"), c("n_words")),
        "symbols_per_word": share(c("n_symbols"), c("n_words")),
        # One more than found, so that a short text is not judged by a single missing word.
        "stop_word_share": share(c("n_stop_words") + 1, c("n_words")),
        "repeat_share": share(c("n_repeat_words"), c("n_words")),
        "dup_line_share": share(c("n_dup_lines"), c("n_lines")),
        "bullet_line_share": share(c("n_bullet_lines"), c("n_lines")),
        "ellipsis_line_share": share(c("n_ellipsis_lines"), c("n_lines")),
    }
    df = df.withColumn(out, F.struct(*[c(k).alias(k) for k in count], *[v.alias(k) for k, v in ratio.items()]))
    return df.drop(w, lines, grams, counts)


def failed_rules(thresholds: list[Threshold], out: str = "measures") -> Column:
    """Names of the rules of the table that the row breaks, as one expression."""
    tests = []
    for t in thresholds:
        value, bad = F.col(f"{out}.{t.measure}"), F.lit(False)
        if t.least is not None:
            bad = bad | (value < t.least)
        if t.most is not None:
            bad = bad | (value > t.most)
        tests.append(F.when(bad, F.lit(t.rule)))
    return F.array_compact(F.array(*tests))


def judge(df: DataFrame, text: str = "text", thresholds: list[Threshold] = THRESHOLDS,
          out: str = "measures", verdict: str = "failed_rules") -> DataFrame:
    """Add the statistics and the array of broken rules; an empty array means kept."""
    return measures(df, text, out).withColumn(verdict, failed_rules(thresholds, out))


def passing(df: DataFrame, text: str = "text", thresholds: list[Threshold] = THRESHOLDS) -> DataFrame:
    """Rows that break no rule, with their own columns.

    A plain filter on the verdict would be pushed below the projections and repeat their work for each mention;
    a row number, which the optimizer must leave where it is, keeps the filter above them.
    """
    out, failed, row = fresh(df, "__measures", "__failed", "__row")
    judged = judge(df, text, thresholds, out, failed).withColumn(row, F.monotonically_increasing_id())
    return judged.filter((F.col(row) >= 0) & (F.size(failed) == 0)).select(*df.columns)


@query("op9_quality_rules", sql=r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM h) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM r, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
    length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l.l) AS n_lines, len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(c.n_repeat, 0) AS n_repeat_words,
    len(list_filter(w.w, lambda x: lower(x) IN (:stops))) AS n_stop,
    len(list_filter(l.l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•▪][\x20\x09-\x0D]'))) AS n_bullet,
    len(list_filter(l.l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_dots
  FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_symbols <= 0.30 * n_words AND word_chars BETWEEN 2 * n_words AND 14 * n_words
  AND n_stop + 1 >= 0.03 * n_words AND n_dup_lines <= 0.50 * n_lines AND n_bullet <= 0.90 * n_lines
  AND n_dots <= 0.30 * n_lines AS kept
FROM b""".replace(":stops", ", ".join(f"'{x}'" for x in STOP_WORDS)))
def op9_quality_rules(spark, folder: str) -> DataFrame:
    """Verdict of the production table on every document."""
    judged = judge(table(spark, folder, "documents").select("doc_id", "text"))
    m = lambda k: F.col(f"measures.{k}")
    base = (m("n_words") < 10) | (100 * m("n_repeat_words") > 20 * m("n_words"))
    return judged.select(
        "doc_id", *[m(k).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"), (~base & (F.size("failed_rules") == 0)).alias("kept"))
