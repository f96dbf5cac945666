"""Toxicity: a classifier chain over label columns, linear models on hashed words.

Categories are predicted in order. Each model sees the words of a text and the probabilities of all earlier
categories. In training these probabilities come from models that did not see the row (out of fold), so a
later model learns from the same kind of input that it meets on new texts. Folds follow the text, so copies
of a text share a fold.

Scale: models are fitted on a bounded sample of labelled rows (``sample_rows``, a stated limit; the rows with
the smallest hash of their id). The sample's ids are joined by broadcast and its hashed words collected, which
that bound allows. Words are hashed by column functions; scoring is one pass over all texts without a shuffle,
in which a model is one vector of ``features`` weights.

Defined results: a null or empty text has no words and gets each model's intercept; labelled rows with a null
in any category or without a document are not used; of repeated labels the largest values count; repeated
documents are scored one by one and a text counts once an id when models are fitted; a category with one class only, or no labels at all, gets the constant
probability of that class, 0 without labels; an empty table gives an empty table. Other input columns pass
through; ``words`` and ``p_<category>`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import NON_WORD, query, table, text_or_empty

SAMPLE_ROWS = 20_000
FOLDS = 3
FEATURES = 1 << 17
THRESHOLD = 0.5
EPOCHS = 60
PENALTY = 1e-4
DEVIATIONS = 6.0  # a word is used if its share in the positive class is so many standard deviations off


def with_features(docs: DataFrame, text: str = "text", features: int = FEATURES) -> DataFrame:
    """Add ``words``: the distinct hash numbers of a text's words."""
    words = F.array_remove(F.split(F.lower(text_or_empty(docs, text)), NON_WORD, -1), "")
    numbers = F.transform(F.array_distinct(words), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))
    return docs.withColumn("words", F.array_distinct(numbers))


@dataclass
class Rows:
    """Sets of word numbers, one after the other, with the probabilities of earlier categories."""

    words: np.ndarray
    ends: np.ndarray
    earlier: np.ndarray

    @staticmethod
    def of(column: pa.ListArray, earlier: int = 0) -> Rows:
        lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
        return Rows(np.asarray(column.flatten(), np.int64), np.cumsum(lengths), np.zeros((len(lengths), earlier)))

    def take(self, keep: np.ndarray) -> Rows:
        lengths = np.diff(self.ends, prepend=0)
        return Rows(self.words[np.repeat(keep, lengths)], np.cumsum(lengths[keep]), self.earlier[keep])

    def with_column(self, p: np.ndarray) -> Rows:
        return Rows(self.words, self.ends, np.column_stack([self.earlier, p]))


@dataclass
class LinearModel:
    words: np.ndarray
    earlier: np.ndarray
    intercept: float

    def probability(self, rows: Rows) -> np.ndarray:
        sums = np.append(0.0, np.cumsum(self.words[rows.words]))[np.append(0, rows.ends)]
        z = np.diff(sums) + rows.earlier @ self.earlier + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_linear(rows: Rows, y: np.ndarray, features: int = FEATURES, epochs: int = EPOCHS, penalty: float = PENALTY) -> LinearModel:
    """Logistic regression with equal total weight for both classes, by full-batch Adam steps.

    Only words whose presence depends clearly on the class get a weight; rare words would fit single rows.
    """
    n, k = len(y), rows.earlier.shape[1]
    if n == 0 or y.all() or not y.any():
        return LinearModel(np.zeros(features), np.zeros(k), 50.0 if n and y.all() else -50.0)
    lengths = np.diff(rows.ends, prepend=0)
    share, seen = y.mean(), np.bincount(rows.words, minlength=features)
    positive = np.bincount(rows.words, np.repeat(y, lengths).astype(float), features)
    used = np.abs(positive - share * seen) >= DEVIATIONS * np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    kept = used[rows.words]
    rows = Rows(rows.words[kept], np.append(0, np.cumsum(kept))[rows.ends], rows.earlier)
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    of_row = np.repeat(np.arange(n), np.diff(rows.ends, prepend=0))
    w = np.zeros(features + k + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        model = LinearModel(w[:features], w[features:features + k], w[-1])
        r = (model.probability(rows) - y) * weight
        g = np.concatenate([np.bincount(rows.words, r[of_row], features), rows.earlier.T @ r, [r.sum()]])
        g[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return LinearModel(w[:features], w[features:features + k], float(w[-1]))


@dataclass
class ClassifierChain:
    """Fitted models in the order of their categories."""

    models: list[tuple[str, LinearModel]] = field(default_factory=list)

    def probabilities(self, rows: Rows) -> list[np.ndarray]:
        out = []
        for _, model in self.models:
            out.append(model.probability(rows))
            rows = rows.with_column(out[-1])
        return out

    def score(self, featured: DataFrame) -> DataFrame:
        """Replace ``words`` by ``p_<category>`` for each category."""
        names = [f"p_{c}" for c, _ in self.models]
        kept = [c for c in featured.columns if c not in {"words", *names}]
        chain = featured.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = chain.value.probabilities(Rows.of(batch.column(len(kept))))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(x, pa.float64()) for x in p],
                                                 kept + names)

        schema = T.StructType([featured.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in names])
        return featured.select(*kept, "words").mapInArrow(run, schema)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_column: str = "doc_id", text: str = "text",
              sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS, features: int = FEATURES) -> ClassifierChain:
    """Fit one model a category, in order, on at most ``sample_rows`` labelled rows."""
    known = labels.dropna(subset=[id_column, *categories]).groupBy(id_column).agg(*[F.max(c).cast("int").alias(c) for c in categories])
    sample = known.orderBy(F.xxhash64(id_column), id_column).limit(sample_rows)
    joined = docs.select(id_column, text).join(F.broadcast(sample), id_column)
    fold = F.pmod(F.xxhash64(text_or_empty(joined, text)), F.lit(folds)).cast("int").alias("fold")
    key = F.xxhash64(text_or_empty(joined, text)).alias("text_key")
    rows = with_features(joined, text, features).select("words", fold, key, F.col(id_column).alias("id"), *categories)
    # One row an id and text, in a total order: the same sample and models whatever the partitions were.
    first = rows.dropDuplicates(["id", "text_key"]).orderBy(F.xxhash64("id"), "id", "text_key").limit(sample_rows)
    got = first.toArrow().sort_by([("id", "ascending"), ("text_key", "ascending")]).combine_chunks()
    rows, fold = Rows.of(got["words"].combine_chunks()), got["fold"].to_numpy()
    chain = ClassifierChain()
    for category in categories:
        y = got[category].to_numpy() > 0
        chain.models.append((category, fit_linear(rows, y, features)))
        held_out = np.zeros(len(y))
        if category != categories[-1]:
            for f in range(folds):
                model = fit_linear(rows.take(fold != f), y[fold != f], features)
                held_out[fold == f] = model.probability(rows.take(fold == f))
        rows = rows.with_column(held_out)
    return chain


CATEGORIES = ["low_quality", "toxic"]


@query("op5_toxicity")
def op5_toxicity(spark, folder: str) -> DataFrame:
    """Chain of low quality, then toxicity, fitted on labelled documents and applied to all."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").withColumn("low_quality", 1 - F.col("quality"))
    chain = fit_chain(docs, labels, CATEGORIES)
    scored = chain.score(with_features(docs).select("doc_id", "words"))
    return scored.select("doc_id", *[f"p_{c}" for c in CATEGORIES], (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
