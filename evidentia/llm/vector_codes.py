"""Vector code compression: product codes learnt by active-entry Lloyd rounds over integers.

A vector's components become integers (floor of ``SCALE`` times the value) and are cut into equal consecutive
parts; each part is coded by the number of its nearest codebook entry. Every row carries the entry and the
exact squared distance of each part from round to round. After the entries were replaced by the means of their
parts, only some have moved: a part whose entry stayed compares its stored distance with the moved entries
alone, any other part rescans the codebook. Ties go to the lower index in both cases, so codes equal those of
full rescans.

Scale: a round is one pass without a shuffle. It writes the rows with their codes and, as the last row of each
task, the task's counts and component sums per entry; these (``parts * entries`` of them, whatever the input)
are summed by Spark and turned into the next codebook on the driver. State is a stored table, so a lost
executor costs its tasks of one round. Label sums meet their rows as two stored tables, so that a label with a
third of all rows can be split.

Defined results: rows whose vector is null, empty, or holds a null, NaN or infinite component are dropped, and
so are vectors of another length than that of the smallest kept id. A length that is no multiple of ``parts``
is filled up with zeros. Components are held within +-``bound(width)``, which keeps distances exact in 64 bits.
Repeated ids are rows of their own; null ids come after all others when the first codebook is chosen, equal
ids in the order of their components. With fewer rows than entries the codebook is as short. A label sum beyond
64 bits is null. An empty table gives an empty table. Columns other than id, vector and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import query, table
from evidentia.operators.common import materialized

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
ROWS_AT_ONCE = 1024


def bound(width: int) -> int:
    """Components within it have distances whose sum over all parts is below 2^62."""
    return isqrt((1 << 58) // max(width, 1)) // 2


def integers(values: np.ndarray, width: int) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -bound(width), bound(width)).astype(np.int64)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts (rows, width) to entries (entries, width)."""
    out = np.zeros((len(x), len(book)), np.int64)
    for i in range(x.shape[1]):
        step = x[:, i, None] - book[None, :, i]
        step *= step
        out += step
    return out


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, book)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``assign(x, book)`` from the codes and distances before the ``moved`` entries were replaced."""
    code, distance = code.copy(), distance.copy()
    lost = moved[code]
    code[lost], distance[lost] = assign(x[lost], book)
    active, rest = np.nonzero(moved)[0], np.nonzero(~lost)[0]
    if len(active) and len(rest):
        near, d = assign(x[rest], book[active])
        near = active[near]
        closer = (d < distance[rest]) | ((d == distance[rest]) & (near < code[rest]))
        code[rest[closer]], distance[rest[closer]] = near[closer], d[closer]
    return code, distance


def next_books(books: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries replaced by the floor of their parts' means, and which of them moved."""
    means = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
    return means, (means != books).any(2)


def _pass(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """One assignment of all rows. ``moved`` is None in the first pass, whose rows have no codes yet."""
    parts, entries, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast((books, moved))

    def codes_of(x: np.ndarray, code: np.ndarray | None, distance: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        book, move = sent.value
        for p in range(parts):
            if code is None:
                yield assign(x[:, p], book[p])
            else:
                yield reassign(x[:, p], book[p], move[p], code[:, p], distance[:, p])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        names, kinds = ["vec_id", "label", "x", "code", "distance", "totals"], None
        for batch in batches:
            kinds = [batch.column(0).type, batch.column(1).type]
            values, old = batch.column(2).flatten(), None
            x = np.zeros((batch.num_rows, parts * width), np.int64)
            if batch.num_rows:
                flat = values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x[:, :flat.shape[1]] = integers(flat, width) if moved is None else flat
            x = x.reshape(-1, parts, width)
            if moved is not None:
                old = [np.asarray(batch.column(i).flatten(), np.int64).reshape(-1, parts) for i in (3, 4)]
            for at in range(0, len(x), ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                found = list(codes_of(x[some], *([None, None] if old is None else [o[some] for o in old])))
                code, distance = (np.stack(f, 1) for f in zip(*found))
                for p in range(parts):
                    counts[p] += np.bincount(code[:, p], minlength=entries)
                    np.add.at(sums[p], code[:, p], x[some, p])
                n = len(code)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), batch.column(1).slice(at, n), _lists(x[some].reshape(n, -1), pa.int32()),
                    _lists(code, pa.int16()), _lists(distance, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names)
        if kinds:
            totals = np.concatenate([counts.ravel(), sums.ravel()])[None]
            blank = [pa.nulls(1, k) for k in (*kinds, pa.list_(pa.int32()), pa.list_(pa.int16()), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*blank, _lists(totals, pa.int64())], names)

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, x array<int>, code array<smallint>, "
                                "distance array<bigint>, totals array<bigint>")


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32) if len(values) else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _totals(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums per entry; as many numbers as the codebooks have, one per slot."""
    parts, entries, width = books.shape
    slots = state.filter("totals IS NOT NULL").select(F.posexplode("totals").alias("slot", "n")).groupBy("slot").agg(F.sum("n").alias("n"))
    flat = np.zeros(parts * entries * (1 + width), np.int64)
    for slot, n in slots.collect():
        flat[slot] = n
    return flat[:parts * entries].reshape(parts, entries), flat[parts * entries:].reshape(parts, entries, width)


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every usable vector, and the codebooks (part, entry, position).

    ``code`` is an array of entry numbers by part, ``error`` the squared distances summed over parts.
    """
    v = F.col("x")
    finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("x")).filter(
        v.isNotNull() & (F.size(v) > 0) & finite)
    first = [F.col("vec_id").asc_nulls_last(), v.asc()]
    seeds = rows.orderBy(*first).limit(entries).select("x").collect()
    length = len(seeds[0].x) if seeds else parts
    rows = rows.filter(F.size(v) == length)
    if any(len(s.x) != length for s in seeds):
        seeds = rows.orderBy(*first).limit(entries).select("x").collect()
    width = -(-length // parts)
    books = np.zeros((max(len(seeds), 1), parts * width), np.int64)
    for i, s in enumerate(seeds):
        books[i, :length] = integers(np.array(s.x, np.float64), width)
    books, moved = books.reshape(-1, parts, width).swapaxes(0, 1).copy(), None
    for turn in range(rounds + 1):
        state = materialized(_pass(rows, books, moved), f"vector-codes-{turn}")
        rows = state.filter("totals IS NULL").select("vec_id", "label", "x", "code", "distance")
        if turn < rounds:
            books, moved = next_books(books, *_totals(state, books))
    error = F.aggregate("distance", F.lit(0).cast("bigint"), lambda a, d: a + d)
    return rows.select("vec_id", "label", "code", error.alias("error")), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the errors summed over the rows of equal labels, nulls together."""
    sums = materialized(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    same = F.col("r.label").eqNullSafe(F.col("s.label"))
    return coded.alias("r").join(sums.alias("s"), same).select("r.*", "s.label_error")


def _sql() -> str:
    assigned = []
    for t in range(ROUNDS + 1):
        assigned.append(f"""a{t} AS (
  SELECT id, p, any_value(x) AS x, min(d) AS d, arg_min(e, d * 64 + e) AS e
  FROM (SELECT parts.id, parts.p, parts.x, c.e,
               list_sum(list_transform(range(1, len(parts.x) + 1), lambda i: (parts.x[i] - c.x[i]) * (parts.x[i] - c.x[i])))::BIGINT AS d
        FROM parts JOIN c{t} c ON c.p = parts.p)
  GROUP BY id, p)""")
        if t < ROUNDS:
            assigned.append(f"""c{t + 1} AS (
  SELECT c.p, c.e, CASE WHEN m.x IS NULL THEN c.x ELSE m.x END AS x
  FROM c{t} c LEFT JOIN (
    SELECT p, e, list(v ORDER BY i) AS x FROM (
      SELECT p, e, i, floor_div AS v FROM (
        SELECT p, e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
        FROM a{t}, unnest(range(1, len(x) + 1)) u(i) GROUP BY p, e, i)) GROUP BY p, e) m
  ON m.p = c.p AND m.e = c.e)""")
    steps = ",\n".join(assigned)
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x
  FROM kept, unnest(range({PARTS})) u(p)),
c0 AS (SELECT p, id AS e, x FROM parts WHERE id < {ENTRIES}),
{steps},
coded AS (
  SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY id),
digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, d.codebooks_sha256
FROM kept k JOIN coded c USING (id), digest d"""


@query("op12_vector_codes", _sql())
def op12_vector_codes(spark, folder: str) -> DataFrame:
    """Codes of all embeddings with the codebooks learnt from them."""
    coded, books = compress(table(spark, folder, "embeddings"))
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return with_label_error(coded).select(
        "vec_id", hexed.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
