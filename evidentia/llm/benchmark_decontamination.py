"""Benchmark decontamination: a positional inverted index of the training tokens, searched for test phrases.

``build_index`` stores one row per segment of documents: the sorted terms, the start of each posting
list, and every token position of every term. Positions count through the segment, with a gap between
documents wider than any phrase. ``search`` reads segments one at a time. For all test windows at once
it takes the posting list of the rarest term, moves it by the term's offset, and keeps the starts that
the list of the next rarest term also holds, until all terms agree: an exact phrase match. Starts that
fail this but have the rarest terms within ``slop`` positions are proximity matches.

Scale: the index is split by document, so neither postings nor texts are shuffled, a segment is bounded
by its number of tokens (one document at least), and a frequent passage only adds rows where it occurs.
Every segment sees the benchmark, in blocks of bounded size which are read one by one from the driver's
broadcast; a larger benchmark means more blocks, not larger ones. The index is stored and read in row groups of
a few segments, however many a file holds, and windows are compared in turns of bounded postings.

Defined results: a null or empty text has no words and no hits; an item without words has no windows, one
with fewer words than the window has a single window of all of them; repeated documents are reported one
by one, repeated items count once each; an empty benchmark hits nothing; an empty corpus gives an empty
table. Input columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import query, table
from evidentia.operators.common import materialized

WINDOW = 10
SLOP = 20
SEGMENT_TOKENS = 1_000_000
BLOCK_WINDOWS = 50_000
CANDIDATES = 1 << 20  # postings of rarest terms that are compared at once
GROUP_SEGMENTS = 8  # segments that are written, and read again, at once

INDEX_SCHEMA = ("ids array<bigint>, starts array<bigint>, lengths array<bigint>, terms array<binary>, "
                "list_starts array<bigint>, postings array<int>")

_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters from U+0080 on, with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split(b" ") if text else []


def _tokens(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


class _Segment:
    """Documents of one segment while they are collected."""

    def __init__(self, gap: int) -> None:
        self.gap, self.vocabulary, self.parts = gap, {}, []
        self.ids, self.starts, self.lengths, self.end = [], [], [], 0

    def add(self, doc_id: int | None, tokens: list[bytes]) -> None:
        number = self.vocabulary
        codes = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, len(tokens))
        self.parts.append((codes << 32) | np.arange(self.end, self.end + len(tokens)))
        self.ids.append(doc_id)
        self.starts.append(self.end)
        self.lengths.append(len(tokens))
        self.end += len(tokens) + self.gap

    def row(self) -> dict:
        keys = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        names = list(self.vocabulary)
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        keys = np.sort((rank[keys >> 32] << 32) | (keys & 0xFFFFFFFF)) if len(keys) else keys
        return {
            "ids": self.ids, "starts": self.starts, "lengths": self.lengths, "terms": [names[i] for i in order],
            "list_starts": np.searchsorted(keys, np.arange(len(names) + 1, dtype=np.int64) << 32),
            "postings": (keys & 0xFFFFFFFF).astype(np.int32)}


def _index_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
             ("terms", pa.list_(pa.binary())), ("list_starts", pa.list_(pa.int64())), ("postings", pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], [n for n, _ in kinds])


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                segment_tokens: int = SEGMENT_TOKENS, gap: int = 1024) -> DataFrame:
    """One row per segment. ``gap`` must exceed the longest phrase and proximity that is searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _Segment(gap)
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment.add(doc_id, _tokens(body.as_py()))
                if segment.end >= segment_tokens:
                    yield _index_batch([segment.row()])
                    segment = _Segment(gap)
        if segment.ids:
            yield _index_batch([segment.row()])

    narrow = docs.select(F.col(id_column).cast("long"), F.col(text).cast("string"))
    return narrow.mapInArrow(run, INDEX_SCHEMA)


class Windows:
    """Test windows as rows of term numbers; shorter windows are padded with -1. Rows are made when they are asked
    for, as a worker keeps the terms of every block that it has read."""

    def __init__(self, items: list[tuple], size: int = WINDOW) -> None:
        number: dict[bytes, int] = {}
        self.items, self.size = [str(i) for i, _ in items], size
        stream, starts, owner = [], [], []
        for at, (_, text) in enumerate(items):
            codes = [number.setdefault(t, len(number)) for t in _tokens(text)]
            if not codes:
                continue
            windows = max(1, len(codes) - size + 1)
            starts += range(len(stream), len(stream) + windows)
            owner += [at] * windows
            stream += codes + [-1] * (size - len(codes))
        self.terms = list(number)
        self.stream, self.starts, self.owner = (np.array(x, np.int32) for x in (stream, starts, owner))

    @property
    def codes(self) -> np.ndarray:
        return self.stream[self.starts[:, None] + np.arange(self.size)].astype(np.int64).reshape(-1, self.size)


def _lookup(terms: list[bytes], wanted: list[bytes]) -> np.ndarray:
    """Place of each wanted term in the sorted terms of a segment, or -1."""
    place = dict(zip(terms, range(len(terms))))
    return np.array([place.get(t, -1) for t in wanted], np.int64)


def match_windows(windows: Windows, terms: list[bytes], list_starts: np.ndarray, postings: np.ndarray,
                  slop: int = SLOP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact matches (window, start) and proximity matches (window, position) in one segment."""
    none = np.zeros(0, np.int64)
    if not len(windows.starts) or not len(terms):
        return none, none, none, none
    local = np.append(_lookup(terms, windows.terms), -2)[windows.codes]  # -2: padding, -1: not in this segment
    keep = np.nonzero((local != -1).all(axis=1))[0]
    local = local[keep]
    sizes = np.append(np.diff(list_starts), [0, 0])
    count = np.where(local >= 0, sizes[local], np.iinfo(np.int64).max)
    order = np.argsort(count, axis=1, kind="stable")
    filled = (local >= 0).sum(axis=1)
    keys = (np.repeat(np.arange(len(terms), dtype=np.int64), sizes[:-2]) << 32) | postings

    def held(term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = (term << 32) | position
        at = np.searchsorted(keys, want)
        return (keys[np.minimum(at, len(keys) - 1)] == want) & (position >= 0)

    def matched(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        # The rarest term's list, moved by its offset.
        first = order[rows, 0]
        rare = local[rows, first]
        n = sizes[rare]
        window = np.repeat(rows, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        anchor = postings[np.repeat(list_starts[rare], n) + inside].astype(np.int64)
        start = anchor - order[window, 0]
        live = np.ones(len(window), bool)
        near = np.ones(len(window), bool)
        for k in range(1, local.shape[1]):
            offset = order[window, k]
            term = local[window, offset]
            asked = np.nonzero(live & (k < filled[window]))[0]
            live[asked] = held(term[asked], start[asked] + offset[asked])
            if k <= 2:  # proximity: the three rarest terms around the rarest one
                asked = np.nonzero(near & (k < filled[window]))[0]
                at = np.searchsorted(keys, (term[asked] << 32) | np.maximum(anchor[asked] - slop, 0))
                found = keys[np.minimum(at, len(keys) - 1)]
                near[asked] = (at < len(keys)) & (found >> 32 == term[asked]) & ((found & 0xFFFFFFFF) <= anchor[asked] + slop)
        near &= ~live & (filled[window] > 1)
        return keep[window[live]], start[live], keep[window[near]], anchor[near]

    if not len(keep):
        return none, none, none, none
    # Windows are taken together while their rarest lists hold few postings.
    rows = np.arange(len(keep))
    turn = np.cumsum(sizes[local[rows, order[:, 0]]]) // CANDIDATES
    found = [matched(part) for part in np.split(rows, np.nonzero(np.diff(turn))[0] + 1)]
    return tuple(np.concatenate(part) for part in zip(*found))


RESULT = ("doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, n_near bigint")


def search(index: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text",
           window: int = WINDOW, slop: int = SLOP, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per indexed document: its words, words hit by exact windows, items found, proximity matches."""
    spark = index.sparkSession
    blocks, held, size = [], [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).toLocalIterator():
        held.append((row[0], row[1]))
        size += max(1, len(row[1] or "") // 4)
        if size >= block_windows:
            blocks.append(spark.sparkContext.broadcast(Windows(held, window)))
            held, size = [], 0
    if held or not blocks:
        blocks.append(spark.sparkContext.broadcast(Windows(held, window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield _report(batch.slice(r, 1))

    def _report(row: pa.RecordBatch) -> pa.RecordBatch:
        def array(name):
            return row.column(name)[0].values.to_numpy(zero_copy_only=False)

        ids, starts, lengths = row.column("ids")[0].as_py(), array("starts"), array("lengths")
        terms, list_starts, postings = row.column("terms")[0].as_py(), array("list_starts"), array("postings")
        n_hit, n_near = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        items: list[set] = [set() for _ in ids]
        total = int(starts[-1] + lengths[-1]) if len(ids) else 0
        marks = np.zeros(total + 1, np.int64)
        for block in blocks:
            w = block.value
            hit, start, near, anchor = match_windows(w, terms, list_starts, postings, slop)
            if len(hit):
                width = (w.codes >= 0).sum(axis=1)[hit]
                np.add.at(marks, start, 1)
                np.add.at(marks, start + width, -1)
                doc = np.searchsorted(starts, start, side="right") - 1
                for d, i in set(zip(doc.tolist(), w.owner[hit].tolist())):
                    items[d].add(w.items[i])
            if len(near):
                np.add.at(n_near, np.searchsorted(starts, anchor, side="right") - 1, 1)
        covered = np.append(0, np.cumsum(np.cumsum(marks)[:total] > 0))
        n_hit = covered[starts + lengths] - covered[starts] if len(ids) else n_hit
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(n_hit, pa.int64()),
             pa.array([len(i) for i in items], pa.int64()), pa.array([sorted(i) for i in items], pa.list_(pa.string())),
             pa.array(n_near, pa.int64())],
            ["doc_id", "n_words", "n_hit", "n_items", "items", "n_near"])

    return index.mapInArrow(run, RESULT)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Store the index of the documents in the shared folder and search it."""
    index = materialized(build_index(docs), "positional-index", GROUP_SEGMENTS)
    return search(index, benchmark, window=window, slop=slop)


def items_digest(items: list[str] | None) -> str:
    return hashlib.sha256(",".join(items or []).encode()).hexdigest()


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "n_near")
