"""Best-fit packing by minimum bin slack: each sequence takes the fullest feasible combination of lengths.

Documents are tokenized, ended by a separator and cut only where they exceed a sequence. Packing needs
nothing but the number of pieces of each length, at most ``capacity`` counts whatever the corpus holds:
the driver takes the longest length left, finds by a bitset subset sum over the available lengths the
combination that leaves the least slack, and uses it as often as the counts allow before it looks for the
next one. A plan is a few thousand combinations with their multiplicities. Pieces are then numbered
inside their length and look up their sequence and offset.

Scale: tokenizing is one pass over the texts; the driver reads the tokenizer's file and broadcasts it. Numbers
inside a length come from counts of (task, length), so a length that a third of all pieces share is never one
task. Only rows of a few numbers are shuffled.

Defined results: a null or empty text is one piece, the separator alone; repeated documents are packed one
by one; a document of exactly the capacity is one full sequence; an empty table gives an empty table.
Columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import query, table
from evidentia.operators.common import materialized

CAPACITY = 2048
CACHED_WORDS = 300_000
WORDS_AT_ONCE = 500_000
BYTES_AT_ONCE = 4 << 20

# Words that only the tokenizer may change: characters beyond U+024F, I with a dot (its lower case is two), special tokens.
_AS_IT_STANDS = "[^\x00-ɏ]|İ|<[|]"
# Letters up to U+024F before one of these marks: no token of the vocabulary's pattern spans the border.
_BORDER = "^(?P<stem>[a-zß-öø-ɏ]+)(?P<rest>[.,;:!?*$%&#](?s:.*))$"


class WordEncoder:
    """Token ids of texts as unsigned 32-bit numbers, with the words met last kept by.

    The vocabulary's pattern never spans white space, so a text is the sequence of its white-space
    separated words. Arrow splits and numbers the words of many texts at once; each distinct word is
    lower-cased, cut at its border into a stem and marks, and looked up; only stems and marks that are
    new to the worker reach the tokenizer, in one call. Two generations of ``cached`` entries are kept,
    so words in use survive when rare ones are forgotten.
    """

    def __init__(self, tokenizer, cached: int = CACHED_WORDS) -> None:
        self.tokenizer, self.cached = tokenizer, cached
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        ids = list(map(self.young.get, parts))
        missing = [i for i, k in enumerate(ids) if k is None]
        new = []
        for i in missing:
            ids[i] = self.old.get(parts[i])
            if ids[i] is None:
                new.append(i)
        for i, e in zip(new, self.tokenizer.encode_batch_fast([parts[i] for i in new], add_special_tokens=False) if new else []):
            ids[i] = np.array(e.ids, "<u4").tobytes()
        if len(self.young) + len(missing) > self.cached:
            self.old, self.young = self.young, {"": b""}
        self.young.update((parts[i], ids[i]) for i in missing)
        return ids

    def _parts(self, words: pa.StringArray) -> tuple[list[str], np.ndarray]:
        """Distinct stems and marks, and the two numbers of each word."""
        own = pc.match_substring_regex(words, _AS_IT_STANDS)
        lowered = pc.if_else(own, words, pc.utf8_lower(words))
        cut = pc.extract_regex(lowered, _BORDER)
        whole = pc.or_(own, pc.is_null(cut))
        stems = pc.if_else(whole, lowered, pc.struct_field(cut, "stem"))
        rests = pc.if_else(whole, "", pc.struct_field(cut, "rest"))
        parts = pa.concat_arrays([stems, rests]).dictionary_encode()
        return parts.dictionary.to_pylist(), parts.indices.to_numpy().reshape(2, -1).T

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text ends."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        parts, of_word = self._parts(words.dictionary)
        known = self._ids(parts)
        lengths = np.array([len(k) // 4 for k in known] or [0], np.int64)
        flat = np.frombuffer(b"".join(known), "<u4")
        starts = np.cumsum(lengths) - lengths
        places = words.indices.to_numpy()
        out, ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for at in range(0, len(places), WORDS_AT_ONCE):
            taken = of_word[places[at:at + WORDS_AT_ONCE]].ravel()
            size = lengths[taken]
            total = np.cumsum(size)
            step = np.repeat(starts[taken] - total + size, size) + np.arange(total[-1])
            out.append(flat[step])
            ends.append(total[1::2] + ends[-1][-1])
        after = np.concatenate(ends)  # ids up to and with each word
        return np.concatenate(out), after[np.cumsum(np.asarray(split.value_lengths(), np.int64))]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text or ""], pa.string()))[0].tobytes()


def _slices(texts: pa.StringArray, most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, pa.StringArray]]:
    """Runs of whole texts of about ``most`` bytes with the number of their first row."""
    group = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)) // most
    cuts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, texts.slice(a, b - a)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(model: str, name: str) -> WordEncoder:
    if name not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _ENCODERS[name] = WordEncoder(Tokenizer.from_str(model))
    return _ENCODERS[name]


PIECES = ("doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, block int, place bigint")


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text",
                     capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document; ``place`` numbers the pieces of one length inside a task's ``block``."""

    with open(tokenizer_path, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = _encoder(model.value, tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, keys = [], batch.column(0).to_pylist()
            for first, texts in _slices(pc.fill_null(batch.column(1), "")):
                ids, ends = encoder.encode_all(texts)
                for row, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist()), first):
                    document = ids[a:b].tobytes() + b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(document), 4 * capacity)):
                        part = document[at:at + 4 * capacity]
                        n = len(part) // 4
                        rows.append((keys[row], piece, at // 4, n, zlib.crc32(part), block, int(seen[n])))
                        seen[n] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "place"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of the available lengths whose sum is as large as fits into ``room``."""
    reach, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & limit
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            total -= length * copies
            chosen[length] = chosen.get(length, 0) + copies
    return list(chosen.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(lengths with copies, number of sequences)]; every piece is used once."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = dict(fullest(left, capacity - longest))
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[n] // k for n, k in combination.items())
        out.append((sorted(combination.items(), reverse=True), times))
        for n, k in combination.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def _places(combinations: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first number, first sequence, copies a sequence, first offset)."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for combination, times in combinations:
        offset = 0
        for n, k in combination:
            rows.setdefault(n, []).append((used.get(n, 0), sequence, k, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with ``length``, ``block`` and ``place``."""
    counts = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = pieces.sparkSession.sparkContext.broadcast(_places(plan(totals, capacity)))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = pieces.join(offsets, ["length", "block"]).select(*kept, (F.col("ahead") + F.col("place")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at, rows = np.nonzero(length == n)[0], places.value[int(n)]
                row = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1]
                turn = number[at] - row[:, 0]
                sequence[at] = row[:, 1] + turn // row[:, 2]
                offset[at] = row[:, 3] + turn % row[:, 2] * n
            columns = [batch.column(k) for k in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, kept + ["sequence_id", "offset"])

    return numbered.mapInArrow(run, "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, store the pieces in the shared folder and pack them."""
    return pack(materialized(tokenized_pieces(docs, tokenizer_path, capacity=capacity), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, folder: str) -> DataFrame:
    """Every document in sequences of 2,048 tokens."""
    return pack_documents(table(spark, folder, "documents"), default_tokenizer()).withColumn(
        "length", F.col("length").cast("long"))
