"""MinHash near-dedup by an inverted join over signature coordinates.

Each distinct shingle set gets ``COORDINATES`` minima. A document is posted under every (coordinate, value)
that another one shares. Similar sets agree in at least ``match_threshold`` coordinates, so it is enough to
post a document under its rarest shared values, all but (threshold - 1) of them (prefix filter), and not at
all if it shares fewer values than the threshold. Each posting list is merged once: its most connected
documents lead, every other one attaches to the leaders it agrees with and is skipped for all the rest, so
a list of many near copies gives one pair a member, not one a pair.

A leader's group is then decided on full shingle sets: members against the leader, and members among each
other where shingles outside the leader allow a link at all. Links inside a group are reported as a tree.
Connected components of all links are found by rounds of large and small stars.

Scale: equal sets collapse first, so copies cost one row. Minima, postings and trees are linear in the
documents; groups are cut into blocks of bounded size, compared block by block when there are several.
Texts move compressed, and
those outside all groups are left out by a Bloom filter of at most 16 MB (beyond some 100 million grouped
documents it lets more texts through, which the join then drops). Work on members among each other is a comparison
with the block for each member that the bounds leave open; a group whose members are mutually close but far
from their leader is the costly case, and it is quadratic in blocks. Minima miss a link with a probability
of about one in a million (five standard deviations at the similarity limit).

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing;
texts with fewer words than a shingle have one shingle; repeated rows are equal sets and so linked; rows with
one id and different texts are sets of their own, linked only if they are similar; rows with null ids take part
like all others, and a component is named by its smallest id, or by null if it has none; an empty table gives an
empty table. Columns other than id and text are ignored. Rows and sets are told apart by 64-bit hashes of id and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import query, table, text_or_empty
from evidentia.operators.common import materialized

COORDINATES = 64
GROUP_MATCHES = 6  # agreement from which documents of one list are compared
LEAD_MATCHES = COORDINATES // 2  # agreement from which a document needs no group of its own
BLOCK_SHINGLES = 4_000_000
COLUMNS = 1 << 15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _numbers(first: int, n: int) -> np.ndarray:
    return _mix(np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BYTES = _numbers(1, 256)
_WORDS = _numbers(1_000, 64) | np.uint64(1)
_TIMES = (_numbers(2_000, COORDINATES) | np.uint64(1))[:, None]
_PLUS = _numbers(3_000, COORDINATES)[:, None]
_BASE = 0x9E3779B97F4A7C15
_POWERS = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _powers(sign: int, n: int) -> np.ndarray:
    """Powers of the base (or of its inverse) modulo 2**64."""
    if len(_POWERS[sign]) < n:
        base = _BASE if sign > 0 else pow(_BASE, -1, 1 << 64)
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        _POWERS[sign] = np.cumprod(factors)
    return _POWERS[sign][:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each white-space separated word, A-Z in lower case."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    sums = np.append(np.uint64(0), np.cumsum(_BYTES[data] * _powers(1, len(data))))
    if not len(start):
        return np.zeros(0, np.uint64)
    return _mix((sums[end] - sums[start]) * _powers(-1, len(data))[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    total = np.full(n, min(size, len(w)), np.uint64)
    for k in range(min(size, len(w))):
        total += w[k:k + n] * _WORDS[k]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of every coordinate's permutation, as 32-bit numbers."""
    out = np.full(COORDINATES, (1 << 32) - 1, np.uint64)
    for at in range(0, len(hashes), COLUMNS):
        out = np.minimum(out, ((hashes[None, at:at + COLUMNS] * _TIMES + _PLUS) >> np.uint64(32)).min(axis=1))
    return out


def match_threshold(percent: int) -> int:
    """Coordinates that sets of the given similarity share, less five standard deviations."""
    p = percent / 100
    return max(1, math.floor(COORDINATES * p - 5 * math.sqrt(COORDINATES * p * (1 - p))))


SIGNED = "doc_id bigint, key bigint, n_shingles bigint, h1 bigint, h2 bigint, values array<bigint>, marks binary"


def row_key(id_column: str = "doc_id", text: str = "text") -> Column:
    """Hash of id and text of a row; null ids and texts are values of their own."""
    return F.xxhash64(F.col(id_column).isNull(), F.col(id_column).cast("long"), F.col(text).cast("string"))


def sign(docs: DataFrame, size: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, size and digest of its set, the (coordinate, value) numbers, one byte of each value."""
    coordinate = np.arange(COORDINATES, dtype=np.int64) << 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, values, marks = [], [], [], [], []
            for body in batch.column(2):
                s = shingles(body.as_py(), size)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                h1.append(int.from_bytes(digest[:8], "big", signed=True))
                h2.append(int.from_bytes(digest[8:], "big", signed=True))
                v = signature(s)
                values.append((coordinate | v.astype(np.int64)) if len(s) else [])
                marks.append((v & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(values, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["doc_id", "key", "n_shingles", "h1", "h2", "values", "marks"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), row_key(id_column, text).alias("key"),
                       F.col(text).cast("string")).mapInArrow(run, SIGNED)


def postings(sets: DataFrame, least: int) -> DataFrame:
    """(value, node, shared, marks): each set under its rarest shared values. ``sets``: node, values, marks."""
    flat = sets.select("node", F.explode("values").alias("value"))
    often = flat.groupBy("value").count().filter("count > 1")
    # At most COORDINATES values a set.
    shared = flat.join(often, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("of"))
    prefix = shared.withColumn("shared", F.size("of")).filter(F.col("shared") >= least)
    prefix = prefix.withColumn("of", F.slice("of", F.lit(1), F.col("shared") - least + 1))
    return prefix.join(sets.select("node", "marks"), "node").select("node", "shared", "marks", F.explode("of.value").alias("value"))


def merge_lists(posted: DataFrame) -> DataFrame:
    """Distinct (hub, node): every posting list merged around its leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, leaders, marks = None, [], np.zeros((0, COORDINATES), np.uint8)
        for batch in batches:
            pairs = []
            for v, node, own in zip(*(batch.column(n).to_pylist() for n in ("value", "node", "marks"))):
                mine = np.frombuffer(own, np.uint8)
                if v != value:
                    value, leaders, marks = v, [], np.zeros((0, COORDINATES), np.uint8)
                agree = (marks == mine).sum(axis=1)
                for k in np.nonzero(agree >= GROUP_MATCHES)[0].tolist():
                    pairs.append((leaders[k], node))
                if not len(agree) or agree.max() < LEAD_MATCHES:
                    leaders.append(node)
                    marks = np.vstack([marks, mine])
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["hub", "node"])

    ordered = posted.repartition("value").sortWithinPartitions("value", F.desc("shared"), "node")
    return ordered.mapInArrow(run, "hub bigint, node bigint").filter("hub != node").distinct()


def _linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def link_group(hub: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Tree of the links among the hub (number -1) and the sets of its group."""
    parent = list(range(len(sets) + 1))  # the last one is the hub

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            tree.append((i, j if j < len(sets) else -1))

    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(sizes):
        return tree
    ends = np.cumsum(sizes)
    starts = ends - sizes
    everything = np.concatenate(sets)
    at = np.minimum(np.searchsorted(hub, everything), len(hub) - 1)
    in_hub = hub[at] == everything
    with_hub = np.add.reduceat(in_hub, starts, dtype=np.int64)
    to_hub = _linked(with_hub, sizes, np.int64(len(hub)), percent)
    for i in np.nonzero(to_hub)[0].tolist():
        join(i, len(sets))
    # A set without a link to the hub can only reach members that share enough of what others hold too.
    rest, inverse, count = np.unique(everything, return_inverse=True, return_counts=True)
    held = np.add.reduceat(count[inverse] > 1, starts, dtype=np.int64)
    most = np.maximum(held, with_hub)
    largest = most * (100 + percent) // percent - sizes  # of a partner, if all of that is common
    for i in np.nonzero(~to_hub & (100 * largest >= percent * sizes))[0].tolist():
        near = (sizes <= largest[i]) & (100 * sizes >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes) & (
            np.minimum(most, most[i]) * (100 + percent) >= percent * (sizes + sizes[i]))
        near[i] = False
        others = np.nonzero(near)[0]
        if not len(others):
            continue
        picked = np.concatenate([sets[j] for j in others.tolist()])
        own = sets[i]
        hit = own[np.minimum(np.searchsorted(own, picked), len(own) - 1)] == picked
        first = np.cumsum(sizes[others]) - sizes[others]
        common = np.add.reduceat(hit, first, dtype=np.int64)
        for j in others[_linked(common, sizes[others], sizes[i], percent)].tolist():
            join(i, j)
    return tree


def verify_groups(groups: DataFrame, sets: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b), as trees, found on full sets. ``groups``: hub, node; ``sets``: node, n_shingles; ``texts``: node, body."""
    sized = groups.join(sets.select("node", "n_shingles"), "node")
    blocks = sized.groupBy("hub").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = sized.join(blocks, "hub").select("hub", "node", "blocks", own.alias("own"), other.alias("other")).select(
        "hub", "node", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    hubs = members.select("hub", "low", "high").distinct().select("hub", F.col("hub").alias("node"), "low", "high")
    rows = hubs.unionByName(members).join(texts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        current, hub, nodes, sets_ = None, None, [], []

        def links() -> pa.RecordBatch:
            tree = link_group(hub, sets_, percent) if hub is not None else []
            name = lambda i: current[0] if i < 0 else nodes[i]
            return pa.RecordBatch.from_arrays([pa.array([name(i) for i, _ in tree], pa.int64()),
                                               pa.array([name(j) for _, j in tree], pa.int64())], ["a", "b"])

        for batch in batches:
            for h, node, low, high, body in zip(*(batch.column(n).to_pylist() for n in ("hub", "node", "low", "high", "body"))):
                if (h, low, high) != current:
                    if current is not None:
                        yield links()
                    current, hub, nodes, sets_ = (h, low, high), None, [], []
                s = shingles(unpack.decompress(body).decode("utf-8", "surrogatepass"), size)
                if node == h and hub is None:
                    hub = s
                else:
                    nodes.append(node)
                    sets_.append(s)
        if current is not None:
            yield links()

    ordered = rows.repartition("hub", "low", "high").sortWithinPartitions("hub", "low", "high", F.col("node") != F.col("hub"))
    return ordered.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link, by large and small stars."""
    edges = materialized(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialized(small.filter("u != v").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, its key, n_shingles, component (a number, null for an empty set) and component_id, the smallest id in it."""
    signed = materialized(sign(docs, size, id_column, text), "signed")
    sets = signed.filter("n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("key").alias("node"), F.min("doc_id").alias("name"), F.first("n_shingles").alias("n_shingles"),
        F.first("values").alias("values"), F.first("marks").alias("marks"))
    sets = materialized(sets, "sets")
    groups = materialized(merge_lists(postings(sets, match_threshold(percent))), "groups")
    used = groups.select("hub").union(groups.select("node")).toDF("node").distinct()
    texts = _packed(docs.select(row_key(id_column, text).alias("node"), text_or_empty(docs, text).alias("text")), used)
    links = verify_groups(groups, sets, texts, size, percent)
    # The smallest node of a component has no row there.
    linked = sets.select("h1", "h2", "node", "name").join(components(links), "node", "left")
    linked = materialized(linked.select("h1", "h2", F.coalesce("component", "node").alias("component"), "name"), "components")
    names = linked.groupBy("component").agg(F.min("name").alias("least"))
    named = linked.join(names, "component").select("h1", "h2", "component", F.col("least").alias("name"))
    return signed.join(named, ["h1", "h2"], "left").select(
        "doc_id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"),
        F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


MOST_BITS = 1 << 27


def _places(node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(node.astype(np.uint64))
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of the nodes, 16 MB at most: 64-bit words, folded on the cluster before they are collected."""
    bits = min(MOST_BITS, 1 << max(16, (16 * nodes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(batch.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    words = nodes.mapInArrow(run, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _packed(texts: DataFrame, used: DataFrame) -> DataFrame:
    """Compressed texts of the used nodes: most others are left out before the shuffle, the rest by the join."""
    shared = texts.sparkSession.sparkContext.broadcast(_bitmap(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, words = zstandard.ZstdCompressor(level=3), shared.value
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            held = np.ones(batch.num_rows, bool)
            for at in _places(batch.column(0).to_numpy(), 64 * len(words)):
                held &= (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) == 1
            batch = batch.filter(pa.array(held))
            bodies = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["node", "body"])

    return texts.mapInArrow(run, "node bigint, body binary").join(used, "node", "left_semi")


@query("op4_minhash_dedup")
def op4_minhash_dedup(spark, folder: str) -> DataFrame:
    """Three-word shingles, similarity of 85 percent, all documents."""
    found = near_duplicates(table(spark, folder, "documents"), size=3, percent=85)
    return found.drop("key", "component").withColumn("kept", F.col("doc_id") == F.col("component_id"))
