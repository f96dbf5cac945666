"""Term index over chunks and metadata rows, and bounded BM25 search (many queries per job).

Title, aliases, tags, source and questions are the same for all chunks of a metadata row, so their terms are
posted once per distinct row (``fields``), and only body terms per chunk. A query's score for a chunk is its
body score plus the boost of the chunk's row. Boosts are summed per query and row; chunks meet them only if
they have a body hit or are among the first ``per`` ids of their row, since any other chunk of the row follows
at least ``per`` chunks of its source that score as much. Scored rows are therefore at most the body hits read
plus ``per`` for each boosted row.

A stored index also holds posting blocks: postings of one term and similar length, with the shortest length as
the bound of what any of them can score. A search first reads the blocks with the highest bounds of each query
and takes the score of the last place as a limit; then it reads only blocks that could still reach the limit,
and keeps only chunks met in a block whose term and all weaker ones together could. Blocks hold numbers for their
chunks and belong to segments of chunks, so a chunk's hits are added up where they are read, and ids are joined
only to the best chunks of each source.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.config import BM25_B, BM25_K, RetrievalConfig
from evidentia.functions import text
from evidentia.operators.common import materialized, top_per

# Score added once per matching term or phrase of a field.
FIELD_BOOSTS = {"title": 1.5, "alias": 1.75, "tag": 1.25, "source": 1.0, "question": 3.0}
PHRASE_BOOSTS = {"title": 6.0, "alias": 6.0, "source": 4.0}
FULL_ALIAS_BOOST = 1.0

PHRASE_MARK = "\u0001"
QUESTION_MARK = "\u0002"
SEPARATOR = "\u0003"
SCORE_DIGITS = 9

FIRST_IDS = 8       # ids kept per metadata row; searches that allow more per source read them from the chunks
BLOCK_POSTINGS = 256
SEGMENT_CHUNKS = 4096
OPENING_BLOCKS = 256  # blocks per query that set its limit
SLACK = 1e-6

_METADATA = ["source_id", "scope", "title", "aliases", "tags", "question_aliases"]


@dataclass(frozen=True)
class LexicalIndex:
    """``chunks(chunk_id, row_id, source_id, scope, body_length, body_terms)``,
    ``rows(row_id, source_id, scope, first_ids)``, ``fields(row_id, source_id, scope, field, key)`` and one-row
    ``stats(n, average)``; ``frequency(key, df)``, ``blocks`` and the chunks' ``number`` where they have been stored."""

    chunks: DataFrame
    rows: DataFrame
    fields: DataFrame
    stats: DataFrame
    frequency: DataFrame | None = None
    blocks: DataFrame | None = None

    def postings(self) -> DataFrame:
        """(chunk_id, row_id, source_id, scope, body_length, key), one row per distinct body term."""
        return self.chunks.select("chunk_id", "row_id", "source_id", "scope", "body_length", F.explode("body_terms").alias("key"))

    def frequency_of(self, vocabulary: DataFrame) -> DataFrame:
        """Document frequency of the given keys; only their rows are counted."""
        if self.frequency is not None:
            return self.frequency.join(vocabulary, "key", "left_semi")
        return document_frequency(self.postings().join(vocabulary, "key", "left_semi"))

    def write(self, path: str, block: int = BLOCK_POSTINGS) -> None:
        """Store the index. Fields and frequencies are clustered by key. Blocks are written per segment, sorted by
        key, so key statistics prune pages; a hot key has blocks in every segment."""
        numbered = _numbered(self.chunks)
        for name, frame, keys in (("chunks", numbered, []), ("rows", self.rows, []), ("fields", self.fields, ["key", "row_id"]),
                                  ("stats", self.stats, []), ("frequency", document_frequency(self.postings()), ["key"])):
            if keys:
                frame = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
            frame.write.mode("overwrite").parquet(f"{path}/{name}")
        stored = self.chunks.sparkSession.read.parquet(f"{path}/chunks")
        segments = -(-self.stats.first()["n"] // SEGMENT_CHUNKS) or 1
        blocks = posting_blocks(stored, segments, block).sortWithinPartitions("key", "shortest")
        blocks.withColumn("block", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/blocks")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "LexicalIndex":
        names = ("chunks", "rows", "fields", "stats", "frequency", "blocks")
        return LexicalIndex(*[spark.read.parquet(f"{path}/{t}") for t in names])


def _entry(field: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(field).alias("field"), k.alias("key")))


def _folded(parts: Column) -> Column:
    """Fold many short texts in one call, as a UDF cannot run inside a higher-order function."""
    return text.fold(F.array_join(parts, SEPARATOR))


def described(chunks: DataFrame, questions: bool = False) -> DataFrame:
    """Chunks with their distinct body terms and the metadata that makes their row."""
    scope = F.coalesce("project_id", F.lit("")) if "project_id" in chunks.columns else F.lit("")
    asked = F.col("question_aliases") if questions else F.array().cast("array<string>")
    terms = text.build_terms(F.col("text"))
    rows = chunks.select(F.col("id").alias("chunk_id"), "source_id", scope.alias("scope"), "title", "aliases", "tags",
                         asked.alias("question_aliases"), terms.alias("body_terms"))
    row_id = F.unhex(F.md5(F.to_json(F.struct(*_METADATA), {"ignoreNullFields": "false"})))
    return rows.select("*", row_id.alias("row_id"), F.greatest(F.size("body_terms"), F.lit(1)).alias("body_length"))


def each_term() -> Column:
    """One row per body term. More than a bare column: the filter that Spark infers for one would tokenize the
    texts a second time, in the tasks that read them."""
    return F.explode(F.coalesce("body_terms", F.slice("body_terms", 1, 0)))


def field_terms(rows: DataFrame) -> DataFrame:
    """(row_id, source_id, scope, field, key) of the terms and phrases of each metadata row."""
    folded = rows.select(
        "row_id", "source_id", "scope", text.fold(F.col("title")).alias("_title"), _folded(F.col("aliases")).alias("_aliases"),
        text.fold(F.array_join("tags", " ")).alias("_tags"), text.fold(F.col("source_id")).alias("_source"),
        _folded(F.col("question_aliases")).alias("_questions"))

    def phrases(parts: Column, mark: str) -> Column:
        kept = F.array_distinct(F.filter(parts, lambda p: p != ""))
        return F.transform(kept, lambda p: F.concat(F.lit(mark), p))

    def each(column: str, normalize) -> Column:
        return F.transform(F.split(column, SEPARATOR), normalize)

    keys = [_entry(field, text.build_terms_folded(F.col(column))) for field, column in (
        ("title", "_title"), ("alias", "_aliases"), ("tag", "_tags"), ("source", "_source"), ("question", "_questions"))]
    keys += [
        _entry("title", phrases(F.array(text.strip_phrase(F.col("_title"))), PHRASE_MARK)),
        _entry("alias", phrases(each("_aliases", text.strip_phrase), PHRASE_MARK)),
        _entry("source", phrases(F.array(text.strip_phrase(F.col("_source"))), PHRASE_MARK)),
        _entry("question", phrases(each("_questions", text.normalize_query_folded), QUESTION_MARK)),
    ]
    return folded.select("row_id", "source_id", "scope", F.inline(F.concat(*keys)))


def first_ids(members: DataFrame, per: int) -> DataFrame:
    """(row_id, first_ids): the smallest ``per`` chunk ids of each row, cut per task before any shuffle."""
    first = top_per(members.select("row_id", "chunk_id"), ["row_id"], [F.col("chunk_id")], per, "_r")
    return first.groupBy("row_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("first_ids"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """Chunks per body term; each chunk counts a term once."""
    return postings.groupBy("key").agg(F.count(F.lit(1)).alias("df"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        F.col("id").alias("chunk_id"),
        F.greatest(F.size(text.build_terms(F.col("text"))), F.lit(1)).alias("body_length"),
    )


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: chunk count and mean body length, at least 1."""
    return lengths.agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.lit(1.0), F.coalesce(F.avg("body_length"), F.lit(1.0))).alias("average"),
    )


def lexical_index(chunks: DataFrame, questions: bool = False) -> LexicalIndex:
    """Tokenize the chunks once; metadata rows are folded and posted once each."""
    stored = materialized(described(chunks, questions), "index-chunks")
    rows = stored.select("row_id", *_METADATA).distinct()
    firsts = materialized(first_ids(stored, FIRST_IDS), "index-first-ids")
    fields = materialized(field_terms(rows), "index-fields")
    return LexicalIndex(
        stored.drop("title", "aliases", "tags", "question_aliases"),
        rows.select("row_id", "source_id", "scope").join(firsts, "row_id"), fields,
        materialized(corpus_stats(stored), "index-stats"))


def _numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with a ``number`` for their id, the same for chunks of the same id and for no others."""
    for seed in itertools.count():
        number = F.xxhash64("chunk_id", F.lit(seed))
        ids = chunks.select("chunk_id", number.alias("number")).groupBy("number").agg(
            F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"))
        if ids.filter("low <> high").isEmpty():
            return chunks.withColumn("number", number)


def posting_blocks(chunks: DataFrame, segments: int, most: int = BLOCK_POSTINGS) -> DataFrame:
    """(key, shortest, postings) with at most ``most`` postings of one term and segment a block, shortest first.

    Chunks are dealt to segments before their terms are taken apart, so postings are never shuffled and a term's
    list is at most a segment long.
    """
    segment = F.pmod(F.xxhash64("number"), F.lit(segments)).cast("int")
    dealt = chunks.select(segment.alias("_segment"), "number", "row_id", "body_length", "body_terms").repartition(segments, "_segment")
    lists = dealt.select("_segment", F.explode("body_terms").alias("key"), "body_length", "number", "row_id").groupBy("_segment", "key").agg(
        F.array_sort(F.collect_list(F.struct("body_length", "number", "row_id"))).alias("_all"))
    starts = F.sequence(F.lit(1), F.size("_all"), F.lit(most))
    cut = lists.select("key", F.explode(F.transform(starts, lambda i: F.slice("_all", i, most))).alias("postings"))
    return cut.select("key", F.get("postings", F.lit(0))["body_length"].alias("shortest"), "postings")


def query_keys(queries: DataFrame) -> DataFrame:
    """Search terms and whole-query phrases of each query, one row per key.

    Queries without any letter or number yield nothing.
    """
    folded = queries.select(
        "query_id", text.fold(F.col("query")).alias("_folded")
    ).select(
        "query_id",
        text.search_terms(text.build_terms_folded(F.col("_folded"))).alias("_terms"),
        text.strip_phrase(F.col("_folded")).alias("_phrase"),
        text.normalize_query_folded(F.col("_folded")).alias("_question"),
    ).filter("_phrase <> ''")
    keys = F.concat(
        "_terms",
        F.array(F.concat(F.lit(PHRASE_MARK), "_phrase"), F.concat(F.lit(QUESTION_MARK), "_question")),
    )
    return folded.select("query_id", F.size("_terms").alias("n_terms"), F.explode(keys).alias("key"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(idf_value: Column, length: Column, average: Column) -> Column:
    norm = 1 - BM25_B + BM25_B * (length / average)
    return idf_value * (BM25_K + 1) / (1 + BM25_K * norm)


def weighted_keys(keys: DataFrame, index: LexicalIndex) -> DataFrame:
    """Attach the inverse document frequency to each query key."""
    vocabulary = keys.select("key").distinct()
    stats = index.stats.select(F.struct("n", "average")).scalar()
    weights = vocabulary.join(index.frequency_of(vocabulary), "key", "left").select(
        "key",
        stats["average"].alias("average"),
        F.when(F.col("df") > 0, idf(stats["n"], F.col("df"))).alias("idf"), "df",
    )
    return keys.join(weights, "key")


def _is_phrase() -> Column:
    return F.col("key").startswith(PHRASE_MARK)


def _is_question() -> Column:
    return F.col("key").startswith(QUESTION_MARK)


def _on(keys: DataFrame) -> list[str]:
    """Keys with a ``scope`` meet only the entries of that project."""
    return ["key", "scope"] if "scope" in keys.columns else ["key"]


def body_hits(weighted: DataFrame, index: LexicalIndex) -> DataFrame:
    """One row per query, chunk and matching body term with its weight."""
    hits = index.postings().join(weighted.filter("idf IS NOT NULL"), _on(weighted))
    return hits.select("query_id", "chunk_id", "row_id", "source_id",
                       bm25_weight(F.col("idf"), F.col("body_length"), F.col("average")).alias("weight"))


def field_hits(keys: DataFrame, index: LexicalIndex) -> DataFrame:
    """One row per query, metadata row and matching (field, key) with its weight."""
    of = lambda table: F.coalesce(*[F.when(F.col("field") == name, F.lit(value)) for name, value in table.items()])
    weight = F.when(_is_question(), F.lit(0.0)).when(_is_phrase(), of(PHRASE_BOOSTS)).otherwise(of(FIELD_BOOSTS))
    return index.fields.join(keys, _on(keys)).select(
        "query_id", "row_id", "source_id", "n_terms", "field", "key", weight.alias("weight"),
        (_is_phrase() | _is_question()).alias("is_phrase"))


def bm25(keys: DataFrame, index: LexicalIndex) -> DataFrame:
    """Binary BM25 alone, per query and chunk."""
    hits = body_hits(materialized(weighted_keys(keys, index), "weighted-keys"), index)
    return hits.groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score"))


def field_boosts(keys: DataFrame, index: LexicalIndex) -> DataFrame:
    """Metadata term boosts alone, per query and metadata row."""
    hits = field_hits(keys, index).filter("NOT is_phrase")
    return hits.groupBy("query_id", "row_id", "source_id").agg(F.sum("weight").alias("boost"))


def phrase_boosts(keys: DataFrame, index: LexicalIndex) -> DataFrame:
    """Whole-query equality with a title, alias or source id, per query and metadata row."""
    hits = field_hits(keys.filter(_is_phrase()), index)
    return hits.groupBy("query_id", "row_id", "source_id").agg(F.sum("weight").alias("boost"))


def _covered() -> Column:
    terms = F.count_if((F.col("field") == "alias") & ~F.col("is_phrase"))
    return (F.max("n_terms") > 0) & (terms == F.max("n_terms"))


def alias_coverage(keys: DataFrame, index: LexicalIndex) -> DataFrame:
    """Metadata rows whose aliases contain every search term of the query."""
    return field_hits(keys, index).groupBy("query_id", "row_id", "source_id").agg(_covered().alias("covered")).filter(
        "covered").drop("covered")


def of_chunks(found: DataFrame, index: LexicalIndex) -> DataFrame:
    """Rows found per metadata row, once for every chunk of that row."""
    return found.join(index.chunks.select("chunk_id", "row_id"), "row_id")


def chunk_entries(index: LexicalIndex) -> DataFrame:
    """(chunk_id, field, key): body terms of every chunk and the terms and phrases of its metadata row."""
    body = index.postings().select("chunk_id", F.lit("body").alias("field"), "key")
    return body.unionByName(of_chunks(index.fields, index).select("chunk_id", "field", "key"))


def row_boosts(keys: DataFrame, index: LexicalIndex, questions: bool = False) -> DataFrame:
    """(query_id, row_id, source_id, boost): everything a chunk gets for its metadata row."""
    hits = field_hits(keys, index)
    if not questions:
        hits = hits.filter("field <> 'question'")
    return hits.groupBy("query_id", "row_id", "source_id").agg(
        (F.sum("weight") + F.when(_covered(), F.lit(FULL_ALIAS_BOOST)).otherwise(0.0)).alias("boost"))


TASK_HITS = 1 << 21  # body hits that one task adds up
HIT_PARTS = 16      # parts of a term's postings that are joined apart from each other


def chunk_hits(keys: DataFrame, index: LexicalIndex, columns: list[str] = ["chunk_id"]) -> DataFrame:
    """(query_id, chunk_id, weight, exact): one row per matching body term, and one per chunk of a matching metadata
    row. ``columns`` of the index's chunks may stand for the chunk id.

    Hits are far more than keys and postings, so both are dealt to more tasks than their own size asks for. A
    frequent term without a scope is split by its chunks, and its few keys meet each part.
    """
    weighted = materialized(weighted_keys(keys, index), "weighted-keys").filter("idf IS NOT NULL")
    postings = index.chunks.select(*columns, "scope", "body_length", F.explode("body_terms").alias("key"))
    on, tasks = _on(weighted), HIT_PARTS * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "scope" not in on:
        on = [*on, "_part"]
        postings = postings.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(HIT_PARTS)).cast("int"))
        weighted = weighted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(HIT_PARTS - 1))))
    body = postings.repartition(tasks, *on).join(weighted.repartition(tasks, *on), on).select(
        "query_id", *columns, bm25_weight(F.col("idf"), F.col("body_length"), F.col("average")).alias("weight"),
        F.lit(False).alias("exact"))
    rows = field_hits(keys.filter(~_is_phrase()), index).groupBy("query_id", "row_id").agg(
        F.sum("weight").alias("weight"), F.max(_is_question()).alias("exact"))
    members = index.chunks.select(*columns, "row_id").join(rows, "row_id")
    return body.unionByName(members.select("query_id", *columns, "weight", "exact"))


def chunk_scores(keys: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, chunk_id, terms, exact): term weights of all fields without phrases and coverage, and whether
    the whole query is one of the questions. For callers that rank by more than these scores."""
    return chunk_hits(keys, index).groupBy("query_id", "chunk_id").agg(
        F.sum("weight").alias("terms"), F.max("exact").alias("exact"))


def _scores(hits: DataFrame, boosts: DataFrame, index: LexicalIndex, per: int, tasks: int | None = None) -> DataFrame:
    """Scores of all chunks with a body hit and of the first ids of each boosted row.

    First ids enter as hits without weight, so one aggregation serves both. A chunk is kept if one of its hits
    ``generates`` it. Hits that are dealt to ``tasks`` by their chunk are added up where they are.
    """
    firsts = index.rows.select("row_id", "first_ids") if per <= FIRST_IDS else first_ids(index.chunks, per)
    bare = boosts.join(firsts, "row_id").select(
        "query_id", F.explode(F.slice("first_ids", 1, max(per, 1))).alias("chunk_id"), "row_id", "source_id",
        F.lit(0.0).alias("weight"), F.lit(True).alias("generates"))
    if tasks:
        bare = bare.repartition(tasks, "chunk_id")
    body = hits.select(*bare.columns).unionByName(bare).groupBy("query_id", "chunk_id", "row_id", "source_id").agg(
        F.sum("weight").alias("body"), F.max("generates").alias("generates")).filter("generates")
    return body.join(boosts.select("query_id", "row_id", "boost"), ["query_id", "row_id"], "left").select(
        "query_id", "chunk_id", "source_id", (F.col("body") + F.coalesce("boost", F.lit(0.0))).alias("score"))


def hit_tasks(weighted: DataFrame) -> int:
    """Tasks for the hits of the keys: hits are far more than chunks, so their number and not the chunks' size counts."""
    hits = weighted.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    return max(int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hits // TASK_HITS))


def lexical_scores(keys: DataFrame, index: LexicalIndex, per: int = 3) -> DataFrame:
    """(query_id, chunk_id, source_id, score) of every chunk with a body hit and of the first ``per`` chunks of
    each row with a boost."""
    weighted = materialized(weighted_keys(keys, index), "weighted-keys")
    boosts = materialized(row_boosts(keys, index), "row-boosts")
    tasks = hit_tasks(weighted)
    dealt = replace(index, chunks=index.chunks.repartition(tasks, "chunk_id"))
    return _scores(body_hits(weighted, dealt).withColumn("generates", F.lit(True)), boosts, index, per, tasks)


def above_minimum(scored: DataFrame, minimum: float) -> DataFrame:
    score = F.round("score", SCORE_DIGITS)
    return scored.filter((score > 0) & (score >= minimum) & (score < float("inf")))


def topk_capped(scored: DataFrame, k: int = 8, per: int = 3) -> DataFrame:
    """Best ``k`` per query with at most ``per`` of one source.

    A greedy pick that skips full sources keeps a prefix of every source, so two
    rank filters give the same rows.
    """
    order = [F.round("score", SCORE_DIGITS).desc(), F.col("chunk_id")]
    capped = top_per(scored, ["query_id", "source_id"], order, per, "_source_rank")
    return top_per(capped, ["query_id"], order, k, "rank").drop("_source_rank")


def _block_keys(weighted: DataFrame, boosts: DataFrame) -> DataFrame:
    """Per query and term: the idf sum of all terms and of those not stronger than it, and the best boost."""
    terms = weighted.filter("idf IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy("idf", "key")
    best = boosts.groupBy("query_id").agg(F.max("boost").alias("best"))
    return terms.join(best, "query_id", "left").select(
        "query_id", "key", "idf", "average", F.coalesce("best", F.lit(0.0)).alias("best"),
        F.sum("idf").over(Window.partitionBy("query_id")).alias("all_idf"),
        F.sum("idf").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("up_to_idf"))


def _block_hits(blocks: DataFrame) -> DataFrame:
    """(query_id, number, row_id, weight, generates, wanted): the hits of each query and chunk, added up."""
    rows = blocks.select("query_id", "idf", "average", "generates", "wanted", F.inline("postings"))
    return rows.groupBy("query_id", "number", "row_id").agg(
        F.sum(bm25_weight(F.col("idf"), F.col("body_length"), F.col("average"))).alias("weight"),
        F.max("generates").alias("generates"), F.max("wanted").alias("wanted"))


def _copies(index: LexicalIndex) -> Column:
    """Most chunks of one id; their scores are added up, so bounds of a chunk hold for an id times this."""
    counts = index.chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.max("_n"), F.lit(1)).alias("_copies")).scalar()


def _best_hits(hits: DataFrame, boosts: DataFrame, index: LexicalIndex, per: int) -> DataFrame:
    """Hits with the columns of their chunks. Only those among the ``per`` best of a source are joined, equal
    scores included."""
    scored = hits.join(boosts.select("query_id", "row_id", "boost"), ["query_id", "row_id"], "left").join(
        index.rows.select("row_id", "source_id"), "row_id")
    order = F.round(F.col("weight") + F.coalesce("boost", F.lit(0.0)), SCORE_DIGITS).desc()
    ranked = scored.withColumn("_r", F.rank().over(Window.partitionBy("query_id", "source_id").orderBy(order)))
    best = ranked.filter(F.col("_r") <= max(per, 1)).select("query_id", "number", "row_id", "weight", "generates")
    named = index.chunks.select("number", "chunk_id", "row_id", "source_id")
    return named.join(materialized(best, "best-hits"), ["number", "row_id"]).distinct()


def readable_blocks(weighted: DataFrame, boosts: DataFrame, index: LexicalIndex, k: int, per: int, minimum: float) -> DataFrame:
    """The blocks of each query that may hold one of its ``k`` results; ``generates`` marks those whose term,
    with all weaker ones, could reach the limit alone, and ``wanted`` is the limit less the best boost.

    The limit is the score of the last place among the chunks of the opening blocks and the first ids of
    boosted rows. These scores leave terms out, so the true last place scores no less. Every chunk of a block
    is at least as long as the block's shortest, so it scores at most as if it were as short and held every
    term; a chunk below the limit is no result, whichever of its blocks are read.
    """
    keys = materialized(_block_keys(weighted, boosts), "block-keys")
    reach = bm25_weight(F.lit(1.0), F.col("shortest"), F.col("average"))
    bounds = index.blocks.select("block", "key", "shortest").join(keys, "key")
    opening = top_per(bounds.select("query_id", "block", "key", "idf", "average", (reach * F.col("idf")).alias("_bound")), ["query_id"], [
        F.col("_bound").desc(), F.col("key")], OPENING_BLOCKS, "_r").select("query_id", "block", "idf", "average")
    read = index.blocks.select("block", "postings").join(materialized(opening, "opening-blocks"), "block").select(
        "*", F.lit(True).alias("generates"), F.lit(0.0).alias("wanted"))
    lower = _scores(_best_hits(_block_hits(read), boosts, index, per), boosts, index, per)
    last = topk_capped(above_minimum(lower, minimum), k, per).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_last"))
    limit = F.greatest(F.coalesce("_last", F.lit(minimum)), F.lit(minimum)) - SLACK
    limited = materialized(keys.join(last, "query_id", "left").select(
        "query_id", "key", "idf", "average", "all_idf", "up_to_idf", ((limit - F.col("best")) / _copies(index)).alias("wanted")), "limits")
    judged = index.blocks.join(limited, "key").filter(reach * F.col("all_idf") >= F.col("wanted"))
    return judged.withColumn("generates", reach * F.col("up_to_idf") >= F.col("wanted"))


def bounded_scores(keys: DataFrame, index: LexicalIndex, k: int, per: int, minimum: float) -> DataFrame:
    """Scores of the chunks that may be among the ``k`` results, from the blocks that could hold them."""
    weighted = materialized(weighted_keys(keys, index), "weighted-keys")
    boosts = materialized(row_boosts(keys, index), "row-boosts")
    hits = _block_hits(readable_blocks(weighted, boosts, index, k, per, minimum))
    close = hits.filter(F.col("generates") & (F.col("weight") >= F.col("wanted")))
    return _scores(_best_hits(close, boosts, index, per), boosts, index, per)


def lexical_search(
    queries: DataFrame, index: LexicalIndex, config: RetrievalConfig = RetrievalConfig(),
    limit: int | None = None,
) -> DataFrame:
    """(query_id, rank, chunk_id, source_id, score) for a whole query table."""
    k, per = config.limit(limit), config.max_per_source
    keys = materialized(query_keys(queries), "query-keys")
    if index.blocks is not None and k > 0:
        scored = bounded_scores(keys, index, k, per, config.minimum_score)
    else:
        scored = lexical_scores(keys, index, per)
    ranked = topk_capped(above_minimum(scored, config.minimum_score), k, per)
    return ranked.select("query_id", "rank", "chunk_id", "source_id", "score")
