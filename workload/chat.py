"""Dialogue tables, event streams, admission and streaming queries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.config import AdmissionPolicy
from evidentia.functions import text
from evidentia.operators import admission, dialogue, eventlog, lexical
from evidentia.operators.common import dealt, scratch_path
from evidentia.streaming import admission as stream_admission
from evidentia.streaming import citations as stream_citations
from evidentia.streaming import metrics as stream_metrics
from workload import world
from workload.registry import query
from workload.retrieval import _LINE_TOP, _line_scores
from workload.world import SQL_REQUESTS, WS, event_ms

_VISIBLE = rf"regexp_matches({{c}}, '[^{WS}\p{{Cf}}]')"


def _visible(c):
    return _VISIBLE.replace("{c}", c).replace("{{", "{").replace("}}", "}")


def _turn_code(i, role, content):
    return (f"CASE WHEN {role} NOT IN ('user', 'assistant') THEN 'invalid_history_role'"
            f" WHEN {role} <> CASE WHEN ({i}) % 2 = 0 THEN 'user' ELSE 'assistant' END THEN 'invalid_history'"
            f" WHEN NOT {_visible(content)} THEN 'invalid_history' WHEN length({content}) > 600 THEN 'history_message_too_long' END")


# -------------------------------------------------------------------- requests
def _requests(t):
    """Every turn as a request whose history is the two turns before it."""
    turns = t.conversations

    def earlier(n):
        """The turn ``n`` places before, by an equi-join on (conversation, turn)."""
        return turns.select(
            "conv_id", (F.col("turn") + n).alias("turn"),
            F.struct("role", F.col("text").alias("content")).alias(f"back{n}"))

    joined = turns.join(earlier(2), ["conv_id", "turn"], "left").join(earlier(1), ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id", "turn", F.when(F.col("conv_id") % 19 == 0, F.lit(" \u200b ")).otherwise(F.col("text")).alias("message"),
        F.when(F.col("conv_id") % 7 == 0, "short").otherwise(
            F.format_string("session-%d", "conv_id")).alias("session_id"),
        F.array_compact(F.array("back2", "back1")).alias("history"),
        F.when(F.col("turn") % 5 == 4, "xx-1").otherwise("en-US").alias("locale"))


@query(f"""WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 19 = 0 THEN ' ' || chr(8203) || ' ' ELSE text END AS message, conv_id % 7 = 0 AS short_session, turn % 5 = 4 AS bad_locale,
 lag(role, 2) OVER w AS r2, lag(text, 2) OVER w AS t2, lag(role) OVER w AS r1, lag(text) OVER w AS t1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT *, CASE WHEN r2 IS NULL THEN NULL ELSE {_turn_code('0', 'r2', 't2')} END AS first_, CASE WHEN r1 IS NULL THEN NULL WHEN r2 IS NULL THEN {_turn_code('0', 'r1', 't1')} ELSE {_turn_code('1', 'r1', 't1')} END AS second_ FROM r),
e AS (SELECT conv_id, turn, CASE WHEN NOT {_visible('message')} THEN 'empty_message' WHEN length(message) > 600 THEN 'message_too_long' WHEN short_session THEN 'invalid_session_id'
 WHEN first_ IS NOT NULL THEN first_ WHEN second_ IS NOT NULL THEN second_ WHEN r2 IS NULL AND r1 IS NOT NULL THEN 'invalid_history' WHEN bad_locale THEN 'invalid_locale' END AS error_code FROM c)
SELECT conv_id, turn, error_code, CASE WHEN error_code IS NOT NULL THEN 400 END AS status FROM e""")
def validate_requests(t):
    return dialogue.validate_requests(_requests(t)).select("conv_id", "turn", "error_code", "status")


@query("""SELECT page_id, code AS error_code, CASE code WHEN 'unsupported_content_type' THEN 415 WHEN 'invalid_body' THEN 400 WHEN 'body_too_large' THEN 413 WHEN 'cross_origin_request' THEN 403 END AS status FROM
(SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unsupported_content_type' WHEN page_id % 7 = 0 THEN 'invalid_body' WHEN strlen(html) > 32768 THEN 'body_too_large'
 WHEN url NOT LIKE 'https://%' THEN 'cross_origin_request' END AS code FROM pages)""")
def validate_context(t):
    key = F.col("page_id")
    rows = t.pages.select(
        "page_id", F.col("url").alias("request_url"),
        F.concat(F.lit("https://"), F.regexp_extract("url", "^https?://([^/]+)", 1)).alias("origin"),
        F.when(key % 5 == 0, "text/plain").otherwise("Application/JSON; charset=utf-8").alias("content_type"),
        F.when(key % 7 == 0, F.lit(-1)).alias("content_length"), F.octet_length("html").alias("body_bytes"))
    return dialogue.validate_context(rows).select("page_id", "error_code", "status")


_HISTORY = f"""p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
e AS (SELECT conv_id, i, {_turn_code('i', 'role', 'text')} AS code FROM p),
h AS (SELECT conv_id, count(*) AS turns, coalesce(arg_min(code, i) FILTER (code IS NOT NULL), CASE WHEN count(*) % 2 = 1 THEN 'invalid_history' END) AS error_code FROM e GROUP BY conv_id)"""


@query(f"WITH {_HISTORY} SELECT * FROM h")
def check_history(t):
    return dialogue.check_history(t.conversations)


@query(f"WITH {_HISTORY} SELECT conv_id, turn, role FROM p JOIN h USING (conv_id) WHERE error_code IS NULL AND turns - i <= 4")
def history_window(t):
    return dialogue.history_window(t.conversations, pairs=2).select("conv_id", "turn", "role")


@query(f"""WITH {_HISTORY}, old AS (SELECT conv_id, 0 AS part, i // 2 AS seq, max(text) FILTER (role = 'user') AS u, max(text) FILTER (role = 'assistant') AS a FROM p JOIN h USING (conv_id)
 WHERE error_code IS NULL AND turns <= 6 GROUP BY ALL), new_ AS (SELECT conv_id, 1 AS part, turn AS seq, substr(text, 1, 600) AS u, substr('Answer ' || text, 1, 600) AS a FROM conversations WHERE role = 'user' AND turn % 4 <> 2),
al AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part DESC, seq DESC) AS r FROM (SELECT * FROM old UNION ALL SELECT * FROM new_))
SELECT conv_id, ((3 - r) * 2 + s)::INT AS slot, CASE s WHEN 0 THEN 'user' ELSE 'assistant' END AS role, sha256(CASE s WHEN 0 THEN u ELSE a END) AS digest FROM al CROSS JOIN (VALUES (0), (1)) v(s) WHERE r <= 3""")
def append_turns(t):
    turns = t.conversations.filter("role = 'user'").select(
        "conv_id", F.col("turn").alias("seq"),
        F.when(F.col("turn") % 4 == 2, F.lit("\u200b")).otherwise(F.col("text")).alias("user_text"),
        F.concat(F.lit("Answer "), "text").alias("assistant_text"))
    return dialogue.append_turns(t.conversations, turns, pairs=3).select(
        "conv_id", "slot", "role", F.sha2("text", 256).alias("digest"))


# --------------------------------------------------------- packets and citations
def _line_chunks(t):
    rows = t.lineitem.select(F.format_string("%d-%d-%d", "l_orderkey", "l_partkey", "l_linenumber").alias("id"), "l_linenumber")
    return dealt(rows, "id").groupBy("id").agg(F.max("l_linenumber").alias("page")).select(
        "id", F.lit(None).cast("string").alias("project_id"), "page", F.lit("Lines").alias("title"),
        F.concat(F.lit("Lines · "), "id").alias("citation_label"), F.lit("/lines").alias("public_href"),
        F.array("page").alias("evidence_pages"), F.lit("source-excerpt").alias("knowledge_kind"),
        F.lit(None).cast("string").alias("provenance"), F.array().cast("array<string>").alias("intents"),
        F.lit("detail").alias("page_role"), F.concat(F.lit("Line "), "id").alias("text"))


@query(f"{_LINE_TOP} SELECT query_id, rank, 'S' || rank AS id, source_id, 'Lines · ' || chunk_id AS citation_label FROM b WHERE rank <= 8")
def packet_sources(t):
    packet = dialogue.packet_sources(lexical.topk_capped(_line_scores(t), k=20), _line_chunks(t))
    return packet.select("query_id", "rank", "id", "source_id", "citation_label")


@query(f"{_LINE_TOP} SELECT s_suppkey AS query_id, count(query_id) AS n_sources, true AS grounded, 1 AS n_messages FROM supplier LEFT JOIN (SELECT * FROM b WHERE rank <= 8) ON query_id = s_suppkey GROUP BY s_suppkey")
def build_prompts(t):
    queries = t.supplier.select(F.col("s_suppkey").alias("query_id"), F.lit("en").alias("locale"), F.col("s_name").alias("message"))
    facts = t.region.select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("text"))
    prompts = dialogue.build_prompts(queries, lexical.topk_capped(_line_scores(t)), _line_chunks(t), facts)
    return prompts.select(
        "query_id", "n_sources", F.contains("system", F.lit('{"fact":1,"text":"AFRICA"}')).alias("grounded"),
        F.size("messages").alias("n_messages"))


def _answers(t):
    marked = F.concat(F.substring("text", 1, 20), F.lit("[[S"), (F.col("turn") % 10).cast("string"), F.lit("]]"), "text",
                      F.lit(" [[bad]] x[[S1]]y[[S2 z"))
    return t.conversations.select("conv_id", "turn", marked.alias("text"))


_ANSWERS = "SELECT conv_id, turn, substr(text, 1, 20) || '[[S' || (turn % 10) || ']]' || text || ' [[bad]] x[[S1]]y[[S2 z' AS text FROM conversations"


@query(rf"""SELECT conv_id, turn, sha256(regexp_replace(text, '(?s)\[\[.*?\]\]', '', 'g')) AS digest,
CASE WHEN turn % 10 BETWEEN 2 AND 5 THEN 'S' || (turn % 10) || ',S1' ELSE 'S1' END AS cited FROM ({_ANSWERS})""")
def extract_citations(t):
    allowed = F.array(*[F.lit(f"S{i}") for i in range(1, 6)])
    rows = _answers(t).select("conv_id", "turn", dialogue.extract_citations(F.col("text"), allowed).alias("c"))
    return rows.select("conv_id", "turn", F.sha2("c.text", 256).alias("digest"), F.array_join("c.source_ids", ",").alias("cited"))


@query(f"""{_LINE_TOP}, ans AS (SELECT conv_id, turn, conv_id % (SELECT count(*) FROM supplier) + 1 AS query_id, CASE WHEN turn % 3 = 0 THEN ['S1', 'S2'] ELSE ['S' || (turn % 2 + 1), 'S3'] END AS ids FROM conversations),
x AS (SELECT conv_id, turn, query_id, unnest(ids) AS id, unnest(range(len(ids)))::INT AS ord FROM ans)
SELECT conv_id, turn, ord, id, 'Lines · ' || chunk_id AS citation_label FROM x JOIN b ON b.query_id = x.query_id AND 'S' || b.rank = x.id WHERE rank <= 8""")
def resolve_citations(t):
    packet = dialogue.packet_sources(lexical.topk_capped(_line_scores(t)), _line_chunks(t))
    suppliers = t.supplier.select(F.count(F.lit(1))).scalar()
    answers = t.conversations.select(
        F.struct("conv_id", "turn").alias("resp_id"), (F.col("conv_id") % suppliers + 1).alias("query_id"),
        F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(
            F.concat(F.lit("S"), (F.col("turn") % 2 + 1).cast("string")), F.lit("S3"))).alias("source_ids"))
    return dialogue.resolve_citations(answers, packet).select(
        "resp_id.conv_id", "resp_id.turn", "ord", "id", "citation_label")


@query(f"""SELECT conv_id AS resp_id, n > 8192 AS too_long, n <= 8192 AS visible, CASE WHEN n <= 8192 THEN sha256(s) END AS digest
FROM (SELECT conv_id, sum(length(text)) AS n, string_agg(text, '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id)""")
def assemble_answers(t):
    deltas = t.conversations.select(F.col("conv_id").alias("resp_id"), F.col("turn").alias("seq"), "text")
    return dialogue.assemble_answers(deltas).select(
        "resp_id", "too_long", "visible", F.sha2("text", 256).alias("digest"))


@query("""SELECT status, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(retrieval_count)::BIGINT AS retrievals FROM (SELECT CASE WHEN e % 7 = 0 THEN 'rejected' WHEN e % 5 = 0 THEN 'rate_limited' WHEN e % 3 = 0 THEN 'no_result'
 WHEN e % 2 = 0 THEN 'success' ELSE 'failure' END AS status, CASE WHEN e % 7 > 0 AND e % 5 > 0 AND e % 3 > 0 AND e % 2 = 0 THEN e % 100 ELSE 0 END AS input_tokens,
 CASE WHEN e % 7 > 0 AND e % 5 > 0 AND e % 3 > 0 THEN e % 3 ELSE 0 END AS retrieval_count FROM (SELECT event_id AS e FROM events)) GROUP BY status""")
def chat_outcomes(t):
    e = F.col("event_id")
    request = e.alias("request_id")
    outcomes = dialogue.chat_outcomes(
        t.events.select(request, F.when(e % 7 == 0, "invalid_body").alias("error_code"), F.col("value").alias("latency_ms")),
        t.events.select(request, (e % 5 != 0).alias("allowed")),
        t.events.select(request, F.explode(F.sequence(F.lit(1), e % 3 + 1)).alias("hit")).filter(
            F.col("hit") <= F.col("request_id") % 3),
        t.events.select(request, (e % 2 == 0).alias("ok"), (e % 100).alias("input_tokens"), F.lit(1).alias("output_tokens")))
    return outcomes.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("retrieval_count").alias("retrievals"))


def _metrics(events):
    return events.select(
        "ts", F.col("event_type").alias("status"), F.col("value").alias("latency_ms"),
        (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 10).alias("output_tokens"),
        (F.col("event_id") % 9).alias("retrieval_count"))


_METRICS_SQL = """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS status, count(*) AS requests, round(sum(value), 4) AS latency_total, max(value) AS latency_max,
sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 10)::BIGINT AS output_tokens, sum(event_id % 9)::BIGINT AS retrievals FROM events GROUP BY ALL"""


def _metric_columns(rows):
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "status", "requests",
        F.round("latency_total", 4).alias("latency_total"), "latency_max", "input_tokens", "output_tokens", "retrievals")


@query(_METRICS_SQL)
def metrics_by_window(t):
    return _metric_columns(dialogue.metrics_by_window(_metrics(t.events), "6 hours"))


# --------------------------------------------------------------- event streams
def _bodies(t):
    """One event-stream body per turn, with mixed line ends and inert lines."""
    delta = F.concat(F.lit(": note\r\nevent: delta\r\ndata: "), F.to_json(F.struct("text")), F.lit("\r\n\r\n"))
    tail = F.when(F.col("turn") % 4 == 3, "event: done").otherwise("")
    return t.conversations.select(
        F.format_string("%d-%d", "conv_id", "turn").alias("resp_id"), F.col("turn"),
        F.concat(
            F.lit('event: start\ndata: {"locale":\ndata: "en"}\n\n'), delta,
            F.when(F.col("turn") % 4 == 1, "event: delta\ndata: {broken\n\n").otherwise("id: 7\n\n"),
            F.when(F.col("turn") % 4 == 2, "data: {}\n\n").otherwise(
                'event: sources\rdata: {"sources":[]}\r\revent: done\ndata:{}\n\n'), tail).alias("body"))


_STREAM = """b AS (SELECT printf('%d-%d', conv_id, turn) AS resp_id, turn, text FROM conversations),
rows_ AS (SELECT resp_id, 0 AS seq, 'start' AS type, NULL AS error FROM b UNION ALL SELECT resp_id, 1, 'delta', NULL FROM b
UNION ALL SELECT resp_id, 2, 'delta', 'invalid_json' FROM b WHERE turn % 4 = 1 UNION ALL SELECT resp_id, 3, NULL, 'malformed_block' FROM b WHERE turn % 4 = 2
UNION ALL SELECT resp_id, 3, 'sources', NULL FROM b WHERE turn % 4 <> 2 UNION ALL SELECT resp_id, 4, 'done', NULL FROM b WHERE turn % 4 <> 2
UNION ALL SELECT resp_id, 5, 'done', 'incomplete_tail' FROM b WHERE turn % 4 = 3)"""


@query(f"WITH {_STREAM} SELECT resp_id, seq, type, error, CASE WHEN type = 'delta' AND error IS NULL THEN (SELECT sha256(text) FROM b WHERE b.resp_id = rows_.resp_id) END AS digest FROM rows_")
def parse_event_streams(t):
    rows = eventlog.parse_event_streams(_bodies(t))
    return rows.select("resp_id", "seq", "type", "error", F.when(
        (F.col("type") == "delta") & F.col("error").isNull(), F.sha2(F.get_json_object("data", "$.text"), 256)).alias("digest"))


def _events(t):
    """Well-formed and damaged events; the kind follows the order key."""
    source = ('{"id":"S%d","sourceId":"s","title":"t","citationLabel":"l","publicHref":"%s"}')
    k = F.col("o_orderkey") % 12
    one = lambda i, href="/a": source % (i, href)
    data = F.get(F.array(*[F.lit(d) for d in (
        '{"locale":"en"}', '{"locale":"fr"}', '{"text":"x"}', '{"text":5}', '{"text":""}',
        '{"sources":[%s,%s]}' % (one(1), one(2)), '{"sources":[%s,%s]}' % (one(1), one(1)),
        '{"sources":[%s]}' % one(3, "//evil"), '{"inputTokens":5}', '{"outputTokens":-1}',
        '{"code":"rate_limited","message":"m","retryable":true}', '{"code":"odd","message":"m","retryable":true}')]), k.cast("int"))
    kind = F.get(F.array(*[F.lit(x) for x in (
        "start", "start", "delta", "delta", "delta", "sources", "sources", "sources", "done", "done", "error", "error")]), k.cast("int"))
    return t.orders.select(F.col("o_custkey").alias("resp_id"), F.col("o_orderkey").alias("seq"), kind.alias("type"), data.alias("data"))


@query("""SELECT CASE k WHEN 1 THEN 'start' WHEN 3 THEN 'delta' WHEN 4 THEN 'delta' WHEN 6 THEN 'sources' WHEN 7 THEN 'sources' WHEN 9 THEN 'done' WHEN 11 THEN 'error' END AS rule,
o_custkey || ':' || o_orderkey AS key FROM (SELECT *, o_orderkey % 12 AS k FROM orders) WHERE k IN (1, 3, 4, 6, 7, 9, 11)""")
def check_events(t):
    return eventlog.check_events(_events(t)).select("rule", "key")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c % 8 <> 7 AND c % 11 = 5 THEN 'bad_start' ELSE CASE c % 8 WHEN 0 THEN 'complete' WHEN 1 THEN 'bad_start' WHEN 2 THEN 'missing_done' WHEN 3 THEN 'bad_order' WHEN 4 THEN 'no_visible_answer'
 WHEN 5 THEN 'public_error' WHEN 6 THEN 'bad_order' ELSE 'unknown_type' END END AS reason FROM (SELECT DISTINCT conv_id AS c FROM conversations)) GROUP BY reason""")
def check_protocol(t):
    """One response per conversation; the order of its events follows its number."""
    text_, blank = '{"text":"x"}', '{"text":" "}'
    plans = [
        [("start", "{}"), ("delta", text_), ("delta", blank), ("sources", "{}"), ("done", "{}")],
        [("delta", text_), ("start", "{}"), ("sources", "{}"), ("done", "{}")],
        [("start", "{}"), ("delta", text_), ("sources", "{}")],
        [("start", "{}"), ("sources", "{}"), ("delta", text_), ("done", "{}")],
        [("start", "{}"), ("delta", blank), ("sources", "{}"), ("done", "{}")],
        [("start", "{}"), ("delta", text_), ("error", "{}"), ("done", "{}")],
        [("start", "{}"), ("delta", text_), ("sources", "{}"), ("error", "{}")],
        [("start", "{}"), ("ping", "{}")],
    ]
    plans = [[(kind, '{"locale":"en"}' if kind == "start" else data) for kind, data in p] for p in plans]
    options = F.array(*[F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("data")) for a, b in p]) for p in plans])
    events = t.conversations.select("conv_id").distinct().select(
        F.col("conv_id").alias("resp_id"), F.posexplode(F.get(options, (F.col("conv_id") % 8).cast("int"))).alias("seq", "e")
    ).select("resp_id", "seq", "e.type", "e.data")
    locales = t.conversations.select(F.col("conv_id").alias("resp_id"), F.when(F.col("conv_id") % 11 == 5, "zh").otherwise("en").alias("locale")).distinct()
    return eventlog.check_protocol(events, locales).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT rule, key FROM (SELECT 'output_code_points' AS rule, doc_id::VARCHAR AS key FROM documents WHERE length(text) > 8192 UNION ALL
SELECT 'event_bytes', doc_id::VARCHAR FROM documents WHERE doc_id % 100 = 0 UNION ALL SELECT 'stream_bytes', doc_id::VARCHAR FROM documents WHERE doc_id % 100 = 1)""")
def check_stream_limits(t):
    """One response per document, some with an oversized comment block or body."""
    k = F.col("doc_id") % 100
    body = F.concat(
        F.lit("event: delta\ndata: "), F.to_json(F.struct("text")), F.lit("\n\n"),
        F.when(k == 0, F.concat(F.lit(":"), F.repeat(F.lit("x"), 70_000), F.lit("\n\n")))
        .when(k == 1, F.repeat(F.lit(":" + "y" * 1_000 + "\n\n"), 1_100)).otherwise(""))
    return eventlog.check_stream_limits(t.documents.select(
        F.col("doc_id").alias("resp_id"), body.alias("body"))).select("rule", "key")


@query("""SELECT rule, key FROM (SELECT 'output_code_points' AS rule, doc_id::VARCHAR AS key FROM documents WHERE length(text) * 3 > 8192 UNION ALL
SELECT 'line_chars', doc_id::VARCHAR FROM documents WHERE doc_id % 100 = 0 UNION ALL SELECT 'event_chars', doc_id::VARCHAR FROM documents WHERE doc_id % 100 = 1 UNION ALL
SELECT 'stream_bytes', doc_id::VARCHAR FROM documents WHERE doc_id % 100 = 2)""")
def check_completion_limits(t):
    """One provider response per document: its text three times in short events, and some oversized parts."""
    k = F.col("doc_id") % 100
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / 400).cast("int")), lambda i: F.substring(F.col("text"), i * 400 + 1, F.lit(400)))
    event = lambda p: F.concat(F.lit('data: {"choices":[{"delta":{"content":'), F.substring(F.to_json(F.struct(p.alias("a"))), F.lit(6), F.lit(100_000)),
                               F.lit("}]}\n\n"))
    text_ = F.array_join(F.transform(pieces, event), "")
    odd = (F.when(k == 0, ":" + "x" * 4_097 + "\n\n").when(k == 1, F.repeat(F.lit("data: " + " " * 4_000 + "\n"), 3))
           .when(k == 2, F.repeat(F.lit(":" + "y" * 1_000 + "\n\n"), 1_100)).otherwise(""))
    body = F.concat(F.repeat(text_, 3), F.lit("data: [DONE]\n\n"), odd)
    return eventlog.check_completion_limits(t.documents.select(F.col("doc_id").alias("resp_id"), body.alias("body"))).select("rule", "key")


@query("""WITH b AS (SELECT printf('%d-%d', conv_id, turn) AS resp_id, turn AS k, text FROM conversations)
SELECT resp_id, type, seq, tokens, error, digest FROM (SELECT resp_id, 'delta' AS type, 0 AS seq, NULL::BIGINT AS tokens, NULL AS error, sha256(text) AS digest FROM b
UNION ALL SELECT resp_id, 'usage', 3, k + 1, NULL, NULL FROM b WHERE k % 3 = 0 UNION ALL SELECT resp_id, 'done', 4, NULL, NULL, NULL FROM b WHERE k % 3 = 0
UNION ALL SELECT resp_id, 'error', 2, NULL, 'missing_done', NULL FROM b WHERE k % 3 = 1
UNION ALL SELECT resp_id, 'error', 1, NULL, 'malformed_response', NULL FROM b WHERE k % 3 = 2 UNION ALL SELECT resp_id, 'done', 3, NULL, NULL, NULL FROM b WHERE k % 3 = 2)""")
def parse_completion_streams(t):
    k = F.col("turn")
    delta = F.concat(F.lit('data: {"choices":[{"delta":{"content":'), F.to_json(F.struct("text")), F.lit("}}]}\n\n"))
    delta = F.replace(F.replace(delta, F.lit('{"text":'), F.lit("")), F.lit('"}}}]}'), F.lit('"}}]}'))
    usage = lambda n: F.concat(F.lit('data: {"usage":{"prompt_tokens":'), n.cast("string"), F.lit(',"completion_tokens":1}}\n\n'))
    bodies = t.conversations.select(
        F.format_string("%d-%d", "conv_id", "turn").alias("resp_id"),
        F.concat(delta, F.when(k % 3 == 0, F.concat(
            usage(k), usage(k + 1), F.lit("data: [DONE]\n\ndata: {\"choices\":[]}\n\n")))
            .when(k % 3 == 1, usage(k)).otherwise("data: {oops\n\ndata: [DONE]\n\n")).alias("body"))
    return eventlog.parse_completion_streams(bodies).select(
        "resp_id", "type", "seq", F.col("input_tokens").alias("tokens"), "error", F.sha2("text", 256).alias("digest"))


# ------------------------------------------------------------------- admission
POLICY = AdmissionPolicy(cooldown_ms=600_000, window_ms=3_600_000, window_limit=2, visitor_day_limit=3, site_day_limit=10 ** 9)
CAPPED = AdmissionPolicy(cooldown_ms=600_000, window_ms=3_600_000, window_limit=2, visitor_day_limit=3, site_day_limit=100)

_DAY = "(now_ms + 28800000) // 86400000"
_ADMISSION = f"""{SQL_REQUESTS}, o_ AS (SELECT *, row_number() OVER (PARTITION BY visitor_key ORDER BY now_ms, request_id) AS k, {_DAY} AS d FROM requests_),
f_ AS (SELECT visitor_key, 0::BIGINT AS k, NULL::BIGINT AS now_ms, NULL::VARCHAR AS request_id, NULL::BIGINT AS d, NULL::VARCHAR AS verdict, []::BIGINT[] AS charges FROM o_ WHERE k = 1
UNION ALL SELECT visitor_key, k, now_ms, request_id, d, verdict, CASE WHEN verdict = 'ok' THEN list_append(charges, now_ms) ELSE charges END FROM
(SELECT o.visitor_key, o.k, o.now_ms, o.request_id, o.d, f.charges, CASE WHEN len(f.charges) > 0 AND list_max(f.charges) + 600000 > o.now_ms THEN 'cooldown'
 WHEN len(list_filter(f.charges, lambda c: c >= o.now_ms - 3600000)) >= 2 THEN 'minute'
 WHEN len(list_filter(f.charges, lambda c: (c + 28800000) // 86400000 = o.d)) >= 3 THEN 'visitor_day' ELSE 'ok' END AS verdict
 FROM f_ f JOIN o_ o ON o.visitor_key = f.visitor_key AND o.k = f.k + 1))"""
_VERDICTS = f"WITH RECURSIVE {_ADMISSION} SELECT request_id, verdict = 'ok' AS allowed, CASE WHEN verdict <> 'ok' THEN verdict END AS reason FROM f_ WHERE k > 0"


@query(_VERDICTS)
def admit_requests(t):
    return admission.admit_requests(world.event_requests(t), POLICY).select("request_id", "allowed", "reason")


@query()
def admit_requests_with_site_limit(t):
    """Exact fold over all visitors and days; it has no set-based SQL form."""
    return admission.admit_requests(world.event_requests(t), CAPPED).select("request_id", "allowed", "reason", "reset_at")


@query("SELECT rule, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'visitor_key' WHEN 1 THEN 'timestamp' WHEN 2 THEN 'request_id' END AS rule FROM events) WHERE rule IS NOT NULL GROUP BY rule")
def check_admission_input(t):
    k = F.col("event_id") % 4
    rows = t.events.select(
        F.when(k == 0, "visitor").otherwise(F.sha2(F.col("user_id").cast("string"), 256)).alias("visitor_key"),
        F.when(k == 1, F.lit(-5)).otherwise(event_ms()).alias("now_ms"),
        F.when(k == 2, "two words").otherwise(F.format_string("r%d", "event_id")).alias("request_id"))
    return admission.check_admission_input(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_AT = 1_705_276_800_000


@query(f"""WITH {SQL_REQUESTS}, s AS (SELECT *, {_DAY} AS d FROM requests_ WHERE now_ms <= {_AT}), v AS (SELECT max(now_ms) AS last, count(*) FILTER (now_ms >= {_AT} - 3600000) AS recent FROM s GROUP BY visitor_key)
SELECT count(*) FILTER (last + 600000 > {_AT}) AS cooldowns, count(*) FILTER (recent > 0) AS window_visitors, sum(recent)::BIGINT AS window_entries,
(SELECT count(*) FROM (SELECT max(now_ms) AS m FROM s GROUP BY visitor_key, d) WHERE m + 172800000 > {_AT}) AS visitor_day_buckets,
(SELECT count(*) FROM (SELECT max(now_ms) AS m FROM s GROUP BY d) WHERE m + 172800000 > {_AT}) AS site_day_buckets FROM v""")
def state_sizes(t):
    charges = world.event_requests(t).withColumn("day", text.day_number(F.col("now_ms")))
    return admission.state_sizes(charges, _AT, POLICY)


# ------------------------------------------------------------------- streaming
_FILES = 2  # files a micro-batch


def _drained(stream, spark, name, done=None):
    """Run a stream over everything there is, in append mode, and return what it wrote. ``done`` sees the run."""
    path = scratch_path(spark, name)
    run = stream.writeStream.outputMode("append").option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(
        availableNow=True).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch_id={n}")).start()
    run.awaitTermination()
    if done is not None:
        done(run)
    return spark.read.schema(stream.schema).parquet(path)


def _arriving(rows, column, name, closing, parts=4):
    """A stream of the rows in order of ``column`` over several micro-batches, and a last row that moves the
    watermark past everything before it."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, name)
    low, high = rows.agg(F.min(column), F.max(column)).first()
    width = ((high or 0) - (low or 0)) // parts + 1
    for k in range(parts):
        some = rows.filter((F.col(column) >= (low or 0) + k * width) & (F.col(column) < (low or 0) + (k + 1) * width))
        some.repartition(_FILES).write.mode("append").parquet(path)
    closing((high or 0)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _FILES).parquet(path)


@query(_METRICS_SQL)
def metrics_stream(t):
    """Append mode over several files: windows come out when the watermark has passed them."""
    rows = _metrics(t.events).withColumn("ms", event_ms())
    last = lambda high: rows.limit(1).withColumn("ms", F.lit(high + 30 * 86_400_000)).withColumn("status", F.lit("closing"))
    timed = _arriving(rows, "ms", "metrics-input", last).withColumn("ts", F.timestamp_millis("ms"))
    return _metric_columns(_drained(stream_metrics.metrics_stream(timed, "6 hours", "1 hour"), t.spark, "metrics"))


def _timed_requests(t):
    rows = world.event_requests(t).select("visitor_key", "now_ms", "request_id")
    last = lambda high: t.spark.range(1).select(
        F.sha2(F.lit("closing"), 256).alias("visitor_key"), F.lit(high + 10 * 86_400_000).alias("now_ms"), F.lit("closing").alias("request_id"))
    return _arriving(rows, "now_ms", "requests-input", last)


@query(_VERDICTS)
def admit_request_stream(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream_admission.STATE_STORE)
    stream = stream_admission.admit_request_stream(_timed_requests(t), POLICY)
    return _drained(stream, t.spark, "admission").filter("request_id <> 'closing'").select("request_id", "allowed", "reason")


@query("SELECT true AS expired, count(DISTINCT user_id) > 0 AS visitors FROM events")
def admission_expiry(t):
    """After ten silent days nothing is left of any visitor but the one whose request moved the watermark."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream_admission.STATE_STORE)
    left = []
    stream = stream_admission.admit_request_stream(_timed_requests(t), POLICY)
    rows = _drained(stream, t.spark, "expiry", lambda run: left.append(stream_admission.state_rows(run)))
    # One cooldown, one window entry and one day of the closing visitor, and its timer.
    alone = sum(left[0].values()) <= 4
    return rows.agg(F.lit(alone).alias("expired"), (F.count_distinct("visitor_key") > 1).alias("visitors"))


def _text_digests(pieces):
    """(resp_id, digest) of whole texts of any length: pieces are folded in order and never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            done = []
            for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or key != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256()
                digest.update((piece or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["resp_id", "digest"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (current, digest.hexdigest())], ["resp_id", "digest"])

    order = [c for c in ("resp_id", "seq", "closing") if c in pieces.columns]
    ordered = pieces.repartition("resp_id").sortWithinPartitions(*order).select("resp_id", "text")
    return ordered.mapInArrow(run, "resp_id string, digest string")


@query(rf"""SELECT conv_id::VARCHAR AS resp_id, sha256(regexp_replace(s, '(?s)\[\[.*?\]\]', '', 'g')) AS digest FROM
(SELECT conv_id, string_agg(text, '' ORDER BY turn) AS s FROM ({_ANSWERS}) GROUP BY conv_id)""")
def strip_citation_stream(t):
    """Several micro-batches; a third of the responses never say that they end and are closed by their timers."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream_admission.STATE_STORE)
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    deltas = _answers(t).join(last, "conv_id").select(
        F.col("conv_id").cast("string").alias("resp_id"), F.col("turn").cast("bigint").alias("seq"), "text",
        ((F.col("turn") == F.col("last")) & (F.col("conv_id") % 3 > 0)).alias("final"), ((F.col("turn") + 1) * 60_000).cast("bigint").alias("ms"))
    closing = lambda high: t.spark.range(1).select(
        F.lit("closing").alias("resp_id"), F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("text"), F.lit(True).alias("final"),
        F.lit(high + 86_400_000).cast("bigint").alias("ms"))
    timed = _arriving(deltas, "ms", "deltas", closing).withColumn("ts", F.timestamp_millis("ms"))
    pieces = _drained(stream_citations.strip_citation_stream(timed, 3_600_000), t.spark, "citations")
    return _text_digests(pieces.filter("resp_id <> 'closing'"))
