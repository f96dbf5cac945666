"""Event streams stored as text: parsing, schema, order and size checks.

A response body is one row, so everything up to the exploded events happens
inside the row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.config import (
    COMPLETION_EVENT_CHARS,
    EVENT_BYTES,
    LABEL_CODE_POINTS,
    LINE_CHARS,
    MAX_SOURCES,
    OUTPUT_CODE_POINTS,
    STREAM_BYTES,
)
from evidentia.functions import text
from evidentia.operators.common import positions, row_violations, union_all, violations

# Error codes an event may carry.
PUBLIC_ERRORS = (
    "method_not_allowed", "cross_origin_request", "unsupported_content_type", "body_too_large",
    "invalid_body", "empty_message", "message_too_long", "invalid_session_id", "invalid_history",
    "invalid_history_role", "history_message_too_long", "invalid_locale", "rate_limited",
    "chat_disabled", "upstream_unavailable", "internal_error",
)
_SAFE_INTEGER = 2 ** 53 - 1
_STRINGS = "array<string>"


def _unix_lines(c: Column) -> Column:
    return F.when(c.contains("\r"), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def _field_values(lines: Column, name: str) -> Column:
    """Values of one field in a block, comments and other fields ignored."""
    kept = F.filter(lines, lambda l: (l == name) | l.startswith(name + ":"))
    return F.transform(kept, lambda l: F.substring(l, F.when(l.startswith(name + ": "), len(name) + 3).otherwise(
        len(name) + 2), F.char_length(l)))


def _placed_blocks(bodies: DataFrame, *carried: Column) -> DataFrame:
    """(resp_id, carried, seq, block, terminated) of every block, empty ones too.

    Only the last piece of a split body has no end of its own.
    """
    split = bodies.select("resp_id", *carried, F.split(_unix_lines(F.col("body")), "\n\n", -1).alias("_blocks"))
    placed = split.select("*", F.size("_blocks").alias("_n"), F.posexplode("_blocks").alias("seq", "block"))
    return placed.withColumn("terminated", F.col("seq") < F.col("_n") - 1).drop("_blocks", "_n")


def _is_event() -> Column:
    return (F.col("block") != "") & (F.col("terminated") | F.col("block").rlike(f"[^{text.SPACE}]"))


def event_blocks(bodies: DataFrame) -> DataFrame:
    """(resp_id, seq, block, terminated) of every non-empty block."""
    return _placed_blocks(bodies).filter(_is_event())


def parse_event_streams(bodies: DataFrame, strict: bool = False) -> DataFrame:
    """(resp_id, seq, type, data, error) from ``resp_id, body``.

    Broken blocks stay as rows with an ``error``. ``strict`` drops every row of a
    response that has one, as a live reader would.
    """
    lines = F.split("block", "\n", -1)
    fields = event_blocks(bodies).select(
        "resp_id", "seq", "terminated", _field_values(lines, "event").alias("events"),
        _field_values(lines, "data").alias("datas"))
    kind = F.element_at("events", -1)
    present = F.size("events") > 0
    parsed = fields.filter(~F.col("terminated") | present | (F.size("datas") > 0)).select(
        "resp_id", "seq",
        F.when(present, kind).alias("type"),
        F.when(F.size("datas") > 0, F.array_join("datas", "\n")).alias("data"), "terminated")
    complete = F.coalesce(F.col("type"), F.lit("")) != ""
    rows = parsed.select(
        "resp_id", "seq", "type", "data",
        F.when(~F.col("terminated"), "incomplete_tail")
        .when(~complete | F.col("data").isNull(), "malformed_block")
        .when(F.try_parse_json("data").isNull(), "invalid_json").alias("error"))
    if strict:
        broken = rows.filter("error IS NOT NULL").select("resp_id").distinct()
        rows = rows.join(broken, "resp_id", "left_anti")
    return rows


_SOURCE_SHAPE = (
    r"^OBJECT<citationLabel: STRING, id: STRING(, page: BIGINT)?(, projectId: STRING)?"
    r", publicHref: STRING, sourceId: STRING, title: STRING>$"
)
_SOURCE_FIELDS = ("struct<id:string,sourceId:string,projectId:string,page:bigint,title:string,"
                  "citationLabel:string,publicHref:string>")


def _invalid_source(raw: Column) -> Column:
    s = F.from_json(raw, _SOURCE_FIELDS)
    shape = F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).rlike(_SOURCE_SHAPE), F.lit(False))
    label = lambda c: text.has_visible(c) & (F.char_length(c) <= LABEL_CODE_POINTS)
    valid = (
        shape & s["id"].rlike("^S[1-8]$") & label(s["sourceId"]) & label(s["title"])
        & label(s["citationLabel"]) & label(s["publicHref"]) & text.is_internal_href(s["publicHref"])
        & (s["projectId"].isNull() | label(s["projectId"]))
        & (s["page"].isNull() | s["page"].between(1, _SAFE_INTEGER)))
    return ~F.coalesce(valid, F.lit(False))


# How a whole number can be written: 5, 5.0 and 1e2 are all safe integers.
_NUMBER = r"(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"


def _safe_integer(raw: Column) -> Column:
    value = raw.try_cast("double")
    return F.coalesce((value == F.floor(value)) & value.between(0, _SAFE_INTEGER), F.lit(False))


def check_events(events: DataFrame) -> DataFrame:
    """Findings over parsed events: exact keys, types, sizes, ids, links, codes."""
    data, kind = F.col("data"), F.col("type")
    shape = F.coalesce(F.schema_of_variant(F.try_parse_json("data")), F.lit(""))
    value = lambda path: F.get_json_object("data", path)
    raw_sources = F.from_json("data", "struct<sources:array<string>>")["sources"]
    ids = F.transform(raw_sources, lambda r: F.get_json_object(r, "$.id"))
    tokens = lambda name: F.get_json_object("data", f"$.{name}").isNull() | _safe_integer(F.get_json_object("data", f"$.{name}"))
    rules = {
        "unparsed": F.col("error").isNotNull() if "error" in events.columns else F.lit(False),
        "unknown_type": ~F.coalesce(kind.isin("start", "delta", "sources", "done", "error"), F.lit(False)),
        "start": (kind == "start") & ((shape != "OBJECT<locale: STRING>") | ~value("$.locale").isin("zh", "en")),
        "delta": (kind == "delta") & (
            (shape != "OBJECT<text: STRING>") | (value("$.text") == "")
            | (F.char_length(value("$.text")) > OUTPUT_CODE_POINTS)),
        "sources": (kind == "sources") & (
            ~shape.rlike("^OBJECT<sources: ARRAY<.*>>$") | (F.size(raw_sources) > MAX_SOURCES)
            | (F.size(F.array_distinct(ids)) != F.size(ids)) | F.exists(raw_sources, _invalid_source)),
        "done": (kind == "done") & (
            ~shape.rlike(f"^OBJECT<(inputTokens: {_NUMBER})?(, )?(outputTokens: {_NUMBER})?>$")
            | ~tokens("inputTokens") | ~tokens("outputTokens")),
        "error": (kind == "error") & (
            (shape != "OBJECT<code: STRING, message: STRING, retryable: BOOLEAN>")
            | ~value("$.code").isin(*PUBLIC_ERRORS)
            | (F.char_length(value("$.message")) > LABEL_CODE_POINTS)),
    }
    return row_violations(events, F.concat_ws(":", F.col("resp_id").cast("string"), F.col("seq").cast("string")), rules)


EVENT_BLOCK = 8_192


def check_protocol(events: DataFrame, locales: DataFrame | None = None) -> DataFrame:
    """(resp_id, ok, reason): start, deltas, sources, done; an error only while
    streaming ends the response; an answer needs visible text. With ``locales(resp_id,
    locale)`` of the requests, a response has to start in its request's locale.

    The order rules are stated over first and last positions per type, which
    combine map-side; no response is collected.
    """
    placed = positions(events, ["resp_id"], "seq", EVENT_BLOCK)
    at, kind = F.col("position"), F.col("type")
    first = lambda name, extra=F.lit(True): F.min(F.when((kind == name) & extra, at))
    stats = placed.groupBy("resp_id").agg(
        F.max(at).alias("last"),
        first("start").alias("start"), first("start", at > 0).alias("restart"),
        F.min(F.when((kind == "start") & (at == 0), F.get_json_object("data", "$.locale"))).alias("locale"),
        F.max(F.when(kind == "delta", at)).alias("last_delta"),
        first("sources").alias("sources"), F.count_if(kind == "sources").alias("n_sources"),
        first("done").alias("done"), F.count_if(kind == "done").alias("n_done"),
        first("error").alias("error"),
        F.max((kind == "delta") & text.has_visible(
            F.coalesce(F.get_json_object("data", "$.text"), F.lit("")))).alias("visible"),
        F.max(~F.coalesce(kind.isin("start", "delta", "sources", "done", "error"), F.lit(False))).alias("unknown"),
    )
    far = F.lit(2 ** 62)
    or_far = lambda name: F.coalesce(F.col(name), far)
    started = F.coalesce(F.col("start") == 0, F.lit(False))
    if locales is not None:
        stats = stats.join(locales.select("resp_id", F.col("locale").alias("asked")), "resp_id", "left")
        started = started & F.coalesce(F.col("locale") == F.col("asked"), F.lit(False))
    stopped = F.col("error").isNotNull() & (or_far("error") < or_far("restart")) & (
        or_far("error") < or_far("sources")) & (or_far("error") < or_far("done"))
    ordered = (
        F.col("error").isNull() & F.col("restart").isNull() & (F.col("n_sources") == 1)
        & (F.col("n_done") == 1) & (F.coalesce("last_delta", F.lit(-1)) < F.col("sources"))
        & (F.col("sources") < F.col("done")) & (F.col("done") == F.col("last")))
    unfinished = (
        F.col("error").isNull() & F.col("restart").isNull() & (F.col("n_done") == 0)
        & (F.col("n_sources") <= 1) & (F.coalesce("last_delta", F.lit(-1)) < or_far("sources"))
        & (F.col("sources").isNull() | (F.col("sources") == F.col("last"))))
    reason = (
        F.when(F.col("unknown"), "unknown_type").when(~started, "bad_start")
        .when(stopped, "public_error").when(unfinished, "missing_done")
        .when(~F.coalesce(ordered, F.lit(False)), "bad_order")
        .when(~F.col("visible"), "no_visible_answer").otherwise("complete"))
    return stats.select("resp_id", (reason == "complete").alias("ok"), reason.alias("reason"))


def check_stream_limits(bodies: DataFrame) -> DataFrame:
    """Findings per response: event bytes, stream bytes, output code points.

    The output limit is crossed at some event exactly when the total crosses it. Bodies are read once: blocks become
    rows, only those that can be a delta are parsed, and of these only the lengths are added up per response.
    """
    block = F.col("block")
    blocks = _placed_blocks(bodies, (F.octet_length("body") > STREAM_BYTES).alias("_long"))
    # The same deltas as parse_event_streams finds: an event name and data, both complete.
    named = F.col("terminated") & block.contains("delta") & block.contains("event") & block.contains("data")
    lines = blocks.withColumn("_lines", F.when(named, F.split("block", "\n", -1)))
    datas = lines.withColumn("_data", F.when(
        F.try_element_at(_field_values(F.col("_lines"), "event"), F.lit(-1)) == "delta", _field_values(F.col("_lines"), "data")))
    data = datas.withColumn("_data", F.when(F.size("_data") > 0, F.array_join("_data", "\n")))
    told = data.withColumn("_n", F.when(F.try_parse_json("_data").isNotNull(), F.char_length(
        F.coalesce(F.get_json_object("_data", "$.text"), F.lit(""))).cast("bigint")))

    def found(rule: str, broken: Column, detail: Column, n: Column) -> Column:
        return F.when(broken, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"), n.cast("bigint").alias("n")))

    none = F.lit(None)
    findings = told.select("resp_id", F.inline(F.array_compact(F.array(
        found("event_bytes", (F.octet_length("block") > EVENT_BYTES) & _is_event(), F.col("seq"), none),
        found("stream_bytes", (F.col("seq") == 0) & F.col("_long"), none, none),
        found("output_code_points", F.col("_n").isNotNull(), none, F.col("_n"))))))
    # Lengths are added up; every other finding is a group of its own.
    turn = F.when(F.col("rule") != "output_code_points", F.monotonically_increasing_id())
    added = findings.withColumn("_turn", turn).groupBy("rule", "resp_id", "detail", "_turn").agg(F.sum("n").alias("n"))
    return added.filter(F.col("n").isNull() | (F.col("n") > OUTPUT_CODE_POINTS)).select(
        "rule", F.col("resp_id").cast("string").alias("key"), F.coalesce("detail", F.col("n").cast("string")).alias("detail"))


def _units(c: Column) -> Column:
    """UTF-16 code units, in which the provider's limits are stated."""
    return F.char_length(c) + F.char_length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def check_completion_limits(bodies: DataFrame) -> DataFrame:
    """Findings per provider response up to its end: characters of a line, of an event's data, of the output, and
    bytes of the stream."""
    key = F.col("resp_id")
    body = _unix_lines(F.col("body"))
    # A text has no more units than bytes, so few lines and groups are looked into; values are shorter than their group.
    long_line = F.exists(F.split(body, "\n", -1), lambda line: F.when(
        F.octet_length(line) > LINE_CHARS, _units(line) > LINE_CHARS).otherwise(False))
    long_event = F.exists(F.split(body, "\n\n+", -1), lambda g: F.when(
        F.octet_length(g) > COMPLETION_EVENT_CHARS,
        _units(F.array_join(_field_values(F.split(g, "\n", -1), "data"), "\n")) > COMPLETION_EVENT_CHARS).otherwise(False))
    output = parse_completion_streams(bodies).filter("type = 'delta'").groupBy("resp_id").agg(
        F.sum(F.char_length("text")).alias("n"))
    # One pass for the rules of whole bodies.
    return union_all([
        row_violations(bodies, key, {
            "line_chars": long_line, "event_chars": long_event, "stream_bytes": F.octet_length("body") > STREAM_BYTES}),
        violations(output.filter(F.col("n") > OUTPUT_CODE_POINTS), "output_code_points", key, F.col("n")),
    ])


def parse_completion_streams(bodies: DataFrame) -> DataFrame:
    """Provider ``resp_id, body`` to (resp_id, seq, type, text, input_tokens,
    output_tokens, cache_hit_tokens, error).

    Events end at ``[DONE]``; the last usage is reported once, right before it.
    """
    datas = F.transform(
        F.filter(F.split(_unix_lines(F.col("body")), "\n\n+", -1), lambda g: F.when(
            g.contains("data"), g.rlike("(?m)^data(:|$)")).otherwise(False)),
        lambda g: F.when(~g.contains("\n") & g.startswith("data: "), F.substring(g, F.lit(7), F.char_length(g))).otherwise(
            F.array_join(_field_values(F.split(g, "\n", -1), "data"), "\n")))
    done_at = F.array_position(F.transform("events", lambda d: F.when(
        d.contains("[DONE]"), text.js_trim(d) == "[DONE]").otherwise(False)), F.lit(True))
    rows = bodies.select("resp_id", datas.alias("events")).withColumn("done_at", done_at)
    live = F.when(F.col("done_at") > 0, F.slice("events", F.lit(1), F.greatest(F.col("done_at").cast("int") - 1, F.lit(0)))
                  ).otherwise(F.col("events"))

    count = lambda d, name: F.get_json_object(d, f"$.usage.{name}")
    # The JSON type at a path, VOID for a null and empty where there is nothing.
    kind = lambda v, path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))

    def bad_usage(d: Column, v: Column) -> Column:
        number = lambda name: kind(v, f"$.usage.{name}").rlike(f"^{_NUMBER}$") & _safe_integer(count(d, name))
        return (~number("prompt_tokens") | ~number("completion_tokens")
                | ((kind(v, "$.usage.prompt_cache_hit_tokens") != "") & ~number("prompt_cache_hit_tokens")))

    def usage_of(d: Column) -> Column:
        """The usage of an event, null where it has none. A name may be written with escapes."""
        number = lambda name: count(d, name).cast("double").cast("bigint")
        return F.when(d.contains("usage") | d.contains("\\u"), F.when(
            F.get_json_object(d, "$.usage").isNotNull() & ~bad_usage(d, F.try_parse_json(d)), F.struct(
                number("prompt_tokens").alias("i"), number("completion_tokens").alias("o"),
                number("prompt_cache_hit_tokens").alias("c"))))

    nothing = {"t": F.lit(None).cast("string"), "n": F.lit(None).cast("bigint")}

    def row(seq: Column, type_: str | None, data: Column = nothing["t"], usage: Column | None = None,
            error: Column = nothing["t"]) -> Column:
        part = lambda name: usage[name] if usage is not None else nothing["n"]
        return F.struct(
            seq.cast("int").alias("seq"), F.lit(type_).cast("string").alias("type"), data.alias("data"),
            part("i").alias("input_tokens"), part("o").alias("output_tokens"),
            part("c").alias("cache_hit_tokens"), error.alias("error"))

    rows = rows.select("resp_id", "done_at", live.alias("live"))
    rows = rows.withColumn("usage", F.try_element_at(
        F.filter(F.transform("live", usage_of), lambda u: u.isNotNull()), F.lit(-1)))
    end = F.size("live")
    closing = F.when(
        F.col("done_at") > 0,
        F.concat(
            F.when(F.col("usage").isNotNull(), F.array(row(end, "usage", usage=F.col("usage")))).otherwise(
                F.slice(F.array(row(end, "usage")), 1, 0)),
            F.array(row(end + 1, "done")))
    ).otherwise(F.array(row(end, "error", error=F.lit("missing_done"))))
    # Events become rows before they are judged, so each is parsed once.
    placed = rows.select("resp_id", F.inline(F.concat(F.transform("live", lambda d, i: row(i, None, d)), closing)))
    event = F.col("type").isNull()
    data, tree = F.col("data"), F.col("_tree")
    parsed = placed.withColumn("_tree", F.when(event, F.try_parse_json("data"))).withColumn(
        "_usage", F.when(event & (data.contains("usage") | data.contains("\\u")), F.get_json_object("data", "$.usage")))
    judged = parsed.withColumn("_choices", kind(tree, "$.choices")).withColumn("_content", kind(tree, "$.choices[0].delta.content"))
    bad_choice = (F.col("_choices") != "") & (
        ~F.col("_choices").startswith("ARRAY")
        | ((kind(tree, "$.choices[0]") != "") & ~kind(tree, "$.choices[0].delta").startswith("OBJECT"))
        | ~F.col("_content").isin("", "VOID", "STRING"))
    bad = tree.isNull() | ~kind(tree, "$").startswith("OBJECT") | bad_choice | F.when(
        F.col("_usage").isNotNull(), bad_usage(data, tree)).otherwise(False)
    described = judged.select(
        "resp_id", "seq", "type", "input_tokens", "output_tokens", "cache_hit_tokens", "error",
        F.when(event, F.coalesce(bad, F.lit(True))).alias("_bad"),
        F.when(F.col("_content") == "STRING", F.try_variant_get(tree, "$.choices[0].delta.content", "string")).alias("_text"))
    # Rows come out of an array, as a filter here or in a caller would move below the parsing and repeat it.
    shown = lambda type_, value, error: F.array(F.struct(
        "seq", type_.alias("type"), value.alias("text"), "input_tokens", "output_tokens", "cache_hit_tokens", error.alias("error")))
    same = shown(F.col("type"), nothing["t"], F.col("error"))
    return described.select("resp_id", F.inline(
        F.when(F.col("_bad").isNull(), same)
        .when(F.col("_bad"), shown(F.lit("error"), nothing["t"], F.lit("malformed_response")))
        .when(F.col("_text") != "", shown(F.lit("delta"), F.col("_text"), nothing["t"])).otherwise(F.slice(same, 1, 0))))
