from pyspark.sql import functions as F

from evidentia.operators import common, dialogue, eventlog
from evidentia.streaming.citations import split_visible


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")


def test_citations(spark):
    texts = ["one[[S2]] two", "[[S2]]p[[S1]]q[[S2]]r", "u[[T1]]v[[S9]]w[[S1,S2]]x[[S1]]y", "m[1] left [[S"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    allowed = F.array(*[F.lit(s) for s in ("S1", "S2", "S9")])
    got = [(r["c"]["text"], r["c"]["source_ids"]) for r in frame.orderBy("i").select(
        dialogue.extract_citations(F.col("t"), allowed).alias("c")).collect()]
    assert got == [("one two", ["S2"]), ("pqr", ["S2", "S1"]), ("uvwxy", ["S1"]), ("m[1] left [[S", [])]


def test_streamed_citations_do_not_depend_on_the_cut():
    for whole in ("one[[S2]] two", "k[[[S3]]]l[[m", "[[S4]][[S1]] [", "[ [[ ]] ]]"):
        want, _, markers = split_visible(whole, True)
        for i in range(len(whole) + 1):
            for j in range(i, len(whole) + 1):
                out, pending, seen = "", "", []
                for n, piece in enumerate((whole[:i], whole[i:j], whole[j:])):
                    visible, pending, found = split_visible(pending + piece, n == 2)
                    out, seen = out + visible, seen + found
                assert (out, seen) == (want, markers)


def test_history_rules_and_window(spark):
    pair = lambda c, n, u="q", a="a": [(c, 2 * n, "user", f"{u} {n}"), (c, 2 * n + 1, "assistant", f"{a} {n}")]
    rows = [r for n in range(11) for r in pair(1, n)]
    rows += [(2, 0, "assistant", "x"), (2, 1, "user", "y")]
    rows += [(3, 0, "user", "x")]
    rows += [(4, 0, "system", "x"), (4, 1, "assistant", "y")]
    rows += [(5, 0, "user", "​ ⁠"), (5, 1, "assistant", "y")]
    rows += [(6, 0, "user", "x" * 601), (6, 1, "assistant", "y")]
    rows += [(7, 0, "user", "​"), (7, 1, "assistant", "y")] + [
        (7, t + 2, r, x) for n in range(10) for t, r, x in [(2 * n, "user", "q"), (2 * n + 1, "assistant", "a")]]
    frame = conversation(spark, rows)
    codes = {r["conv_id"]: r["error_code"] for r in dialogue.check_history(frame).collect()}
    assert codes == {1: None, 2: "invalid_history", 3: "invalid_history", 4: "invalid_history_role",
                     5: "invalid_history", 6: "history_message_too_long", 7: "invalid_history"}
    window = dialogue.history_window(frame).orderBy("turn").collect()
    assert len(window) == 20 and window[0]["text"] == "q 1" and {r["conv_id"] for r in window} == {1}


def test_append_caps_and_keeps_ten_pairs(spark):
    turns = spark.createDataFrame(
        [(1, n, f"{n}:" + "😀" * 700, "a" * 700) for n in range(11)] + [(1, 20, "​", "a")],
        "conv_id int, seq int, user_text string, assistant_text string")
    got = dialogue.append_turns(conversation(spark, []), turns).orderBy("slot").collect()
    assert len(got) == 20 and got[0]["text"].startswith("1:") and all(len(r["text"]) <= 600 for r in got)
    assert [r["slot"] for r in got] == list(range(20))


def test_request_rules_apply_in_order(spark):
    schema = "i int, message string, session_id string, history array<struct<role:string,content:string>>, locale string"
    ok = [("user", "q"), ("assistant", "a")]
    rows = [(None, "bad", None, ""), ("​", "bad", None, ""), ("x" * 601, "bad", None, ""), ("x", "short", None, ""),
            ("x", "session-1", None, ""), ("x", "session-1", [("bot", "x")], ""), ("x", "session-1", ok[:1], ""),
            ("x", "session-1", ok, "fr"), ("x" * 600, "session-1", [], "zh-CN")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    got = [r["error_code"] for r in dialogue.validate_requests(frame).orderBy("i").collect()]
    assert got == ["invalid_body", "empty_message", "message_too_long", "invalid_session_id", "invalid_history",
                   "invalid_history_role", "invalid_history", "invalid_locale", None]


def test_event_stream_rows(spark):
    body = ('event: start\r\ndata: {"locale":"zh"}\r\n\r\n:ping\nevent: delta\nid: 4\ndata: {"text":\ndata: "x"}\n\n'
            'event: sources\rdata: {"sources":[]}\r\revent: done\ndata: {}\n\n')
    frame = spark.createDataFrame([("a", body), ("b", body + "event: x"), ("c", "event: y\n\n")], "resp_id string, body string")
    rows = eventlog.parse_event_streams(frame).orderBy("resp_id", "seq").collect()
    assert [(r["type"], r["error"]) for r in rows if r["resp_id"] == "a"] == [
        ("start", None), ("delta", None), ("sources", None), ("done", None)]
    assert rows[1]["data"] == '{"text":\n"x"}'
    assert [r["error"] for r in rows if r["resp_id"] == "b"][-1] == "incomplete_tail"
    assert {r["resp_id"] for r in eventlog.parse_event_streams(frame, strict=True).collect()} == {"a"}
    verdicts = {r["resp_id"]: r["reason"] for r in eventlog.check_protocol(
        eventlog.parse_event_streams(frame).filter("error IS NULL")).collect()}
    assert verdicts["a"] == "complete"


def test_long_histories_are_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "TURN_BLOCK", 3)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(40)]
    assert dialogue.check_history(conversation(spark, rows)).first()["error_code"] is None
    rows[23] = (1, 23, "user", "x")
    assert dialogue.check_history(conversation(spark, rows)).first()["error_code"] == "invalid_history"


def test_blocks_keep_control_characters_and_know_their_end(spark):
    frame = spark.createDataFrame([("a", "event: x\ndata: 1\u0004\n\n"), ("b", "event: x\ndata: 1\u0004")], "resp_id string, body string")
    found = {r["resp_id"]: (r["block"][-1], r["terminated"]) for r in eventlog.event_blocks(frame).collect()}
    assert found == {"a": ("\u0004", True), "b": ("\u0004", False)}


def test_token_counts_may_be_written_as_any_whole_number(spark):
    values = {"5": True, "5.0": True, "1e2": True, "9007199254740991": True, "5.5": False, "-1": False, '"5"': False, "9007199254740992": False}
    rows = [(v, 0, "done", f'{{"inputTokens": {v}}}') for v in values]
    frame = spark.createDataFrame(rows, "resp_id string, seq int, type string, data string")
    bad = eventlog.check_events(frame).collect()
    assert len(bad) == sum(not good for good in values.values())
    assert all(any(str(v) in r["key"] for v, good in values.items() if not good) for r in bad)


def test_completion_chunks_of_wrong_types_are_malformed(spark):
    usage = '{"choices": [], "usage": {"prompt_tokens": %s, "completion_tokens": 1}}'
    cases = {'{"choices": [{"delta": {"content": 5}}]}': 0, '{"choices": null}': 0, usage % '"5"': 0, usage % "9999999999999999": 0,
             '{"choices": [null]}': 0, '{"choices": [{"delta": {"content": null}}]}': 1, '{"choices": []}': 1, usage % "5.0": 1, "{}": 1,
             '{"choices": [{"delta": {"content": "x"}}]}': 1}
    frame = spark.createDataFrame([(c, f"data: {c}\n\ndata: [DONE]\n\n") for c in cases], "resp_id string, body string")
    bad = {r["resp_id"] for r in eventlog.parse_completion_streams(frame).filter("error = 'malformed_response'").collect()}
    assert bad == {c for c, good in cases.items() if not good}


def test_citations_outside_the_packet_fall_back(spark):
    packet = spark.createDataFrame([(1, "S1"), (1, "S2"), (2, "S1")], "query_id int, id string")
    answers = spark.createDataFrame([("a", 1, ["S3", "S2"]), ("b", 1, ["S7"]), ("c", 2, []), ("d", 9, ["S1"])],
                                    "resp_id string, query_id int, source_ids array<string>")
    rows = sorted((r["resp_id"], r["id"]) for r in dialogue.resolve_citations(answers, packet).collect())
    assert rows == [("a", "S2"), ("b", "S1"), ("b", "S2"), ("c", "S1")]


def test_completion_events_are_parsed_once(spark):
    from pyspark.sql import functions as F

    escaped = "{\"us\\u0061ge\": {\"prompt_tokens\": 3, \"completion_tokens\": 4}}"
    bodies = [
        ("a", 'data: {"choices":[{"delta":{"content":"x"}}]}\n\ndata: ' + escaped + "\n\ndata: [DONE]\n\ndata: {oops\n\n"),
        ("b", 'event: z\ndata: {"choices":[{"delta":\ndata: {"content":"y"}}]}\n\ndata:{"choices":[{"delta":{"content":""}}]}\n\ndata\n\n'),
        ("c", ": note\n\ndata: [1]\n\n"), (None, None), ("d", "")]
    rows = eventlog.parse_completion_streams(spark.createDataFrame(bodies, "resp_id string, body string"))
    got = {(r.resp_id, r.seq, r.type, r.text, r.input_tokens, r.output_tokens, r.error) for r in rows.collect()}
    assert got >= {
        ("a", 0, "delta", "x", None, None, None), ("a", 2, "usage", None, 3, 4, None), ("a", 3, "done", None, None, None, None),
        ("b", 0, "delta", "y", None, None, None), ("b", 2, "error", None, None, None, "malformed_response"),
        ("b", 3, "error", None, None, None, "missing_done"), ("c", 0, "error", None, None, None, "malformed_response"),
        ("c", 1, "error", None, None, None, "missing_done"), ("d", 0, "error", None, None, None, "missing_done")}
    # A filter on the rows stays above the parsing.
    plan = rows.filter(F.col("type") == "delta")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("tryparsejson") + plan.lower().count("parsejson(") + plan.lower().count("parse_json(") <= 6


def test_prompt_chunks_are_dealt_by_their_number_and_not_sorted(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_ROWS", 10)
    ids = spark.range(95).select(F.format_string("c%d", "id").alias("id"))
    assert common.dealt(ids, "id").rdd.getNumPartitions() == 10
    chunks = ids.select("id", F.concat(F.lit("text "), "id").alias("text"))
    results = spark.createDataFrame([(1, "c3"), (2, "c3"), (2, "gone")], "query_id int, chunk_id string")
    kept = dialogue._of_results(chunks.withColumnRenamed("id", "chunk_id"), results)
    assert "ShuffledHashJoin" in kept._jdf.queryExecution().toString()
    assert [r.chunk_id for r in kept.collect()] == ["c3"]


def test_stream_limits_read_a_body_once(spark, tmp_path):
    def delta(n, end="\n\n"):
        return 'event: delta\ndata: {"text":"' + "z" * n + '"}' + end

    large = ":" + "x" * 70_000 + "\n\n"
    rows = [
        (1, delta(5_000)), (1, delta(3_193)),                                # two bodies of one response
        (2, delta(8_192)), (3, delta(9_000, "\n")), (4, None), (5, ""),      # at the limit, without its end
        (6, delta(9_000).replace("\n", "\r\n")), (7, "event: delta\ndata: {broken " + "z" * 9_000 + "\n\n"),
        (8, "event:start\nevent:delta\ndata:[1,\ndata: 2]\n\n" + delta(9_000).replace("delta", "done")),
        (9, large + delta(1) + large), (9, large), (10, ":y\n\n" * 270_000), (None, delta(9_000)), (None, large), (11, "x" * 66_000),
    ]
    spark.createDataFrame(rows, "resp_id long, body string").write.parquet(str(tmp_path / "bodies"))
    found = eventlog.check_stream_limits(spark.read.parquet(str(tmp_path / "bodies")))
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    got = sorted(map(str, map(tuple, found.select("rule", "key", "detail").collect())))
    want = [("output_code_points", "1", "8193"), ("output_code_points", "6", "9000"), ("output_code_points", None, "9000"),
            ("event_bytes", "9", "0"), ("event_bytes", "9", "2"), ("event_bytes", "9", "0"), ("event_bytes", None, "0"),
            ("event_bytes", "11", "0"), ("stream_bytes", "10", None)]
    assert got == sorted(map(str, want))
