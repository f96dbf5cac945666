import random

import hashlib

from evidentia.config import AdmissionPolicy
from evidentia.streaming.admission import STATE_STORE, SiteLimitedAdmission, admit_request_stream, state_rows
from tests.test_admission import DAY, T0, naive, visitor

SCHEMA = "visitor_key string, now_ms bigint, request_id string"


def test_site_limited_batches_equal_one_sequence(spark, tmp_path):
    rng = random.Random(8)
    policy = AdmissionPolicy(3_000, 60_000, 3, 4, 7)
    rows = sorted({(visitor(rng.randint(1, 4)), T0 + DAY + int(rng.gauss(0, 40_000)), f"r{i:03d}") for i in range(60)},
                  key=lambda r: (r[1], r[2]))
    sink = SiteLimitedAdmission(str(tmp_path / "charges"), str(tmp_path / "out"), policy)
    parts = [rows[:25], rows[25:45], rows[45:]]
    for n, part in enumerate(parts):
        sink(spark.createDataFrame(part, SCHEMA), n)
    sink(spark.createDataFrame(parts[2], SCHEMA), 2)  # a replayed batch replaces itself
    got = {(r[0], r[1], r[2]): (r["reason"], r["reset_at"])
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == naive(rows, policy)


def test_state_rows_without_progress():
    class Idle:
        lastProgress = None

    assert state_rows(Idle()) == {}


def test_text_digests_have_no_limit(spark):
    from workload.chat import _text_digests

    rows = [("long", k, chr(97 + k % 26) * 30_000) for k in range(40)] + [("empty", 0, ""), ("two", 1, "é"), ("two", 0, "x"), ("two", 2, None)]
    got = {r.resp_id: r.digest for r in _text_digests(spark.createDataFrame(rows[::-1], "resp_id string, seq long, text string")).collect()}
    want = {"long": "".join(t for i, _, t in rows if i == "long"), "empty": "", "two": "xé"}
    assert len(want["long"]) > 1_000_000
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def _run(stream, spark, out, name):
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/{name}-state").trigger(
        availableNow=True).format("parquet").start(f"{out}/{name}")
    query.awaitTermination()
    return query, spark.read.schema(stream.schema).parquet(f"{out}/{name}").collect()


def _source(spark, path, schema, parts):
    """One micro-batch for each part."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_silent_responses_are_closed_by_their_timer(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from evidentia.streaming.citations import strip_citation_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    at = lambda minutes: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=minutes)
    parts = [
        [("a", 0, "x[[S1", False, at(0)), ("b", 0, "y[[", False, at(0)), ("c", 0, "z[", False, at(1))],
        [("a", 1, "]]y", True, at(2)), ("c", 1, "[S2]]!", False, at(2)), ("d", 0, "end [[S", False, at(3))],
        [("d", 1, "3]] on", False, at(20)), ("clock", 0, "", True, at(25))],
        [("clock", 1, "", True, at(600))],
    ]
    stream = strip_citation_stream(_source(spark, str(tmp_path / "in"), "resp_id string, seq long, text string, final boolean, ts timestamp", parts),
                                   timeout_ms=600_000)
    query, rows = _run(stream, spark, str(tmp_path), "out")
    text = {}
    for r in sorted(rows, key=lambda r: (r.resp_id, r.seq, r.closing)):
        text[r.resp_id] = text.get(r.resp_id, "") + r.text
    # "d" came back only after its time was up, so its marker was text by then.
    assert text == {"a": "xy", "b": "y[[", "c": "z!", "d": "end [[S3]] on", "clock": ""}
    assert sum(state_rows(query).values()) == 0


def test_visitor_state_expires(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    policy = AdmissionPolicy(3_000, 60_000, 2, 4, 100)
    rng = random.Random(3)
    rows = sorted({(visitor(i % 9), T0 + DAY + rng.randint(0, 90_000), f"r{i:03d}") for i in range(60)}, key=lambda r: (r[1], r[2]))
    closing = (visitor("z"), T0 + 20 * DAY, "closing")
    stream = admit_request_stream(_source(spark, str(tmp_path / "in"), SCHEMA, [rows[:30], rows[30:], [closing]]), policy)
    query, got = _run(stream, spark, str(tmp_path), "out")
    assert {(r[0], r[1], r[2]): (r["reason"], r["reset_at"]) for r in got if r[2] != "closing"} == naive(rows, policy)
    held = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]
    assert max(held) > 20 and held[-1] <= 4


def test_metrics_in_append_mode_count_late_rows(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from evidentia.streaming.metrics import late_rows, metrics_stream

    at = lambda minutes: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=minutes)
    row = lambda minutes: (at(minutes), "ok", 1.0, 1, 1, 1)
    schema = "ts timestamp, status string, latency_ms double, input_tokens int, output_tokens int, retrieval_count int"
    parts = [[row(0), row(59), row(61)], [row(200)], [row(201)], [row(5), row(190)], [row(600)]]
    stream = metrics_stream(_source(spark, str(tmp_path / "in"), schema, parts), "1 hour", "10 minutes")
    query, got = _run(stream, spark, str(tmp_path), "out")
    assert sorted(r.requests for r in got) == [1, 2, 3] and late_rows(query) == 1


class _Store:
    """A state handle of one key in memory that counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.state = 0, set(), {}

    def getValueState(self, name, schema):
        store = self

        class Value:
            def get(self):
                store.calls += 1
                return store.state.get(name)

            def update(self, row):
                store.calls += 1
                store.state[name] = row

            def clear(self):
                store.calls += 1
                store.state.pop(name, None)

        return Value()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class _Times:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_calls_of_the_state_store_do_not_grow_with_charges():
    from pyspark.sql import Row

    from evidentia.streaming.admission import VisitorAdmission

    policy = AdmissionPolicy(10, DAY, 1_000, 1_000, 10 ** 9)
    processor, store = VisitorAdmission(policy), _Store()
    processor.init(store)
    allowed, worst = 0, 0
    for batch in range(5):
        rows = [Row(now_ms=T0 + DAY + batch * 10_000 + 20 * k, request_id=f"r{batch}-{k}") for k in range(100)]
        before = store.calls
        allowed += sum(r.allowed for r in processor.handleInputRows((visitor(1),), iter(rows[::-1]), None))
        worst = max(worst, store.calls - before)
        assert len(store.timers) == 1
    assert allowed == 500 and worst <= 8
    while store.timers:  # a fired timer is gone; the last one leaves nothing
        at = store.timers.pop()
        assert list(processor.handleExpiredTimer((visitor(1),), _Times(at), _Times(at))) == []
    assert store.state == {}


def test_a_response_without_held_text_asks_the_store_once():
    from pyspark.sql import Row

    from evidentia.streaming.citations import CitationStripper

    row = lambda seq, text, final, at: Row(seq=seq, text=text, final=final, at_ms=at)
    processor, store = CitationStripper(1_000), _Store()
    processor.init(store)
    run = lambda *rows: [(r.seq, r.text) for r in processor.handleInputRows(("a",), iter(rows), None)]
    assert run(row(1, "b[[S1]]", False, 5), row(0, "a", False, 4)) == [(0, "a"), (1, "b")]
    assert store.calls == 1
    assert run(row(2, "c[[", False, 10)) == [(2, "c")] and store.timers == {1_010}
    assert run(row(3, "S2]]d", False, 20)) == [(3, "d")] and store.timers == set() and store.state == {}
    assert run(row(4, "e[", False, 30)) == [(4, "e")] and store.timers == {1_030}
    store.timers.clear()
    assert [(r.seq, r.closing, r.text) for r in processor.handleExpiredTimer(("a",), _Times(1_030), _Times(1_030))] == [(4, True, "[")]
    assert store.state == {}
