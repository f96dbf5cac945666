"""Streaming admission.

Per-visitor rules keep keyed state in the state store. The site-day limit spans
all keys; where it matters, ``SiteLimitedAdmission`` runs the exact batch operator
on each micro-batch with the charges admitted so far.

Event time is only as ordered as the watermark allows: rows later than it are
dropped, while a single-process limiter simply trusts its clock.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.config import AdmissionPolicy
from evidentia.functions.text import day_number
from evidentia.operators.admission import DAY_MS, admit_requests
from evidentia.operators.common import materialized

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RETENTION_MS = 2 * DAY_MS
OUTPUT = "visitor_key string, now_ms bigint, request_id string, allowed boolean, reason string, reset_at bigint"
_OFFSET_MS = 28_800_000
_VERDICT = Row("visitor_key", "now_ms", "request_id", "allowed", "reason", "reset_at")


class VisitorAdmission(StatefulProcessor):
    """Cooldown, rolling window and visitor-day rules of one visitor.

    Visitors are many and have few requests a batch, so requests come as rows; a data frame each costs more. Every call of the state store is a message to the JVM, so a visitor has three values, each read and written at
    most once in a batch. The first one exists as long as the others and remembers the time of the visitor's only timer.
    """

    def __init__(self, policy: AdmissionPolicy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at bigint, timer bigint")
        self.entries = handle.getValueState("entries", "request_ids array<string>, ats array<bigint>")
        self.days = handle.getValueState("days", "days array<bigint>, counts array<bigint>, lasts array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        policy = self.policy
        requests = sorted(((row.now_ms, row.request_id) for row in rows), key=lambda r: (r[0], r[1] is None, r[1] or ""))
        until, timer, days, entries = loaded = self._load()
        days, out = {day: list(held) for day, held in days.items()}, []
        for now, request in requests:
            day = (now + _OFFSET_MS) // DAY_MS
            day_end = (day + 1) * DAY_MS - _OFFSET_MS
            if until is not None and now < until:
                out.append((now, request, False, "cooldown", until))
                continue
            entries = {r: at for r, at in entries.items() if at >= now - policy.window_ms}
            if request in entries:
                out.append((now, request, False, "minute", entries[request] + policy.window_ms + 1))
            elif len(entries) >= policy.window_limit:
                out.append((now, request, False, "minute", min(entries.values()) + policy.window_ms + 1))
            elif days.get(day, [0, 0])[0] >= policy.visitor_day_limit:
                out.append((now, request, False, "visitor_day", day_end))
            else:
                until = now + policy.cooldown_ms
                entries[request] = now
                days[day] = [days.get(day, [0, 0])[0] + 1, now]
                out.append((now, request, True, None, until))
        self._store(loaded, until, timer, days, entries)
        return iter([_VERDICT(key[0], *row) for row in out])

    def _load(self):
        known = self.until.get()
        if known is None:
            return None, None, {}, {}
        entries, days = self.entries.get(), self.days.get()
        return (known[0], known[1], {day: [n, last] for day, n, last in zip(*days)} if days else {},
                dict(zip(*entries)) if entries else {})

    def _store(self, loaded, until, timer, days, entries) -> None:
        """Write what has changed and move the timer to the earliest moment at which some of it expires."""
        ends = [at + self.policy.window_ms + 1 for at in entries.values()]
        ends += [last + RETENTION_MS for _, last in days.values()]
        if until is not None:
            ends.append(until)
        wanted = min(ends, default=None)
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        rows = (
            (self.until, (loaded[0], loaded[1]) if loaded[1] is not None else None, (until, wanted) if ends else None),
            (self.days, loaded[2], days and (list(days), *map(list, zip(*days.values()))) if days != loaded[2] else loaded[2]),
            (self.entries, loaded[3], entries and (list(entries), list(entries.values())) if entries != loaded[3] else loaded[3]))
        for state, old, new in rows:
            if new and new != old:
                state.update(new)
            elif old and not new:
                state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Everything the watermark has passed goes at once; a timer set here fires one micro-batch later.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        until, _, days, entries = loaded = self._load()
        # The timer that fired is gone.
        self._store(
            loaded, until if until is not None and until > now else None, None,
            {day: held for day, held in days.items() if held[1] + RETENTION_MS > now},
            {request: at for request, at in entries.items() if at >= now - self.policy.window_ms})
        return iter([])

    def close(self) -> None:
        pass


def admit_request_stream(requests: DataFrame, policy: AdmissionPolicy = AdmissionPolicy(),
                         delay: str = "10 seconds") -> DataFrame:
    """Per-visitor admission of a stream of ``visitor_key, now_ms, request_id``.

    Needs the RocksDB state store (``STATE_STORE``).
    """
    timed = requests.withColumn("ts", F.timestamp_millis("now_ms")).withWatermark("ts", delay)
    return timed.groupBy("visitor_key").transformWithState(
        VisitorAdmission(policy), OUTPUT, "Append", "EventTime")


class SiteLimitedAdmission:
    """``foreachBatch`` target with all four limits.

    Charges of recent days live in ``charges_path``, one folder per batch id, so a
    replayed batch overwrites its own result and sees the charges it saw before.
    """

    def __init__(self, charges_path: str, output_path: str,
                 policy: AdmissionPolicy = AdmissionPolicy()) -> None:
        self.charges_path, self.output_path, self.policy = charges_path, output_path, policy

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialized(batch.select("visitor_key", "now_ms", "request_id"), "batch")
        first = batch.agg(F.min("now_ms")).first()[0]
        if first is None:
            return
        schema = "visitor_key string, day bigint, now_ms bigint, request_id string, batch_id bigint"
        prior = (
            spark.createDataFrame([], schema) if batch_id == 0 or not self._exists(spark)
            else spark.read.schema(schema).parquet(self.charges_path)
        ).filter((F.col("batch_id") < batch_id) & (F.col("now_ms") >= first - RETENTION_MS)).drop("batch_id")
        labelled = materialized(admit_requests(batch, self.policy, prior=prior), "labelled")
        labelled.write.mode("overwrite").parquet(f"{self.output_path}/batch_id={batch_id}")
        labelled.filter("allowed").select(
            "visitor_key", day_number(F.col("now_ms")).alias("day"), "now_ms", "request_id",
        ).write.mode("overwrite").parquet(f"{self.charges_path}/batch_id={batch_id}")

    def _exists(self, spark) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.charges_path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def state_rows(query) -> dict[str, int]:
    """Rows held per stateful operator, from the last progress report."""
    progress = query.lastProgress or {}
    return {
        f"{n}:{op['operatorName']}": op["numRowsTotal"]
        for n, op in enumerate(progress.get("stateOperators", []))
    }
