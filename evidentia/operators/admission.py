"""Exact admission of a request table under cooldown, window and day limits.

Requests are ordered by (time, request id, visitor). Rules apply in order:
cooldown, repeated id or full rolling window, visitor day, site day; only
admitted requests charge state.

The unit of work is a piece: one visitor in a part of one day, so a busy visitor is spread over tasks. Parts are
``PIECE_MEMORIES`` times as long as charges are remembered, but no shorter than ``PIECE_MS``. A piece depends on earlier ones through the charges that are still remembered when it begins. All pieces are
folded at once as if nothing were remembered; then the charges that survive the day limits are carried to all
pieces they reach, however many days ahead, and only pieces whose carried charges changed are folded again.
Where that happens twice, the rest of such a visitor's day is folded in order by one stream. Day limits need no
fold: the first charges of a day up to its limit stand, and none after them does. Pieces become exact from the
first one on, which bounds the rounds; usually the second changes little or nothing.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.config import AdmissionPolicy
from evidentia.functions.text import day_number, day_reset
from evidentia.operators.common import (
    fold_sorted,
    materialized,
    positions,
    row_violations,
    top_per,
)

DAY_MS = 86_400_000
BLOCK_MS = 60_000
PIECE_MS = 900_000  # divides a day
PIECE_MEMORIES = 8
_DAY = ["visitor_key", "day"]
_UNIT = ["visitor_key", "day", "piece"]
_CHARGE = "visitor_key string, day bigint, now_ms bigint, request_id string"


def check_admission_input(requests: DataFrame) -> DataFrame:
    return row_violations(requests, F.col("request_id"), {
        "visitor_key": ~F.coalesce(F.col("visitor_key").rlike("^[a-f0-9]{64}$"), F.lit(False)),
        "timestamp": F.coalesce(F.col("now_ms"), F.lit(-1)) < 0,
        "request_id": ~F.coalesce(F.col("request_id").rlike("^[!-~]{1,128}$"), F.lit(False)),
    })


def _fold_step(policy: AdmissionPolicy, keys: list[str]):
    """Admitted requests of each unit. Rows arrive sorted by unit and order; only
    the state of the current unit is held."""
    cooldown, window = policy.cooldown_ms, policy.window_ms
    window_limit, day_limit = policy.window_limit, policy.visitor_day_limit

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, until, entries, count = None, None, deque(), 0
        for batch in batches:
            out = []
            for key, visitor, day, now, request, carried in zip(
                zip(*[batch[k] for k in keys]), batch["visitor_key"], batch["day"], batch["now_ms"], batch["request_id"], batch["carried"],
            ):
                if key != unit:
                    unit, until, entries, count = key, None, deque(), 0
                if carried:
                    entries.append((now, request))
                    until = now + cooldown
                    continue
                # More than a day's limit cannot stand.
                if count >= day_limit or until is not None and now < until:
                    continue
                while entries and entries[0][0] < now - window:
                    entries.popleft()
                if len(entries) >= window_limit or any(r == request for _, r in entries):
                    continue
                until = now + cooldown
                entries.append((now, request))
                count += 1
                out.append((visitor, day, now, request))
            yield pd.DataFrame(out, columns=["visitor_key", "day", "now_ms", "request_id"])

    return step


def _pieces_of_day(policy: AdmissionPolicy) -> int:
    shortest = DAY_MS // PIECE_MS
    longest = max(1, min(shortest, DAY_MS // max(1, PIECE_MEMORIES * policy.memory_ms)))
    return next(n for n in range(longest, 0, -1) if DAY_MS % n == 0)


def _piece(now: Column, policy: AdmissionPolicy) -> Column:
    """Parts of local days in order, numbered over all days."""
    n = _pieces_of_day(policy)
    day = day_number(now)
    return day * n + F.floor((now - day_reset(day - 1)) / F.lit(DAY_MS // n)).cast("bigint")


def _fold(rows: DataFrame, carried: DataFrame, policy: AdmissionPolicy, keys: list[str]) -> DataFrame:
    marked = rows.withColumn("carried", F.lit(0)).unionByName(carried.withColumn("carried", F.lit(1)))
    charges = fold_sorted(marked, keys, ["now_ms", "request_id"], _fold_step(policy, keys), _CHARGE)
    return charges.withColumn("piece", _piece(F.col("now_ms"), policy))


def _within_limits(charges: DataFrame, prior: DataFrame, policy: AdmissionPolicy) -> DataFrame:
    """Charges up to each visitor's day limit and each day's site limit, in total order. Site ranks are taken
    inside minutes, so a day is not sorted in one task."""
    marked = charges.withColumn("_old", F.lit(False)).unionByName(prior.withColumn("_old", F.lit(True)))
    own = top_per(marked, _DAY, [F.col("now_ms"), F.col("request_id")], policy.visitor_day_limit, "_r").drop("_r")
    placed = positions(own, ["day"], "now_ms", BLOCK_MS, ["request_id", "visitor_key"], "_position")
    return placed.filter((F.col("_position") < policy.site_day_limit) & ~F.col("_old")).select(
        *charges.columns)


def _reached(charges: DataFrame, policy: AdmissionPolicy, after: int) -> DataFrame:
    """Charges under every later piece they can still matter in; ``after`` 0 includes their own."""
    first, last = F.col("piece") + after, _piece(F.col("now_ms") + policy.memory_ms, policy)
    pieces = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return charges.select("visitor_key", F.explode(pieces).alias("piece"), "now_ms", "request_id").withColumn(
        "day", F.floor(F.col("piece") / _pieces_of_day(policy)).cast("bigint"))


def admitted_requests(requests: DataFrame, policy: AdmissionPolicy,
                      prior: DataFrame | None = None) -> DataFrame:
    """(visitor_key, day, now_ms, request_id, piece) of the requests that are admitted.

    ``prior`` holds charges admitted by earlier, older input.
    """
    rows = materialized(requests.select(
        "visitor_key", day_number(F.col("now_ms")).alias("day"), _piece(F.col("now_ms"), policy).alias("piece"), "now_ms", "request_id"), "requests")
    units = materialized(rows.select(*_UNIT).distinct(), "units")
    old = (rows.filter(F.lit(False)) if prior is None else prior.withColumn("piece", _piece(F.col("now_ms"), policy))).select(
        *_DAY, "now_ms", "request_id", "piece")
    fixed = _reached(old, policy, 0).join(units, _UNIT, "left_semi")
    carried = materialized(fixed, "carried")
    folded = materialized(_fold(rows, carried, policy, _UNIT), "charges")
    turn = 0
    while True:
        within = materialized(_within_limits(folded, old, policy), "admitted")
        following = materialized(
            _reached(within, policy, 1).join(units, _UNIT, "left_semi").unionByName(fixed), "carried")
        signed = following.withColumn("_sign", F.lit(1)).unionByName(carried.withColumn("_sign", F.lit(-1)))
        changed = signed.groupBy(*carried.columns).agg(F.sum("_sign").alias("_sign")).filter("_sign <> 0")
        changed = materialized(changed.select(*_UNIT).distinct(), "changed")
        if changed.isEmpty():
            return within
        if turn == 0:
            keys, again = _UNIT, [t.join(changed, _UNIT, "left_semi") for t in (rows, following)]
            kept = folded.join(changed, _UNIT, "left_anti")
        else:
            # From the first changed piece of a visitor's day on, in order.
            since = changed.groupBy(*_DAY).agg(F.min("piece").alias("_since"))
            keys, again = _DAY, [
                rows.join(since, _DAY).filter("piece >= _since").drop("_since"),
                following.join(since, _DAY).filter("piece = _since").drop("_since")]
            kept = folded.join(since, _DAY, "left").filter("_since IS NULL OR piece < _since").drop("_since")
        folded = materialized(kept.unionByName(_fold(*again, policy, keys)), "charges")
        carried, turn = following, turn + 1


def _verdict(policy: AdmissionPolicy) -> tuple[Column, Column, Column, Column]:
    """Earlier charges, those in the window, own admission, and (reason, reset_at)."""
    now, request = F.col("now_ms"), F.col("request_id")
    before = F.filter("charges", lambda c: (c["now_ms"] < now) | ((c["now_ms"] == now) & (
        (c["request_id"] < request) | ((c["request_id"] == request) & (F.col("_copy") > 1)))))
    admitted = F.exists("charges", lambda c: (c["now_ms"] == now) & (c["request_id"] == request)) & (
        F.col("_copy") == 1)
    last = F.array_max(F.transform("_before", lambda c: c["now_ms"]))
    recent = F.filter("_before", lambda c: c["now_ms"] >= now - policy.window_ms)
    repeated = F.array_max(F.transform(
        F.filter("_recent", lambda c: c["request_id"] == request), lambda c: c["now_ms"]))
    oldest = F.array_min(F.transform("_recent", lambda c: c["now_ms"]))
    today = F.size(F.filter("_before", lambda c: day_number(c["now_ms"]) == F.col("day")))
    reset = day_reset(F.col("day"))
    outcome = lambda reason, at: F.struct(F.lit(reason).alias("reason"), at.cast("bigint").alias("reset_at"))
    verdict = (
        F.when(last + policy.cooldown_ms > now, outcome("cooldown", last + policy.cooldown_ms))
        .when(repeated.isNotNull(), outcome("minute", repeated + policy.window_ms + 1))
        .when(F.size("_recent") >= policy.window_limit, outcome("minute", oldest + policy.window_ms + 1))
        .when(today >= policy.visitor_day_limit, outcome("visitor_day", reset))
        .when(F.col("_admitted"), outcome(None, now + policy.cooldown_ms))
        .otherwise(outcome("site_day", reset)))
    return before, recent, admitted, verdict


def _with_copies(rows: DataFrame) -> DataFrame:
    """Add ``_copy``: 1 for the first of equal requests, 2 for every other one.

    Groups of equal requests are only ever counted. Where some exist, rows get a
    stored number and meet the smallest one of their group by that number.
    """
    keys = ["visitor_key", "now_ms", "request_id"]
    if rows.groupBy(*keys).count().filter("count > 1").isEmpty():
        return rows.withColumn("_copy", F.lit(1))
    numbered = materialized(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    first = numbered.groupBy(*keys).agg(F.min("_row").alias("_row")).select("_row", F.lit(1).alias("_first"))
    return numbered.join(first, "_row", "left").withColumn(
        "_copy", F.coalesce("_first", F.lit(2))).drop("_row", "_first")


def admit_requests(requests: DataFrame, policy: AdmissionPolicy = AdmissionPolicy(),
                   prior: DataFrame | None = None, charges: DataFrame | None = None) -> DataFrame:
    """Add ``allowed``, ``reason`` and ``reset_at`` to ``visitor_key, now_ms,
    request_id`` rows; other columns are carried along."""
    if charges is None:
        charges = admitted_requests(requests, policy, prior)
    known = charges.select(*_DAY, "now_ms", "request_id")
    if prior is not None:
        known = known.unionByName(prior.select(*_DAY, "now_ms", "request_id"))
    known = known.withColumn("piece", _piece(F.col("now_ms"), policy))
    today = known.select(*_DAY, "now_ms", "request_id")
    # Charges of earlier days that are still remembered, once per day they reach.
    before = _reached(known, policy, 1).select(*_DAY, "now_ms", "request_id").filter(
        F.col("day") > day_number(F.col("now_ms"))).distinct()
    # At most a day limit of charges and the carried window per visitor and day.
    per_day = today.unionByName(before).groupBy(*_DAY).agg(
        F.collect_list(F.struct("now_ms", "request_id")).alias("charges"))
    placed = requests.withColumn("day", day_number(F.col("now_ms"))).withColumn("piece", _piece(F.col("now_ms"), policy))
    units = placed.select(*_UNIT).distinct()
    complete = materialized(units.join(per_day, _DAY, "left").withColumn("charges", F.coalesce(
        "charges", F.array().cast("array<struct<now_ms:bigint,request_id:string>>"))), "unit-charges")
    joined = _with_copies(placed).join(complete, _UNIT).drop("piece")
    before, recent, admitted, verdict = _verdict(policy)
    labelled = (
        joined.withColumn("_admitted", admitted).withColumn("_before", before)
        .withColumn("_recent", recent).withColumn("_v", verdict))
    return labelled.select(
        *[F.col(c) for c in requests.columns],
        F.col("_v.reason").isNull().alias("allowed"),
        F.col("_v.reason").alias("reason"), F.col("_v.reset_at").alias("reset_at"))


def state_sizes(charges: DataFrame, now_ms: int, policy: AdmissionPolicy = AdmissionPolicy(),
                retention_ms: int = 2 * DAY_MS) -> DataFrame:
    """Live entries per kind of state at a point in time."""
    at = F.lit(now_ms)
    seen = charges.filter(F.col("now_ms") <= at)
    per_visitor = seen.groupBy("visitor_key").agg(
        F.max("now_ms").alias("last"),
        F.count_if(F.col("now_ms") >= at - policy.window_ms).alias("recent"))
    visitors = per_visitor.agg(
        F.count_if(F.col("last") + policy.cooldown_ms > at).alias("cooldowns"),
        F.count_if(F.col("recent") > 0).alias("window_visitors"),
        F.coalesce(F.sum("recent"), F.lit(0)).alias("window_entries"))
    alive = lambda keys: seen.groupBy(*keys).agg(F.max("now_ms").alias("last")).filter(
        F.col("last") + retention_ms > at).agg(F.count(F.lit(1)).alias("n")).scalar()
    return visitors.select(
        "cooldowns", "window_visitors", "window_entries",
        alive(_DAY).alias("visitor_day_buckets"), alive(["day"]).alias("site_day_buckets"))
