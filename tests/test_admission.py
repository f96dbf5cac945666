import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evidentia.config import AdmissionPolicy
from evidentia.operators import admission

DAY = 86_400_000
T0 = 20_000 * DAY - 8 * 3_600_000  # a UTC+8 midnight


def visitor(n):
    return hashlib.sha256(str(n).encode()).hexdigest()


def naive(rows, policy):
    """One request at a time, in total order."""
    until, entries, days, site = {}, {}, {}, {}
    out = {}
    for key, now, request in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        day = (now + 8 * 3_600_000) // DAY
        end = (day + 1) * DAY - 8 * 3_600_000
        recent = {r: t for r, t in entries.get(key, {}).items() if t >= now - policy.window_ms}
        if now < until.get(key, 0):
            verdict = ("cooldown", until[key])
        elif request in recent:
            verdict = ("minute", recent[request] + policy.window_ms + 1)
        elif len(recent) >= policy.window_limit:
            verdict = ("minute", min(recent.values()) + policy.window_ms + 1)
        elif days.get((key, day), 0) >= policy.visitor_day_limit:
            verdict = ("visitor_day", end)
        elif site.get(day, 0) >= policy.site_day_limit:
            verdict = ("site_day", end)
        else:
            until[key] = now + policy.cooldown_ms
            entries[key] = {**recent, request: now}
            days[key, day] = days.get((key, day), 0) + 1
            site[day] = site.get(day, 0) + 1
            verdict = (None, until[key])
        out[key, now, request] = verdict
    return out


def run(spark, rows, policy, parts=3, **kwargs):
    frame = spark.createDataFrame(rows, "visitor_key string, now_ms bigint, request_id string").repartition(parts)
    return {(r[0], r[1], r[2]): (r["reason"], r["reset_at"])
            for r in admission.admit_requests(frame, policy, **kwargs).collect()}


@pytest.mark.parametrize("seed,policy", [
    (1, AdmissionPolicy(3_000, 60_000, 3, 5, 12)),
    (2, AdmissionPolicy(40_000, 60_000, 2, 4, 9)),
])
def test_matches_the_sequential_model(spark, seed, policy):
    rng = random.Random(seed)
    rows = set()
    for _ in range(400):
        # Bunches around three midnights, so that charges spill into the next day.
        now = T0 + rng.randint(1, 3) * DAY + int(rng.gauss(0, 60_000))
        rows.add((visitor(rng.randint(1, 6)), now // 500 * 500, f"r{rng.randint(1, 150):03d}"))
    assert run(spark, sorted(rows), policy) == naive(rows, policy)


def test_default_boundaries(spark):
    policy = AdmissionPolicy()
    day_end = T0 + DAY
    a, b, c = visitor("a"), visitor("b"), visitor("c")
    rows = [(a, T0, "a1"), (a, T0 + 2_999, "a2"), (a, T0 + 3_000, "a3")]
    rows += [(b, T0 + t, f"b{t}") for t in (0, 3_000, 6_000, 9_000, 12_000, 15_000, 18_000, 60_000, 60_001)]
    rows += [(c, T0 + i * 60_001, f"c{i}") for i in range(31)]
    got = run(spark, rows, policy)
    assert [got[r][0] for r in rows[:3]] == [None, "cooldown", None]
    assert got[rows[1]] == ("cooldown", T0 + 3_000)
    assert [got[r] for r in rows[9:12]] == [
        ("minute", T0 + 60_001), ("minute", T0 + 60_001), (None, T0 + 63_001)]
    assert [got[r][0] for r in rows[12:42]] == [None] * 30
    assert got[rows[42]] == ("visitor_day", day_end)


def test_site_limit_does_not_charge_the_rejected_visitor(spark):
    rows = [(visitor(i), T0, f"r{i:03d}") for i in range(301)]
    rows.append((rows[300][0], T0 + DAY, "next"))
    got = run(spark, rows, AdmissionPolicy())
    assert [got[r][0] for r in rows[:300]] == [None] * 300
    assert got[rows[300]] == ("site_day", T0 + DAY)
    assert got[rows[301]][0] is None


def test_repeated_rows_and_earlier_charges(spark):
    policy = AdmissionPolicy(3_000, 60_000, 6, 2, 300)
    v = visitor("v")
    frame = spark.createDataFrame([(v, T0, "x")] * 2, "visitor_key string, now_ms bigint, request_id string")
    assert sorted(str(r["reason"]) for r in admission.admit_requests(frame, policy).collect()) == ["None", "cooldown"]
    prior = spark.createDataFrame(
        [(v, 20_000, T0 + 1, "p1"), (v, 20_000, T0 + 5_000, "p2")],
        "visitor_key string, day bigint, now_ms bigint, request_id string")
    got = run(spark, [(v, T0 + 7_000, "a"), (v, T0 + 9_000, "b")], policy, prior=prior)
    assert [got[k][0] for k in sorted(got, key=lambda k: k[1])] == ["cooldown", "visitor_day"]


@pytest.mark.parametrize("piece, policy", [
    (500, AdmissionPolicy(0, 1_000, 2, 6, 20)), (1_000, AdmissionPolicy(700, 5_000, 3, 1_000, 1_000)), (250, AdmissionPolicy(0, 1_000, 2, 9, 13))])
def test_a_busy_visitor_in_many_pieces(spark, monkeypatch, piece, policy):
    monkeypatch.setattr(admission, "PIECE_MS", piece)
    monkeypatch.setattr(admission, "PIECE_MEMORIES", 0)
    rng = random.Random(piece)
    rows = {(visitor(rng.choice([1, 1, 1, 2])), T0 + rng.choice([0, DAY - 3_000]) + rng.randint(0, 60) * 100, f"r{rng.randint(1, 60):02d}")
            for _ in range(300)}
    assert run(spark, sorted(rows), policy) == naive(rows, policy)


def test_windows_longer_than_a_day(spark):
    policy = AdmissionPolicy(2 * DAY + 5, 3 * DAY, 2, 5, 50)
    rng = random.Random(6)
    rows = {(visitor(rng.randint(1, 3)), T0 + rng.randint(0, 12 * 24) * (DAY // 24), f"r{rng.randint(1, 30):02d}") for _ in range(120)}
    assert run(spark, sorted(rows), policy) == naive(rows, policy)


def test_input_and_policy_checks(spark):
    rows = [(visitor(1), 5, "ok"), ("x", 5, "ok2"), (visitor(2), -1, "ok3"), (visitor(3), 5, "has space")]
    frame = spark.createDataFrame(rows, "visitor_key string, now_ms bigint, request_id string")
    found = {(r["rule"], r["key"]) for r in admission.check_admission_input(frame).collect()}
    assert found == {("visitor_key", "ok2"), ("timestamp", "ok3"), ("request_id", "has space")}
    for bad in (dict(cooldown_ms=-1), dict(window_ms=0), dict(site_day_limit=0), dict(window_limit=1.5)):
        with pytest.raises(ValueError):
            AdmissionPolicy(**bad)
    with pytest.raises(ValueError):
        AdmissionPolicy(visitor_day_limit=3).require_ordered()
