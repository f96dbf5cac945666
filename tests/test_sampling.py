import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import sampling


def test_quotas_are_exact():
    for n in (7_000, 14_000, 1, 3, 50, 99):
        q = sampling.quotas(n)
        assert sum(q.values()) == n
    assert sampling.quotas(7_000) == {"micro": 4_550, "medium": 1_750, "large": 560, "splash": 140}
    assert sampling.quotas(14_000) == {"micro": 9_100, "medium": 3_500, "large": 1_120, "splash": 280}


def drop_one_at_a_time(counts):
    keep = dict(counts)
    while (n := sum(keep.values())) > 0:
        q = sampling.quotas(n)
        if q["splash"] > keep["edge"]:
            pools = ["core_strong", "core_weak", "face_strong", "face_weak"]
        elif q["splash"] + q["large"] > keep["edge"] + keep["face_weak"]:
            pools = ["core_strong", "core_weak", "face_strong"]
        elif keep["core_strong"] > q["micro"]:
            pools = ["core_strong"]
        else:
            return keep
        keep[next(p for p in pools if keep[p])] -= 1
    return keep


@pytest.mark.parametrize("seed", range(40))
def test_strided_drops_equal_single_drops(seed):
    rng = random.Random(seed)
    classes = ("core_strong", "core_weak", "face_strong", "face_weak", "edge")
    counts = {c: int(rng.choice([0, 3, 30, 300, 2_000]) * rng.random()) for c in classes}
    try:
        want = drop_one_at_a_time(counts)
    except StopIteration:
        with pytest.raises(ValueError):
            sampling.feasible_counts(counts)
        return
    assert sampling.feasible_counts(counts) == want


def test_bands_follow_the_seeded_order(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["core", "core", "face", "edge"]), round(rng.random() * 0.3, 3)) for i in range(700)]
    frame = spark.createDataFrame(rows, "id bigint, region string, edge_score double")
    order = {r[0]: r[1] for r in frame.select("id", sampling.order_key(F.col("id"), 3)).collect()}
    kind = {r["id"]: r["c"] for r in frame.select("id", sampling.classify(F.col("region"), F.col("edge_score")).alias("c")).collect()}
    keep = drop_one_at_a_time({c: sum(k == c for k in kind.values()) for c in (
        "core_strong", "core_weak", "face_strong", "face_weak", "edge")})
    ranked = sorted(order, key=lambda i: (order[i], i))
    alive, used = [], {}
    for i in ranked:
        used[kind[i]] = used.get(kind[i], 0) + 1
        if used[kind[i]] <= keep[kind[i]]:
            alive.append(i)
    quota, want = sampling.quotas(len(alive)), {}
    for band, ok in (("splash", {"edge"}), ("large", {"edge", "face_weak"}),
                     ("medium", {"edge", "face_weak", "face_strong", "core_weak"})):
        open_ids = [i for i in alive if i not in want and kind[i] in ok]
        want.update({i: band for i in open_ids[: quota[band]]})
    want.update({i: "micro" for i in alive if i not in want})
    got = {r["id"]: r["band"] for r in sampling.assign_bands(frame.repartition(5), "id", 3).collect()}
    assert got == want


def test_acceptance_ignores_partitioning(spark):
    frame = spark.range(2_000).withColumn("p", F.lit(0.3))
    one = sampling.acceptance_sample(frame.coalesce(1), F.col("id"), F.col("p"), 5, F.col("id") >= 100)
    many = sampling.acceptance_sample(frame.repartition(7), F.col("id"), F.col("p"), 5, F.col("id") >= 100)
    ids = sorted(r["id"] for r in one.collect())
    assert ids == sorted(r["id"] for r in many.collect())
    assert min(ids) >= 100 and 400 < len(ids) < 740
