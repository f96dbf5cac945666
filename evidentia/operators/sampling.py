"""Seeded acceptance sampling, integer quotas and quota-constrained bands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.common import positions

# Band shares and class thresholds.
BAND_SHARES = {"micro": 0.65, "medium": 0.25, "large": 0.08, "splash": 0.02}
STRONG_CORE = 0.18
STRONG_FACE = 0.14

_UNIFORM_BITS = 52  # 13 hexadecimal digits
_BLOCK_BITS = 40


def order_key(key: Column, seed: int) -> Column:
    """Seeded pseudo-random integer below 2^52, a function of the row key alone; any engine with SHA-256 can repeat it."""
    digest = F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(seed))), 256)
    return F.conv(F.substring(digest, 1, _UNIFORM_BITS // 4), 16, 10).cast("bigint")


def uniform(key: Column, seed: int) -> Column:
    return order_key(key, seed) / F.lit(float(2 ** _UNIFORM_BITS))


def acceptance_sample(df: DataFrame, key: Column, probability: Column, seed: int,
                      floor: Column | None = None) -> DataFrame:
    """Rows above the hard floor whose seeded draw is at most their probability.

    The draw depends on the key only, so partitioning cannot change the sample.
    """
    kept = df if floor is None else df.filter(floor)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(probability, F.lit(0.0))))
    return kept.filter(uniform(key, seed) <= clamped)


def quotas(n: int, shares: dict[str, float] = BAND_SHARES) -> dict[str, int]:
    """Largest-remainder split of ``n``; equal remainders go by share order."""
    exact = {name: n * share for name, share in shares.items()}
    counts = {name: math.floor(value) for name, value in exact.items()}
    names = list(shares)
    by_remainder = sorted(names, key=lambda s: (-(exact[s] % 1), names.index(s)))
    for name in by_remainder[: n - sum(counts.values())]:
        counts[name] += 1
    return counts


def quota_table(totals: DataFrame, shares: dict[str, float] = BAND_SHARES) -> DataFrame:
    """``totals(group, n)`` to (group, band, quota), set-at-a-time.

    The handful of shares of a group is ordered inside one array.
    """
    exact = F.array(*[
        F.struct((F.col("n") * share).alias("x"), F.lit(i).alias("i"), F.lit(name).alias("band"))
        for i, (name, share) in enumerate(shares.items())])
    parts = F.transform(exact, lambda e: F.struct(
        (F.floor(e["x"]) - e["x"]).alias("r"), e["i"].alias("i"), e["band"].alias("band"),
        F.floor(e["x"]).alias("base")))
    left = F.col("n") - F.aggregate(
        "_parts", F.lit(0).cast("bigint"), lambda acc, p: acc + p["base"])
    rows = totals.withColumn("_parts", F.array_sort(parts)).withColumn("_left", left)
    return rows.select(
        *totals.columns, F.inline(F.transform("_parts", lambda p, i: F.struct(
            p["band"].alias("band"),
            (p["base"] + F.when(i < F.col("_left"), 1).otherwise(0)).cast("bigint").alias("quota")))))


def classify(region: Column, edge_score: Column) -> Column:
    return (
        F.when(region == "edge", "edge")
        .when((region == "core") & (edge_score >= STRONG_CORE), "core_strong")
        .when(region == "core", "core_weak")
        .when((region == "face") & (edge_score >= STRONG_FACE), "face_strong")
        .otherwise("face_weak"))


def feasible_counts(counts: dict[str, int]) -> dict[str, int]:
    """Class counts after dropping the fewest rows, one class preference at a time,
    until the band quotas can be met. Only five integers are involved; long runs of
    equal drops are taken in one stride."""
    keep = {c: counts.get(c, 0) for c in ("core_strong", "core_weak", "face_strong", "face_weak", "edge")}
    while (n := sum(keep.values())) > 0:
        q = quotas(n)
        edge = keep["edge"]
        eligible = edge + keep["face_weak"]
        strong = keep["core_strong"]
        if q["splash"] > edge:
            pool = ["core_strong", "core_weak", "face_strong", "face_weak"]
            stride = n - math.ceil((edge + 2) / 0.02)
        elif q["splash"] + q["large"] > eligible:
            pool = ["core_strong", "core_weak", "face_strong"]
            stride = n - math.ceil((eligible + 4) / 0.10)
            if edge < 0.02 * n + 2:
                stride = 1
        elif strong > q["micro"]:
            pool = ["core_strong"]
            stride = math.floor((strong - 0.65 * n - 2) / 0.35)
            if edge < 0.02 * n + 2 or eligible < 0.10 * n + 4:
                stride = 1
        else:
            break
        victim = next((c for c in pool if keep[c] > 0), None)
        if victim is None:
            raise ValueError("unable to satisfy the band quotas")
        keep[victim] -= min(keep[victim], max(1, stride))
    return keep


def assign_bands(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Keep a feasible set of ``key, region, edge_score`` rows and give each a band.

    Ranks by the seeded order are taken inside slices of the hash range, so neither
    a class nor the whole set is sorted in one task.
    """
    block = 2 ** _BLOCK_BITS
    rows = df.withColumn("_class", classify(F.col("region"), F.col("edge_score"))).withColumn(
        "_order", order_key(F.col(key), seed))
    counts = {r["_class"]: r["n"] for r in rows.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = feasible_counts(counts)
    limits = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])
    kept = positions(rows, ["_class"], "_order", block, [key], "_place").filter(
        F.col("_place") < limits[F.col("_class")]).drop("_place")
    quota = quotas(sum(keep.values()))
    eligible = {
        "splash": F.col("_class") == "edge",
        "large": F.col("_class").isin("edge", "face_weak"),
        "medium": F.col("_class") != "core_strong",
    }
    assigned = kept.withColumn("band", F.lit(None).cast("string"))
    for band, condition in eligible.items():
        open_rows = condition & F.col("band").isNull()
        placed = positions(assigned.withColumn("_open", open_rows), ["_open"], "_order", block, [key], "_place")
        assigned = placed.withColumn(
            "band", F.when(F.col("_open") & (F.col("_place") < quota[band]), band).otherwise(F.col("band"))
        ).drop("_open", "_place")
    return assigned.select(*df.columns, F.coalesce("band", F.lit("micro")).alias("band"))
