"""Phenotypes: what the propagation features of a cluster of holes say, canonical names, stability over jittered reruns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import settled
from ringframe.operators.clusters import kmeans, squared, standardized
from ringframe.sources.scratch import checkpointed

# The meanings in their order.
MEANINGS = ("outward_propagating", "near_synchronous", "outer_first", "irregular")
FEATURES = ["onset_slope_per_annulus", "peak_slope_per_annulus", "onset_monotonic_fraction", "peak_monotonic_fraction", "onset_lag_frames", "peak_lag_frames"]


def meaning(onset: Column, peak: Column, monotonic: Column) -> Column:
    """The rule on a cluster's means; one without an onset slope is irregular."""
    outward = (onset >= 0.5) & (peak >= 0.5) & (monotonic >= 0.75)
    return F.when(outward, MEANINGS[0]).when((F.abs(onset) < 0.35) & (F.abs(peak) < 0.35), MEANINGS[1]).when(onset < 0, MEANINGS[2]).otherwise(MEANINGS[3])


def centroids(rows: DataFrame, cluster: list[str]) -> DataFrame:
    """Per cluster: its size, its features' means over known values, and its meaning (`label`)."""
    means = rows.groupBy(*cluster).agg(F.count(F.lit(1)).alias("count"), *[settled(F.avg(f)).alias(f) for f in FEATURES])
    return means.withColumn("label", meaning(*(F.col(f) for f in FEATURES[:3])))


def named(rows: DataFrame, cluster: str) -> DataFrame:
    """Centroids numbered from 1 by meaning, onset slope, peak slope (nulls last), falling monotonic share and id: P{number}_{meaning}.

    The table has a row for each cluster, and is sorted in one place.
    """
    place = F.array_position(F.array(*map(F.lit, MEANINGS)), F.col("label"))
    order = [place, F.asc_nulls_last(FEATURES[0]), F.asc_nulls_last(FEATURES[1]), F.desc_nulls_last(FEATURES[2]), F.col(cluster)]
    numbered = centroids(rows, [cluster]).withColumn("canonical_id", F.row_number().over(Window.orderBy(*order)))
    return numbered.withColumn("canonical_label", F.concat(F.lit("P"), F.col("canonical_id").cast("string"), F.lit("_"), F.col("label")))


def assign(rows: DataFrame, k: int = 3) -> DataFrame:
    """Holes with their cluster by k-means on scaled features, its meaning, and its canonical number and name (also the phenotype)."""
    placed = kmeans(rows, FEATURES, k)
    names = named(placed, "cluster_id").select("cluster_id", F.col("label").alias("semantic_label"), "canonical_id", "canonical_label", F.col("canonical_label").alias("phenotype_label"))
    return placed.join(F.broadcast(names), "cluster_id")


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from a hash: the same on every run."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2147483647)) + 0.5) / 2147483647.0


def _reruns(rows: DataFrame, key: str, k: int, n_reruns: int, jitter: float, rounds: int = 20) -> DataFrame:
    """(rerun, key, cluster_id): k-means of all reruns at once on jittered features, seeded by the row of least hash in each of k buckets.

    A round is one aggregate over all reruns, of which n_reruns x k centres come back.
    """
    spark = rows.sparkSession
    unit = lambda r, i: F.sqrt(-2 * F.log(_uniform(F.col(key), r, F.lit(i), F.lit(0)))) * F.cos(2 * math.pi * _uniform(F.col(key), r, F.lit(i), F.lit(1)))
    copies = standardized(rows, FEATURES).select(key, F.explode(F.sequence(F.lit(0), F.lit(n_reruns - 1))).alias("rerun"), "_v")
    table = copies.withColumn("_v", F.array(*[F.col("_v")[i] + jitter * unit(F.col("rerun"), i) for i in range(len(FEATURES))]))
    table = checkpointed(table)
    turn = F.xxhash64(F.lit("seed"), key, "rerun")
    seeds = table.groupBy("rerun", F.pmod(turn, F.lit(k)).alias("_b")).agg(F.min(F.struct(turn.alias("t"), "_v")).alias("s")).collect()
    centres: dict[int, list[list[float]]] = {}
    for r in sorted(seeds, key=lambda r: (r["rerun"], r["_b"])):
        centres.setdefault(r["rerun"], []).append(list(r["s"]["_v"]))

    def labelled() -> DataFrame:
        at = spark.createDataFrame(list(centres.items()), "rerun int, _at array<array<double>>")
        far = F.transform("_at", lambda c, i: F.struct(squared(F.col("_v"), c).alias("d"), i.alias("i")))
        return table.join(F.broadcast(at), "rerun").withColumn("cluster_id", F.array_min(far)["i"])

    for _ in range(rounds if centres else 0):
        means = labelled().groupBy("rerun", "cluster_id").agg(*[settled(F.avg(F.col("_v")[i])).alias(f"m{i}") for i in range(len(FEATURES))]).collect()
        before = {r: [list(c) for c in cs] for r, cs in centres.items()}
        for m in means:
            centres[m["rerun"]][m["cluster_id"]] = [m[f"m{i}"] for i in range(len(FEATURES))]
        if centres == before:
            break
    return labelled().select("rerun", key, "cluster_id") if centres else table.select("rerun", key, F.lit(0).alias("cluster_id"))


def _apart(a: dict, b: dict) -> float:
    known = [(a[f] - b[f]) ** 2 for f in FEATURES if a[f] is not None and b[f] is not None]
    return math.sqrt(sum(known) / len(known)) if known else math.inf


def matched(base: list[dict], found: list[dict]) -> dict[int, str]:
    """A rerun's clusters under the base's names: each base cluster in canonical order takes the nearest free one, of its meaning if there is one."""
    free, names = {c["cluster_id"]: c for c in found}, {}
    for b in sorted(base, key=lambda b: b["canonical_id"]):
        alike = [c for c in free.values() if c["label"] == b["label"]] or list(free.values())
        if alike:
            best = min(alike, key=lambda c: (_apart(b, c), c["cluster_id"]))
            names[free.pop(best["cluster_id"])["cluster_id"]] = b["canonical_label"]
    return names | {i: f"UNMATCHED_{c['label']}" for i, c in free.items()}


def stability(rows: DataFrame, k: int = 3, n_reruns: int = 5, jitter: float = 0.03, key: str = "hole_id") -> DataFrame:
    """Per hole: its phenotype, the name and meaning most reruns give it (the least among equals), their shares, and how many names it had.

    Only centroids (k for the base and for each rerun) are matched on the driver. An empty table gives an empty one.
    """
    rows = checkpointed(rows.select(key, *FEATURES))
    base = assign(rows, k)
    known = [r.asDict() for r in named(base, "cluster_id").collect()]
    placed = _reruns(rows, key, k, n_reruns, jitter).join(rows, key)
    found: dict[int, list[dict]] = {}
    for r in centroids(placed, ["rerun", "cluster_id"]).collect():
        found.setdefault(r["rerun"], []).append(r.asDict())
    names = [(rerun, i, name, next(c["label"] for c in cs if c["cluster_id"] == i)) for rerun, cs in found.items() for i, name in matched(known, cs).items()]
    table = rows.sparkSession.createDataFrame(names, "rerun int, cluster_id int, name string, sense string")
    voted = placed.select(key, "rerun", "cluster_id").join(F.broadcast(table), ["rerun", "cluster_id"])
    sides = []
    for side, column in (("rerun_label", "name"), ("rerun_semantic_label", "sense")):
        counts = voted.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
        sides.append(counts.groupBy(key).agg(F.min_by(column, F.struct((-F.col("n")).alias("n"), column)).alias(f"dominant_{side}"), (F.max("n") / F.sum("n")).alias(f"_{column}_share"), F.count(F.lit(1)).alias(f"_{column}s"), F.sum("n").alias(f"_{column}_reruns")))
    both = base.select(key, F.col("phenotype_label").alias("base_phenotype_label"), F.col("semantic_label").alias("base_semantic_label")).join(sides[0], key).join(sides[1], key)
    return both.select(
        key, "base_phenotype_label", "base_semantic_label", "dominant_rerun_label", "dominant_rerun_semantic_label", F.col("_name_share").alias("stability_fraction"),
        F.col("_sense_share").alias("semantic_stability_fraction"), F.col("_names").alias("n_unique_labels"), F.col("_name_reruns").alias("reruns"),
        (F.col("base_phenotype_label") == F.col("dominant_rerun_label")).alias("base_matches_dominant"),
    )
