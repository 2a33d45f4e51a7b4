"""Deterministic k-means over one row per hole, semantic labels and canonical ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import settled
from ringframe.sources.scratch import checkpointed

ROUNDS = 24


def standardized(rows: DataFrame, features: list[str], scale: bool = True) -> DataFrame:
    """Null features become the column's mean (0 if all are null); with `scale`, values are centred and divided by their deviation."""
    stats = rows.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"_m_{f}") for f in features], *[F.stddev_pop(F.coalesce(F.col(f), F.lit(None))).alias(f"_d_{f}") for f in features])
    out = rows.crossJoin(F.broadcast(stats))
    filled = {f: F.coalesce(f, f"_m_{f}") for f in features}
    spread = lambda f: F.when(F.col(f"_d_{f}") > 1e-8, F.col(f"_d_{f}")).otherwise(1.0)
    value = [(filled[f] - F.col(f"_m_{f}")) / spread(f) if scale else filled[f] for f in features]
    return out.withColumn("_v", F.array(*value)).drop(*[f"_{p}_{f}" for p in "md" for f in features])


def squared(a: Column, b: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def kmeans(rows: DataFrame, features: list[str], k: int, key: str = "hole_id", scale: bool = True, seeds_by_mean: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """Add cluster_id by Lloyd's rounds from seeds at even ranks (of the key, or of the features' mean); first centre among equals.

    Rows stay distributed: a round is one pass that assigns and averages, and only the k centres come back. A round that
    changes no label ends it; if the first assignment is all zero, the seeds remain the centres.
    """
    mean = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) if seeds_by_mean else F.lit(0.0)
    ordered = standardized(rows, features, scale).select(key, "_v", mean.alias("_mean")).repartitionByRange("_mean", key)
    table = checkpointed(ordered.withColumn("_part", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in table.groupBy("_part").count().collect())
    n = sum(c for _, c in counts)
    if not n:
        return rows.withColumn("cluster_id", F.lit(0))
    k = max(1, min(k, n))
    wanted = [int(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)]
    places = []
    for at in wanted:  # the part that holds the rank, and the rank within it
        begun = 0
        for part, size in counts:
            if at < begun + size:
                places.append((part, at - begun + 1))
                break
            begun += size
    within = table.where(F.col("_part").isin([part for part, _ in places])).withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("_mean", key)))
    seeds = {(r["_part"], r["_r"]): list(r["_v"]) for r in within.where(F.struct("_part", "_r").isin([F.struct(F.lit(a), F.lit(b)) for a, b in set(places)])).collect()}
    centres = [list(seeds[place]) for place in places]

    def label(of: list[list[float]]) -> Column:
        return F.array_min(F.array(*[F.struct(squared(F.col("_v"), F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(of)]))["i"]

    before = None
    for _ in range(rounds):
        sums = table.withColumn("_c", label(centres)).groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("who"), *[F.avg(F.col("_v")[i]).alias(f"m{i}") for i in range(len(features))]).collect()
        state = sorted((r["_c"], r["n"], r["who"]) for r in sums)
        if state == before or before is None and [r["_c"] for r in sums] == [0]:
            break
        before = state
        for r in sums:
            centres[r["_c"]] = [r[f"m{i}"] for i in range(len(features))]
    return rows.join(table.select(key, label(centres).alias("cluster_id")), key)


def canonical(rows: DataFrame, features: list[str], order: list[Column], prefix: str) -> DataFrame:
    """Number clusters by their means in `order` (nulls last) and name them; the table of clusters has k rows."""
    means = rows.groupBy("cluster_id").agg(*[F.avg(f).alias(f) for f in features], F.count(F.lit(1)).alias("n_members"))
    ids = means.withColumn("canonical_id", F.row_number().over(Window.orderBy(*order, "cluster_id")) - 1)
    return ids.withColumn("canonical_label", F.concat(F.lit(prefix), F.col("canonical_id").cast("string")))


def nearest_centroid(rows: DataFrame, centroids: DataFrame, features: list[str], name: str = "label") -> DataFrame:
    """Add the label of the nearest centroid (label, features), the least among equals; missing features count as the centroids' mean.

    Centroids are as many as clusters: they meet in one row, which is joined to all rows.
    """
    means = centroids.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"_m_{f}") for f in features])
    filled = centroids.crossJoin(F.broadcast(means)).select("label", F.array(*[F.coalesce(f, f"_m_{f}") for f in features]).alias("at"))
    table = filled.agg(F.collect_list(F.struct("label", "at")).alias("_centres")).crossJoin(F.broadcast(means))
    joined = rows.crossJoin(F.broadcast(table)).withColumn("_v", F.array(*[F.coalesce(f, f"_m_{f}") for f in features]))
    near = F.array_min(F.transform("_centres", lambda c: F.struct(settled(squared(c["at"], F.col("_v"))).alias("d"), c["label"].alias("l"))))
    return joined.withColumn(name, near["l"]).drop("_v", "_centres", *[f"_m_{f}" for f in features])


def semantics(rows: DataFrame, cluster: str, shift: float = 0.35, asymmetry: float = 0.25) -> DataFrame:
    """Per cluster of hole summaries: what its mean shift and asymmetry say, and a canonical number and name in that order.

    A table of as many rows as clusters; the numbering sorts it in one place.
    """
    delta, uneven = F.col("delta_center_of_mass"), F.col("mean_angular_asymmetry")
    meaning = (
        F.when(delta.isNull(), "unknown").when(delta > shift, "outward_shift").when(delta < -shift, "inward_shift").when(uneven > asymmetry, "stable_asymmetric").otherwise("stable")
    )
    means = rows.groupBy(cluster).agg(F.avg("delta_center_of_mass").alias("delta_center_of_mass"), F.avg("mean_angular_asymmetry").alias("mean_angular_asymmetry"), F.count(F.lit(1)).alias("count"))
    named = means.withColumn("semantic_label", meaning)
    order = Window.orderBy("semantic_label", settled(F.coalesce("delta_center_of_mass", F.lit(0.0))), cluster)
    numbered = named.withColumn("canonical_id", F.row_number().over(order))
    return numbered.withColumn("canonical_label", F.concat(F.lit("R"), F.col("canonical_id").cast("string"), F.lit("_"), F.col("semantic_label")))
