"""Perturbation sweeps: measure again under other brightness and radius, and compare with the base run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringframe.operators import clusters, radial, rdf
from ringframe.sources.scratch import checkpointed

BRIGHTNESS = (0.9, 1.0, 1.1)
RADIUS = (0.9, 1.0, 1.2)


def perturbed(rows: DataFrame, brightness: tuple[float, ...] = BRIGHTNESS, radius: tuple[float, ...] = RADIUS) -> DataFrame:
    """Every sweep's rows under `sweep_id`: values scaled and clipped to 1, annuli moved outwards or inwards and averaged where they meet."""
    grid = F.array(*[F.struct(F.lit(i * len(radius) + k).alias("id"), F.lit(b).alias("b"), F.lit(r).alias("r")) for i, b in enumerate(brightness) for k, r in enumerate(radius)])
    moved = rows.withColumn("_s", F.explode(grid)).select(
        F.col("_s.id").alias("sweep_id"), F.col("_s.b").alias("brightness_scale"), F.col("_s.r").alias("radius_scale"), "hole_id", "frame_id",
        F.floor(F.col("annulus_id") * F.col("_s.r") + 1e-9).cast("int").alias("annulus_id"), F.least(F.col("descriptor_value") * F.col("_s.b"), F.lit(1.0)).alias("descriptor_value"),
    )
    return moved.groupBy("sweep_id", "brightness_scale", "radius_scale", "hole_id", "frame_id", "annulus_id").agg(F.avg("descriptor_value").alias("descriptor_value"))


def compare(rows: DataFrame) -> DataFrame:
    """Per sweep: run-level conclusion, whether it is the base's (scales of 1), centre drift, and the mean correlation of profiles by frame.

    A frame without spread on either side counts 1 if all values agree and 0 if not.
    """
    swept = perturbed(rows)
    agg = swept.groupBy("sweep_id", "brightness_scale", "radius_scale", "frame_id", "annulus_id").agg(F.avg("descriptor_value").alias("mean_descriptor"))
    keys = ["sweep_id", "brightness_scale", "radius_scale"]
    profile = radial.frame_profile(agg, [*keys, "frame_id"], "mean_descriptor")
    runs = radial.evolution_summary(profile, keys).select(*keys, "radial_conclusion_label", "delta_center_of_mass")
    is_base = (F.col("brightness_scale") == 1.0) & (F.col("radius_scale") == 1.0)
    base = runs.where(is_base).select(F.col("radial_conclusion_label").alias("_label"), F.col("delta_center_of_mass").alias("_delta"))
    a = agg.where(is_base).select("frame_id", "annulus_id", F.col("mean_descriptor").alias("x"))
    both = agg.select("sweep_id", "frame_id", "annulus_id", F.col("mean_descriptor").alias("y")).join(a, ["frame_id", "annulus_id"])
    flat = (F.stddev_pop("x") < 1e-9) | (F.stddev_pop("y") < 1e-9)
    same = F.when(F.max(F.abs(F.col("x") - F.col("y"))) < 1e-9, 1.0).otherwise(0.0)
    covariance = F.avg(F.col("x") * F.col("y")) - F.avg("x") * F.avg("y")
    corr = both.groupBy("sweep_id", "frame_id").agg(F.when(flat, same).otherwise(F.try_divide(covariance, F.stddev_pop("x") * F.stddev_pop("y"))).alias("c"))
    means = corr.groupBy("sweep_id").agg(F.avg("c").alias("profile_correlation"))
    joined = runs.crossJoin(F.broadcast(base)).join(means, "sweep_id")
    return joined.select(
        *keys, "radial_conclusion_label", (F.col("radial_conclusion_label") == F.col("_label")).alias("conclusion_stable"),
        (F.col("delta_center_of_mass") - F.col("_delta")).alias("center_drift"), "profile_correlation",
    )


def transition_candidates(scores: DataFrame) -> DataFrame:
    """Frames whose transition score reaches median + 6 MAD of all scores; one row of statistics joins all frames."""
    known = scores.where("score IS NOT NULL")
    middle = known.agg(F.median("score").alias("m"))
    spread = known.crossJoin(F.broadcast(middle)).agg(F.median(F.abs(F.col("score") - F.col("m"))).alias("mad"), F.first("m").alias("m"))
    out = known.crossJoin(F.broadcast(spread)).withColumn("threshold", F.col("m") + 6 * F.col("mad"))
    return out.select("frame_id", "score", "threshold", (F.col("score") >= F.col("threshold")).alias("is_jump"))


def reference_frame(audit: DataFrame, score: str) -> DataFrame:
    """The accepted frame of the largest score, the first among equals; the first frame of all if none is accepted. One row."""
    rank = F.when(F.col("accepted"), F.struct(F.col(score).alias("s"), (-F.col("frame_id")).alias("f")))
    return audit.agg(F.coalesce(F.max_by("frame_id", rank), F.min("frame_id")).alias("reference_frame_id"), F.coalesce(F.max("accepted"), F.lit(False)).alias("accepted"))


def curve_stability(rows: DataFrame, share: float = 0.05) -> DataFrame:
    """Per hole and frame: mean and largest distance between the radial curves under a radius less and more by `share`."""
    swept = perturbed(rows, (1.0,), (1 - share, 1 + share))
    side = lambda i, name: F.max(F.when(F.col("sweep_id") == i, F.col("descriptor_value"))).alias(name)
    pairs = swept.groupBy("hole_id", "frame_id", "annulus_id").agg(side(0, "_a"), side(1, "_b"))
    return pairs.groupBy("hole_id", "frame_id").agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mae"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs"))


def archetype_features(rows: DataFrame, brightness: tuple[float, ...] = BRIGHTNESS, radius: tuple[float, ...] = RADIUS) -> DataFrame:
    """Every sweep's features of every hole: a hole of a sweep is a hole of its own."""
    swept = perturbed(rows, brightness, radius)
    ids = swept.select(F.struct("sweep_id", "brightness_scale", "radius_scale", F.col("hole_id").alias("id")).alias("hole_id"), "frame_id", "annulus_id", "descriptor_value")
    features = rdf.archetype_features(rdf.frame_summary(rdf.evolution(ids)))
    features = checkpointed(features)
    return features.select("hole_id.sweep_id", "hole_id.brightness_scale", "hole_id.radius_scale", F.col("hole_id.id").alias("hole_id"), *[c for c in features.columns if c != "hole_id"])


def archetypes_kept(swept: DataFrame, centroids: DataFrame, features: list[str]) -> DataFrame:
    """Per sweep: the share of holes whose nearest centroid is that of the base run (scales of 1), over holes in both."""
    placed = clusters.nearest_centroid(swept, centroids, features)
    base = placed.where("brightness_scale = 1 AND radius_scale = 1").select("hole_id", F.col("label").alias("_base"))
    both = placed.join(base, "hole_id")
    return both.groupBy("sweep_id", "brightness_scale", "radius_scale").agg(F.avg((F.col("label") == F.col("_base")).cast("double")).alias("stability_fraction"), F.count(F.lit(1)).alias("n_holes"))
