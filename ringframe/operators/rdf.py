"""Radial distribution of positive change against each cell's first frame: evolution, fronts, velocity, dynamics, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import line_fit, parabola, pick_first, r_squared


def evolution(rows: DataFrame, sectors: bool = False) -> DataFrame:
    """Per cell: baseline (the value at its first frame, null if that is null), change, its positive part, density and running sum.

    Density is the share of a (hole, frame[, sector])'s positive change and null where there is none; nulls count 0 in the
    running sum. The radius is scaled by the largest annulus present there, 1 at least. One shuffle for the baselines, one
    for the shares, whose windows have one sort.
    """
    extra = ["sector_id"] if sectors else []
    first = Window.partitionBy("hole_id", *extra, "annulus_id").orderBy("frame_id")
    group = Window.partitionBy("hole_id", *extra, "frame_id")
    running = group.orderBy("annulus_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    delta = rows.withColumn("baseline_descriptor_value", F.first("descriptor_value").over(first))
    delta = delta.withColumn("delta_descriptor_value", F.col("descriptor_value") - F.col("baseline_descriptor_value"))
    positive = F.when(F.col("delta_descriptor_value").isNotNull(), F.greatest(F.col("delta_descriptor_value"), F.lit(0.0)))
    out = (
        delta.withColumn("positive_delta_descriptor", positive)
        .withColumn("total", F.coalesce(F.sum("positive_delta_descriptor").over(group), F.lit(0.0)))
        .withColumn("normalized_radius", F.col("annulus_id") / F.greatest(F.max("annulus_id").over(group), F.lit(1)).cast("double"))
        .withColumn("rdf_pdf", F.when(F.col("total") > 0, F.col("positive_delta_descriptor") / F.col("total")))
    )
    return out.withColumn("rdf_cdf", F.sum(F.coalesce("rdf_pdf", F.lit(0.0))).over(running))


def frame_summary(evo: DataFrame) -> DataFrame:
    """Per (hole, frame): front radius, spread, total, peak annulus (first of equals), inner and outer change, first frame of the innermost cell."""
    some = F.max("total") > 0
    per = evo.groupBy("hole_id", "frame_id").agg(
        F.when(some, F.sum(F.col("normalized_radius") * F.col("rdf_pdf"))).alias("rdf_front_radius_norm"),
        F.when(some, F.sum(F.col("normalized_radius") * F.col("normalized_radius") * F.col("rdf_pdf"))).alias("_second"),
        F.min("annulus_id").alias("_innermost"),
        F.max("total").alias("rdf_total_positive_delta"),
        F.when(some, pick_first("annulus_id", "positive_delta_descriptor", "annulus_id")).alias("rdf_peak_annulus"),
        F.min_by("delta_descriptor_value", "annulus_id").alias("rdf_inner_delta"),
        F.max_by("delta_descriptor_value", "annulus_id").alias("rdf_outer_delta"),
    )
    variance = F.col("_second") - F.col("rdf_front_radius_norm") * F.col("rdf_front_radius_norm")
    spread = F.when(variance > 1e-12, F.sqrt(variance)).otherwise(0.0)  # below is the rounding of the two squares
    return (
        per.withColumn("rdf_spread_norm", F.when(F.col("_second").isNotNull(), spread))
        .withColumn("rdf_inner_minus_outer_delta", F.col("rdf_inner_delta") - F.col("rdf_outer_delta"))
        .withColumn("baseline_frame_id", F.min(F.struct("_innermost", "frame_id")).over(Window.partitionBy("hole_id"))["frame_id"])
        .drop("_second", "_innermost")
    )


def front_velocity(frames: DataFrame) -> DataFrame:
    """Per hole the straight fit of its front over frames (one frame: no slope, R² 1), first and last front, their difference."""
    known = frames.where("rdf_front_radius_norm IS NOT NULL")
    fit = line_fit("frame_id", "rdf_front_radius_norm")
    agg = known.groupBy("hole_id").agg(
        *[v.alias(f"_{k}") for k, v in fit.items()],
        F.min_by("rdf_front_radius_norm", "frame_id").alias("start_front_radius_norm"),
        F.max_by("rdf_front_radius_norm", "frame_id").alias("end_front_radius_norm"),
    )
    one = F.col("_n") == 1
    return agg.select(
        "hole_id",
        F.when(one, F.lit(0.0)).otherwise(F.col("_slope")).alias("rdf_front_velocity_per_frame"),
        F.when(one, F.col("start_front_radius_norm")).otherwise(F.col("_intercept")).alias("rdf_front_intercept"),
        F.when(one, F.lit(1.0)).when(F.col("_slope").isNotNull(), r_squared(F.col("_residual"), F.col("_total"))).alias("rdf_front_velocity_r2"),
        "start_front_radius_norm",
        "end_front_radius_norm",
        (F.col("end_front_radius_norm") - F.col("start_front_radius_norm")).alias("delta_front_radius_norm"),
        F.col("_n").alias("n_frames"),
    )


def front_dynamics(frames: DataFrame) -> DataFrame:
    """Per hole: straight and quadratic fit of the front over frames, acceleration, and what the curve explains beyond the line."""
    known = frames.where("rdf_front_radius_norm IS NOT NULL").select("hole_id", "frame_id", "rdf_front_radius_norm")
    both = parabola(known, ["hole_id"], "frame_id", "rdf_front_radius_norm", line=True)
    linear = F.when(F.col("_slope").isNotNull(), r_squared(F.col("_residual"), F.col("_total")))
    curved = r_squared(F.col("qres"), F.col("qtot"))
    return both.select(
        "hole_id",
        F.col("_slope").alias("rdf_linear_velocity_per_frame"),
        linear.alias("rdf_linear_velocity_r2"),
        F.col("a").alias("rdf_quadratic_a"),
        F.col("b").alias("rdf_quadratic_b"),
        F.col("c").alias("rdf_quadratic_c"),
        curved.alias("rdf_quadratic_r2"),
        (2 * F.col("a")).alias("rdf_front_acceleration_per_frame2"),
        (curved - linear).alias("rdf_front_nonlinearity_gain"),
        F.col("_n").alias("n_frames"),
    )


def archetype_features(frames: DataFrame, keys: tuple[str, ...] = ("hole_id",)) -> DataFrame:
    """Per hole (or per `keys`) the six features that archetypes are made of; the front's change is null unless its first and last frame have one."""
    first, last = F.min_by("rdf_front_radius_norm", "frame_id"), F.max_by("rdf_front_radius_norm", "frame_id")
    return frames.groupBy(*keys).agg(
        F.avg("rdf_front_radius_norm").alias("mean_front_radius_norm"),
        (last - first).alias("delta_front_radius_norm"),
        F.stddev_pop("rdf_front_radius_norm").alias("front_radius_std_norm"),
        F.avg("rdf_spread_norm").alias("mean_rdf_spread_norm"),
        F.avg("rdf_total_positive_delta").alias("mean_rdf_total_positive_delta"),
        F.avg(F.abs("rdf_inner_minus_outer_delta")).alias("mean_abs_inner_minus_outer_delta"),
        F.count(F.lit(1)).alias("n_frames"),
    )
