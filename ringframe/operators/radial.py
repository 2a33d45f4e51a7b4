"""Radial profiles: frame and hole summaries, run-level evolution, zones, model fits, angular asymmetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import TINY, parabola, pick_first, r_squared, weighted_centre, settled

SHIFT = 0.35
ASYMMETRIC = 0.25


def frame_profile(rows: DataFrame, keys: list[str], value: str = "descriptor_value") -> DataFrame:
    """Per group of `keys`: centre of mass over annuli, first annulus of the largest value, innermost minus outermost, mean, std, n."""
    low, centre = weighted_centre("annulus_id", value, keys)
    known = F.when(F.col(value).isNotNull(), F.col("annulus_id"))
    return (
        rows.withColumn("_low", low)
        .groupBy(*keys)
        .agg(
            centre.alias("center_of_mass_annulus"),
            pick_first("annulus_id", value, "annulus_id").alias("peak_annulus"),
            F.when(F.count(value) >= 2, F.min_by(value, known) - F.max_by(value, known)).alias("inner_minus_outer"),
            F.avg(value).alias("mean_descriptor"),
            F.stddev_pop(value).alias("std_descriptor"),
            F.count(value).alias("n_valid_annuli"),
        )
    )


def conclusion(delta: Column) -> Column:
    return F.when(delta.isNull(), "insufficient").when(delta > SHIFT, "outward_shift").when(delta < -SHIFT, "inward_shift").otherwise("stable")


def evolution_summary(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """From frame profiles: first and last known centre and peak, change, range, mean contrast, and a label by the change (+-0.35)."""
    com, peak = "center_of_mass_annulus", "peak_annulus"
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("frame_id"))
    out = profiles.groupBy(*keys).agg(
        F.min_by(com, at(com)).alias("start_center_of_mass"),
        F.max_by(com, at(com)).alias("end_center_of_mass"),
        (F.max(com) - F.min(com)).alias("center_of_mass_range"),
        F.min_by(peak, at(peak)).alias("start_peak_annulus"),
        F.max_by(peak, at(peak)).alias("end_peak_annulus"),
        F.avg("inner_minus_outer").alias("mean_inner_minus_outer"),
        F.count(F.lit(1)).alias("n_frames"),
    )
    delta = F.col("end_center_of_mass") - F.col("start_center_of_mass")
    return out.withColumn("delta_center_of_mass", delta).withColumn("radial_conclusion_label", conclusion(F.col("delta_center_of_mass")))


def aggregate(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.avg("descriptor_value").alias("mean_descriptor"), F.stddev_pop("descriptor_value").alias("std_descriptor"), F.count("descriptor_value").alias("n_holes")
    )


def zones(holes: DataFrame) -> DataFrame:
    """(hole_id, reticulum_zone): corner, edge or interior by the lattice's extent, which is one row and joined to all holes."""
    place = F.max(F.struct("lattice_u", "lattice_v")).alias("_p")  # one place for a hole: the largest, if it is listed with several
    known = holes.where("lattice_u IS NOT NULL AND lattice_v IS NOT NULL").groupBy("hole_id").agg(place).select("hole_id", "_p.lattice_u", "_p.lattice_v")
    extent = known.agg(F.min("lattice_u").alias("u0"), F.max("lattice_u").alias("u1"), F.min("lattice_v").alias("v0"), F.max("lattice_v").alias("v1"))
    on_u, on_v = F.col("lattice_u").isin(F.col("u0"), F.col("u1")), F.col("lattice_v").isin(F.col("v0"), F.col("v1"))
    zone = F.when(on_u & on_v, "corner").when(on_u | on_v, "edge").otherwise("interior")
    return known.crossJoin(F.broadcast(extent)).select("hole_id", zone.alias("reticulum_zone"))


def zone_groups(rows: DataFrame, zone_of: DataFrame) -> DataFrame:
    """Per (zone, frame, annulus) mean, std and count; a hole without zone counts as `all`."""
    zoned = rows.join(zone_of, "hole_id", "left").withColumn("reticulum_zone", F.coalesce("reticulum_zone", F.lit("all")))
    return aggregate(zoned, ["reticulum_zone", "frame_id", "annulus_id"])


def model_fits(rows: DataFrame) -> DataFrame:
    """Per (hole, frame) with two annuli or more: straight and, from three, quadratic fit over annuli, and the curve's vertex."""
    keys = ["hole_id", "frame_id"]
    both = parabola(rows, keys, "annulus_id", "descriptor_value", line=True).where("_n >= 2")
    return both.select(
        *keys,
        F.col("_slope").alias("linear_slope"),
        F.col("_intercept").alias("linear_intercept"),
        r_squared(F.col("_residual"), F.col("_total"), 1e-12).alias("linear_r2"),
        F.col("a").alias("quadratic_a"),
        F.col("b").alias("quadratic_b"),
        F.col("c").alias("quadratic_c"),
        r_squared(F.col("qres"), F.col("qtot"), 1e-12).alias("quadratic_r2"),
        F.when(F.abs(settled(F.col("a"))) > 1e-8, -settled(F.col("b")) / (2 * settled(F.col("a")))).alias("front_radius_quadratic"),
        F.col("_n").alias("n_valid_annuli"),
    )


def model_summary(fits: DataFrame) -> DataFrame:
    return fits.groupBy("hole_id").agg(
        F.avg("linear_slope").alias("mean_linear_slope"),
        F.avg("linear_r2").alias("mean_linear_r2"),
        F.avg("quadratic_r2").alias("mean_quadratic_r2"),
        F.count("quadratic_a").alias("n_quadratic"),
        F.count(F.lit(1)).alias("n_frames"),
    )


def angular_asymmetry(rows: DataFrame, n_sectors: int = 4) -> DataFrame:
    """Per (hole, frame) over sector means: asymmetry, contrast, vector strength, first sector of the largest mean, and the means."""
    keys = ["hole_id", "frame_id"]
    means = rows.groupBy(*keys, "sector_id").agg(F.avg("descriptor_value").alias("m"))
    weighted = means.withColumn("_m", settled(F.col("m"))).withColumn("w", F.col("m") - F.min("m").over(Window.partitionBy(*keys)) + TINY)
    theta = (F.col("sector_id") + 0.5) * (2 * 3.141592653589793 / n_sectors)
    out = weighted.groupBy(*keys).agg(
        F.count("m").alias("n_valid_sectors"),
        (F.stddev_pop("m") / (F.abs(F.avg("m")) + TINY)).alias("angular_asymmetry"),
        (F.max("m") - F.min("m")).alias("sector_contrast"),
        (F.hypot(F.sum(F.col("w") * F.cos(theta)), F.sum(F.col("w") * F.sin(theta))) / (F.sum("w") + TINY)).alias("vector_strength"),
        pick_first("sector_id", "_m", "sector_id").alias("dominant_sector"),
        *[F.max(F.when(F.col("sector_id") == i, F.col("m"))).alias(f"sector_{i}_mean") for i in range(n_sectors)],
    )
    return out


def asymmetry_by(rows: DataFrame, key: str) -> DataFrame:
    """Means by frame or by hole; for holes also the most frequent dominant sector, the least of equals."""
    return rows.groupBy(key).agg(
        F.avg("angular_asymmetry").alias("mean_angular_asymmetry"),
        F.avg("sector_contrast").alias("mean_sector_contrast"),
        F.avg("vector_strength").alias("mean_vector_strength"),
        F.mode("dominant_sector", True).alias("dominant_sector_mode"),
        F.count(F.lit(1)).alias("n"),
    )
