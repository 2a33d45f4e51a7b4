"""Sector fronts: where change stands in each sector, how it spreads and how sectors lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import TINY, line_fit, parabola, pick_first, r_squared, weighted_centre, settled

KEYS = ["hole_id", "sector_id"]
ONSET = 0.01


def frames(evo: DataFrame) -> DataFrame:
    """Per (hole, frame, sector) of a sector evolution: front radius (null without change) and total positive change."""
    front = F.when(F.max("total") > 0, F.sum(F.col("normalized_radius") * F.col("rdf_pdf")))
    return evo.groupBy("hole_id", "frame_id", "sector_id").agg(front.alias("front"), F.max("total").alias("total"))


def fronts(rows: DataFrame) -> DataFrame:
    """Per (hole, frame, sector): centre of mass, first annulus of the largest value, number of known annuli."""
    keys = ["hole_id", "frame_id", "sector_id"]
    low, centre = weighted_centre("annulus_id", "descriptor_value", keys)
    out = rows.withColumn("_low", low).groupBy(*keys).agg(
        centre.alias("sector_front_radius"),
        pick_first("annulus_id", "descriptor_value", "annulus_id").alias("sector_peak_annulus"),
        F.count("descriptor_value").alias("n_valid_annuli"),
    )
    return out.where("n_valid_annuli > 0")


def front_frames(sector_fronts: DataFrame) -> DataFrame:
    x = "sector_front_radius"
    return sector_fronts.groupBy("hole_id", "frame_id").agg(
        F.avg(x).alias("mean_sector_front_radius"),
        F.stddev_pop(x).alias("std_sector_front_radius"),
        F.max(x).alias("max_sector_front_radius"),
        F.min(x).alias("min_sector_front_radius"),
        (F.stddev_pop(x) / (F.abs(F.avg(x)) + TINY)).alias("front_anisotropy_ratio"),
        F.count(x).alias("n_valid_sectors"),
    )


def lags(sector_frames: DataFrame, onset: float = ONSET) -> DataFrame:
    """Per (hole, sector): first frame above `onset`, first frame of the largest front, and their delay against the hole's first."""
    per = sector_frames.withColumn("_front", settled(F.col("front"))).groupBy(*KEYS).agg(
        F.min(F.when(F.col("total") > onset, F.col("frame_id"))).alias("sector_onset_frame"),
        pick_first("frame_id", "_front", "frame_id").alias("sector_peak_frame"),
        F.max("front").alias("sector_peak_front_radius_norm"),
        F.avg("front").alias("sector_mean_front_radius_norm"),
        F.count("front").alias("valid_frames"),
    )
    hole = Window.partitionBy("hole_id")
    return per.withColumn("sector_onset_lag", F.col("sector_onset_frame") - F.min("sector_onset_frame").over(hole)).withColumn(
        "sector_peak_lag", F.col("sector_peak_frame") - F.min("sector_peak_frame").over(hole)
    )


def lag_summary(sector_lags: DataFrame) -> DataFrame:
    return sector_lags.groupBy("hole_id").agg(
        F.min("sector_onset_frame").alias("min_sector_onset_frame"),
        F.min("sector_peak_frame").alias("min_sector_peak_frame"),
        F.max("sector_onset_lag").alias("max_sector_onset_lag"),
        F.max("sector_peak_lag").alias("max_sector_peak_lag"),
        F.avg("sector_onset_lag").alias("mean_sector_onset_lag"),
        F.avg("sector_peak_lag").alias("mean_sector_peak_lag"),
        (F.count("sector_onset_lag") / F.count(F.lit(1))).alias("valid_onset_sector_fraction"),
        (F.count("sector_peak_lag") / F.count(F.lit(1))).alias("valid_peak_sector_fraction"),
    )


def propagation(sector_frames: DataFrame, onset: float = ONSET) -> DataFrame:
    """Per (hole, sector): straight fit of the front over frames, onset, first and last known front."""
    at = F.when(F.col("front").isNotNull(), F.col("frame_id"))
    agg = sector_frames.groupBy(*KEYS).agg(
        *[v.alias(f"_{k}") for k, v in line_fit("frame_id", "front").items()],
        F.min(F.when(F.col("total") > onset, F.col("frame_id"))).alias("sector_front_onset_frame"),
        F.min_by("front", at).alias("sector_front_start_radius_norm"),
        F.max_by("front", at).alias("sector_front_end_radius_norm"),
    )
    return agg.select(
        *KEYS,
        F.col("_slope").alias("sector_front_velocity_per_frame"),
        F.when(F.col("_slope").isNotNull(), r_squared(F.col("_residual"), F.col("_total"))).alias("sector_front_velocity_r2"),
        "sector_front_onset_frame",
        "sector_front_start_radius_norm",
        "sector_front_end_radius_norm",
        (F.col("sector_front_end_radius_norm") - F.col("sector_front_start_radius_norm")).alias("sector_front_delta_radius_norm"),
        F.col("_n").alias("valid_frames"),
    )


def propagation_summary(sector_rows: DataFrame) -> DataFrame:
    v, onset = "sector_front_velocity_per_frame", "sector_front_onset_frame"
    return sector_rows.groupBy("hole_id").agg(
        F.avg(v).alias("mean_sector_front_velocity_per_frame"),
        F.stddev_pop(v).alias("std_sector_front_velocity_per_frame"),
        (settled(F.stddev_pop(v)) / F.greatest(F.abs(settled(F.avg(v))), F.lit(TINY))).alias("sector_front_velocity_anisotropy"),
        (F.count(v) / F.count(F.lit(1))).alias("valid_sector_velocity_fraction"),
        (F.max(onset) - F.min(onset)).alias("max_sector_onset_lag"),
        (F.avg(onset) - F.min(onset)).alias("mean_sector_onset_lag"),
    )


def acceleration(sector_frames: DataFrame) -> DataFrame:
    """Per (hole, sector) with three known fronts or more: the quadratic fit over frames against the straight one."""
    known = sector_frames.where("front IS NOT NULL").select(*KEYS, "frame_id", "front")
    both = parabola(known, KEYS, "frame_id", "front", line=True).where("a IS NOT NULL")
    linear, curved = r_squared(F.col("_residual"), F.col("_total")), r_squared(F.col("qres"), F.col("qtot"))
    return both.select(
        *KEYS,
        F.col("_slope").alias("sector_front_linear_velocity_per_frame"),
        linear.alias("sector_front_linear_r2"),
        F.col("a").alias("sector_front_quadratic_a"),
        F.col("b").alias("sector_front_quadratic_b"),
        F.col("c").alias("sector_front_quadratic_c"),
        curved.alias("sector_front_quadratic_r2"),
        (2 * F.col("a")).alias("sector_front_acceleration_per_frame2"),
        F.col("a").alias("sector_front_curvature"),
        (curved - linear).alias("sector_front_nonlinearity_gain"),
        F.col("_n").alias("valid_frames"),
    )


def acceleration_summary(sector_rows: DataFrame) -> DataFrame:
    acc = "sector_front_acceleration_per_frame2"
    return sector_rows.groupBy("hole_id").agg(
        F.avg(acc).alias("mean_sector_front_acceleration_per_frame2"),
        F.stddev_pop(acc).alias("sector_front_acceleration_spread"),
        F.avg(F.abs("sector_front_curvature")).alias("mean_abs_sector_front_curvature"),
        F.avg("sector_front_nonlinearity_gain").alias("mean_sector_front_nonlinearity_gain"),
        (F.count(acc) / F.count(F.lit(1))).alias("valid_sector_acceleration_fraction"),
        F.count(acc).alias("n_valid_sectors"),
    )
