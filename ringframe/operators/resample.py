"""Bootstrap with a portable integer generator: any engine draws the same frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringframe.functions.expressions import line_fit
from ringframe.operators import clusters, rdf

# Multipliers and modulus of the draw, (a hole + b boot + c draw + d) mod m, then mod n.
A, B, C, D, M = 7919, 104729, 15485863, 12345, 2147483647


def drawn(frames: DataFrame, columns: list[str], n_boot: int, least: int = 1, once: bool = False) -> DataFrame:
    """Each hole's frames (of at least `least`) drawn again n_boot times: (hole_id, boot, frame_id, columns); equal draws of a boot `once` only.

    A hole's frames are one array, as long as the recording has frames; draws are picked from it by place. So the only
    shuffle is that of frames by hole, and what groups by (hole, boot) afterwards needs none.
    """
    held = frames.groupBy("hole_id").agg(F.sort_array(F.collect_list(F.struct("frame_id", *columns))).alias("_f")).where(F.size("_f") >= least)
    boots = held.select("hole_id", "_f", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot"))
    n = F.size("_f")
    mixed = lambda draw: (F.col("hole_id").cast("long") * A + F.col("boot") * F.lit(B).cast("long") + draw * F.lit(C).cast("long") + D) % M % n
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda draw: (mixed(draw) + 1).cast("int"))
    places = F.array_distinct(places) if once else places
    return boots.select("hole_id", "boot", F.explode(F.transform(places, lambda k: F.element_at("_f", k))).alias("_d")).select("hole_id", "boot", "_d.*")


def bootstrap(frames: DataFrame, n_boot: int = 128) -> DataFrame:
    """Per hole: frames with a front drawn again n_boot times; 95 % intervals (linear quantiles) of mean, last - first and slope."""
    known = frames.where("rdf_front_radius_norm IS NOT NULL").select("hole_id", "frame_id", F.col("rdf_front_radius_norm").alias("y"))
    once = drawn(known, ["y"], n_boot, 2, once=True)
    fit = line_fit("frame_id", "y")
    per = once.groupBy("hole_id", "boot").agg(
        F.avg("y").alias("mean_front"), (F.max_by("y", "frame_id") - F.min_by("y", "frame_id")).alias("delta_front"), F.coalesce(fit["slope"], F.lit(0.0)).alias("velocity")
    )
    out = [F.count(F.lit(1)).alias("n_boot")]
    for name in ("mean_front", "delta_front", "velocity"):
        low, high = F.percentile(name, 0.025), F.percentile(name, 0.975)
        out += [low.alias(f"bootstrap_{name}_ci_low"), high.alias(f"bootstrap_{name}_ci_high"), (high - low).alias(f"bootstrap_{name}_ci_width")]
    return per.groupBy("hole_id").agg(*out)


def archetype_support(frames: DataFrame, centroids: DataFrame, features: list[str], n_boot: int = 128) -> DataFrame:
    """Per hole: all its frames drawn again n_boot times, each draw's nearest centroid; the most frequent label and its share."""
    again = drawn(frames, ["rdf_front_radius_norm", "rdf_spread_norm", "rdf_total_positive_delta", "rdf_inner_minus_outer_delta"], n_boot)
    placed = clusters.nearest_centroid(rdf.archetype_features(again, ("hole_id", "boot")), centroids, features)
    votes = placed.groupBy("hole_id", "label").agg(F.count(F.lit(1)).alias("k"))
    return votes.groupBy("hole_id").agg(
        F.sum("k").alias("n_boot"), F.min_by("label", F.struct((-F.col("k")).alias("k"), "label")).alias("archetype_label"),
        (F.max("k") / F.sum("k")).alias("support_fraction"), F.count(F.lit(1)).alias("n_labels"),
    )


def uncertainty(intervals: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """Per hole the mean of the known ones among interval widths and 1 - support; null if none is known."""
    rows = intervals if support is None else intervals.join(support, "hole_id", "left")
    parts = [F.abs(c) for c in ("bootstrap_mean_front_ci_width", "bootstrap_delta_front_ci_width", "bootstrap_velocity_ci_width")]
    if support is not None:
        parts.append(F.greatest(1 - F.col("support_fraction"), F.lit(0.0)))
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return rows.withColumn("uncertainty_score", F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known)))


def summary(scored: DataFrame, sector_summary: DataFrame) -> DataFrame:
    """One row over all holes: mean support, interval width of the velocity, uncertainty, and share of sectors with a velocity; null where none is known."""
    part = scored.agg(F.avg("support_fraction").alias("mean_support"), F.avg("bootstrap_velocity_ci_width").alias("mean_velocity_ci_width"), F.avg("uncertainty_score").alias("mean_uncertainty_score"))
    return part.crossJoin(F.broadcast(sector_summary.agg(F.avg("valid_sector_velocity_fraction").alias("mean_sector_velocity_fraction"))))


def validation_summaries(scored: DataFrame, velocities: DataFrame, accelerations: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two summaries of one row each; means over holes, null where none is known.

    First: support of the archetypes, interval width of the velocity, share of sectors with a velocity. Second: uncertainty
    score, interval width of the velocity of the scored holes, share of sectors with an acceleration.
    """
    known = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    share = lambda df, c, name: df.agg(known(c).alias(name))
    first = scored.agg(known("support_fraction").alias("mean_bootstrap_class_support"), known("bootstrap_velocity_ci_width").alias("mean_velocity_ci_width"))
    second = scored.agg(known("uncertainty_score").alias("mean_uncertainty_score"), known("bootstrap_velocity_ci_width").alias("mean_hotspot_linked_velocity_ci_width"))
    first = first.crossJoin(share(velocities, "valid_sector_velocity_fraction", "mean_sector_propagation_valid_fraction"))
    second = second.crossJoin(share(accelerations, "valid_sector_acceleration_fraction", "mean_sector_acceleration_valid_fraction"))
    return tuple(df.withColumn("validation_enabled", F.lit(enabled)) for df in (first, second))
