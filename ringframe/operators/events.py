"""Events of a series: onset, peak, half maximum, duration; lags along annuli and how monotonic they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import pick_first, smoothed


def positions(df: DataFrame, keys: list[str], order: str = "frame_id") -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def curve_events(series: DataFrame, keys: list[str], z: float = 2.0) -> DataFrame:
    """Per series: onset, peak and half-maximum positions, with the frames there, duration, peak value and baseline.

    The series is smoothed once; onset and peak are sought on it smoothed once more. Onset is the first of two values in a
    row above median + z * max(1.4826 MAD, 1e-6) of the first max(3, n div 5) values. Null values are never above.
    """
    w = Window.partitionBy(*keys)
    by = w.orderBy("pos")
    once = positions(series, keys).withColumn("n", F.count(F.lit(1)).over(w))
    once = once.withColumn("s", smoothed("value", keys, "pos"))
    twice = once.withColumn("s2", smoothed("s", keys, "pos")).withColumn("s3", F.col("s2"))
    # the baseline window of the onset search is on the series smoothed twice, the reported one on it smoothed once
    in_base = F.col("pos") < F.greatest(F.lit(3), F.expr("CAST(n div 5 AS INT)"))
    stats = twice.withColumn("mu", F.median(F.when(in_base, F.col("s2"))).over(w)).withColumn("baseline_value", F.median(F.when(in_base, F.col("s"))).over(w))
    stats = stats.withColumn("mad", F.median(F.when(in_base, F.abs(F.col("s2") - F.col("mu")))).over(w))
    above = F.coalesce(F.col("s2") > F.col("mu") + z * F.greatest(1.4826 * F.col("mad"), F.lit(1e-6)), F.lit(False))
    marked = stats.withColumn("above", above)
    marked = marked.withColumn("starts", F.col("above") & F.coalesce(F.lead("above").over(by), F.lit(False)))
    onset = F.min(F.when(F.col("starts"), F.col("pos"))).over(w)
    peak = pick_first("pos", "s2", "pos").over(w)
    found = marked.withColumn("onset", onset).withColumn("peak", peak)
    found = found.withColumn("peak_value", F.max(F.when(F.col("pos") == F.col("peak"), F.col("s"))).over(w))
    half = F.col("baseline_value") + 0.5 * (F.col("peak_value") - F.col("baseline_value"))
    found = found.withColumn("high", F.col("s") >= half)
    later = F.when(F.col("high") & (F.col("pos") >= F.col("onset")), F.col("pos"))
    return found.groupBy(*keys).agg(
        F.first("onset").alias("onset_pos"),
        F.first("peak").alias("peak_pos"),
        F.min(F.when(F.col("high"), F.col("pos"))).alias("halfmax_pos"),
        F.first("peak_value").alias("peak_value"),
        (F.max(later) - F.min(later) + 1).alias("duration_frames"),
        F.first("baseline_value").alias("baseline_value"),
        F.max(F.when(F.col("pos") == F.col("onset"), F.col("frame_id"))).alias("onset_frame_id"),
        F.max(F.when(F.col("pos") == F.col("peak"), F.col("frame_id"))).alias("peak_frame_id"),
    )


def lag_summary(events: DataFrame) -> DataFrame:
    """Per hole, from events by annulus: outermost minus innermost onset and peak, known annuli, share of steps that don't go back.

    One known annulus has a share of 1, none has 0.
    """
    out = events
    w = Window.partitionBy("hole_id").orderBy("annulus_id").rowsBetween(Window.unboundedPreceding, -1)
    for name in ("onset", "peak"):
        before = F.last(f"{name}_pos", ignorenulls=True).over(w)
        out = out.withColumn(f"_{name}_step", F.when(F.col(f"{name}_pos").isNotNull() & before.isNotNull(), F.col(f"{name}_pos") - before))
    parts = []
    for name in ("onset", "peak"):
        pos, step = f"{name}_pos", f"_{name}_step"
        at = F.when(F.col(pos).isNotNull(), F.col("annulus_id"))
        n = F.count(pos)
        parts += [
            F.when(n >= 2, F.max_by(pos, at) - F.min_by(pos, at)).alias(f"{name}_lag_frames"),
            n.alias(f"n_valid_annuli_{name}"),
            F.when(n == 0, F.lit(0.0)).when(n == 1, F.lit(1.0)).otherwise(F.avg((F.col(step) >= 0).cast("double"))).alias(f"{name}_monotonic_fraction"),
        ]
    return out.groupBy("hole_id").agg(*parts)


def propagation_features(lags: DataFrame) -> DataFrame:
    """Lag per annulus step, monotonic flags and whether any lag is negative."""
    out = lags
    for name in ("onset", "peak"):
        out = out.withColumn(f"{name}_slope_per_annulus", F.col(f"{name}_lag_frames") / F.greatest(F.col(f"n_valid_annuli_{name}") - 1, F.lit(1)))
        out = out.withColumn(f"monotonic_{name}", (F.col(f"n_valid_annuli_{name}") >= 2) & (F.col(f"{name}_monotonic_fraction") == 1.0))
    negative = F.coalesce(F.col("onset_lag_frames") < 0, F.lit(False)) | F.coalesce(F.col("peak_lag_frames") < 0, F.lit(False))
    return out.withColumn("negative_lag_flag", negative)


def validation(features: DataFrame, least: int = 2) -> DataFrame:
    """One row: the shares of holes with enough onsets and peaks, monotonic ones, and negative lags; 0 where there are none."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return features.agg(
        share(F.col("n_valid_annuli_onset") >= least).alias("valid_onset_fraction"),
        share(F.col("n_valid_annuli_peak") >= least).alias("valid_peak_fraction"),
        share(F.col("monotonic_onset")).alias("monotonic_onset_fraction"),
        share(F.col("monotonic_peak")).alias("monotonic_peak_fraction"),
        share(F.col("negative_lag_flag")).alias("negative_lag_fraction"),
        F.count(F.lit(1)).alias("n_holes"),
    )
