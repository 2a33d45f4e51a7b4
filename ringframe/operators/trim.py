"""Where a sequence settles: constancy of profiles in windows of frames, the last frame before a lasting jump, the crop of black bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import settled
from ringframe.operators.frames import dense_profiles, transition_scores
from ringframe.sources.scratch import checkpointed

FLOOR = 1e-6


def window_frames(n_frames: int) -> int:
    """Frames in a window by default: six of a hundred, 5 to 18, not over half of all and not under 3."""
    return max(3, min(max(5, min(18, round(0.06 * n_frames))), max(3, n_frames // 2)))


def _distance(rows: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Of a frame's profile from a reference one: half the L1 distance, twice the mean distance of running sums, half that of mean grey values."""
    grey = F.abs(F.max("mean") - F.max("ref_mean"))
    return rows.groupBy(*keys).agg((0.5 * F.sum(F.abs(F.col("share") - F.col("ref_share"))) + 2 * F.avg(F.abs(F.col("cdf") - F.col("ref_cdf"))) + 0.5 * grey).alias("constancy"))


def _placed(hist: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """Dense profiles and scores under the frames' positions, written once; the list of frames has a row for each frame."""
    hist = checkpointed(hist)
    scores = checkpointed(transition_scores(hist, bins))
    at = scores.withColumn("pos", F.row_number().over(Window.orderBy("frame_id")) - 1)
    rows = dense_profiles(hist, bins).join(F.broadcast(at.select("frame_id", "pos")), "frame_id")
    mean = F.sum(F.col("share") * F.col("bin") / (bins - 1)).over(Window.partitionBy("frame_id"))
    return checkpointed(rows.withColumn("mean", mean).select("pos", "bin", "share", "cdf", "mean")), at


def _in_windows(rows: DataFrame, width: int, n: int) -> DataFrame:
    """Each row once for every window (by its first position, 1 or later) that holds it: at most `width` copies."""
    first = F.sequence(F.greatest(F.lit(1), F.col("pos") - width + 1), F.least(F.col("pos"), F.lit(n - width)))
    return rows.where((F.col("pos") >= 1) & (F.greatest(F.lit(1), F.col("pos") - width + 1) <= F.least(F.col("pos"), F.lit(n - width)))).withColumn("first", F.explode(first))


def _reference(members: DataFrame) -> DataFrame:
    return members.groupBy("first", "bin").agg(F.median("share").alias("ref_share"), F.median("cdf").alias("ref_cdf"), F.median("mean").alias("ref_mean"))


def stable_windows(hist: DataFrame, width: int | None = None, bins: int = 256, placed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per window of frames: the jump into it, P90 and median of the scores after it, P90 of its frames' distances from its median profile.

    `is_candidate`: the jump exceeds both the scores' median by six MADs and three times either P90, and both P90s stay under
    the greater of the median plus three MADs and a quarter (a fifth) of the jump.
    """
    n = hist.select("frame_id").distinct().count()
    width = width or window_frames(n)
    profiles, scores = placed or _placed(hist, bins)
    members = _in_windows(profiles, width, n)
    near = _distance(members.join(_reference(members), ["first", "bin"]), ["first", "pos"], bins)
    rows = near.join(F.broadcast(scores.select("pos", "score")), "pos")
    after = F.when(F.col("pos") > F.col("first"), F.col("score"))
    found = rows.groupBy("first").agg(
        F.max(F.when(F.col("pos") == F.col("first"), F.col("score"))).alias("jump"), F.percentile(after, 0.9).alias("post_p90"), F.median(after).alias("post_median"), F.percentile("constancy", 0.9).alias("constancy_p90")
    )
    middle = scores.agg(F.median("score").alias("_m"))
    spread = scores.crossJoin(F.broadcast(middle)).agg(F.first("_m").alias("_m"), F.median(F.abs(F.col("score") - F.col("_m"))).alias("_mad"))
    wide = found.crossJoin(F.broadcast(spread))
    mad = F.greatest(F.col("_mad"), F.lit(FLOOR))
    wide = wide.withColumn("threshold", F.col("_m") + 3 * mad)
    jump, post, still = (settled(F.col(c)) for c in ("jump", "post_p90", "constancy_p90"))
    large = jump >= settled(F.greatest(F.col("_m") + 6 * mad, 3 * F.greatest(F.col("post_p90"), F.col("constancy_p90"), F.lit(FLOOR))))
    calm = (post <= settled(stability_limit())) & (still <= settled(constancy_limit()))
    out = wide.withColumn("is_candidate", large & calm).join(F.broadcast(scores.select(F.col("pos").alias("first"), F.col("frame_id").alias("first_stable_frame"))), "first")
    return out.select("first", "first_stable_frame", "jump", "post_p90", "post_median", "constancy_p90", "threshold", "is_candidate")


def stability_limit() -> Column:
    return F.greatest(F.col("threshold"), 0.25 * F.col("jump"))


def constancy_limit() -> Column:
    return F.greatest(F.col("threshold"), 0.2 * F.col("jump"))


def suggestion(hist: DataFrame, width: int | None = None, bins: int = 256) -> DataFrame:
    """The best candidate (no row if there is none): last frame before it, first stable one, length of the stable run, confidence.

    Only candidates are compared with the frames after them. Merit: jump x contrast x (1 + share of the rest that is stable) x
    root of the run; the earliest among equals.
    """
    n = hist.select("frame_id").distinct().count()
    width = width or window_frames(n)
    profiles, scores = placed = _placed(hist, bins)
    chosen = checkpointed(stable_windows(hist, width, bins, placed).where("is_candidate"))
    ids = F.broadcast(chosen.select("first", "jump", "threshold"))
    reference = _reference(_in_windows(profiles, width, n).join(ids.select("first"), "first"))
    later = profiles.join(reference, "bin").where("pos > first")
    far = _distance(later, ["first", "pos"], bins).join(ids, "first").join(F.broadcast(scores.select("pos", "score")), "pos")
    broken = far.where(~((F.col("score") <= stability_limit()) & (F.col("constancy") <= constancy_limit()))).groupBy("first").agg(F.min("pos").alias("_end"))
    runs = chosen.join(broken, "first", "left").withColumn("stable_run_frames", F.coalesce("_end", F.lit(n)) - F.col("first"))
    rest = F.greatest(F.col("post_p90"), F.col("post_median"), F.col("constancy_p90"), F.lit(FLOOR))
    merit = F.col("jump") * F.col("jump") / rest * (1 + F.col("stable_run_frames") / F.greatest(F.lit(n) - F.col("first"), F.lit(1))) * F.sqrt("stable_run_frames")
    sure = F.col("jump") / F.greatest(F.col("post_p90"), F.col("constancy_p90"), F.col("threshold"), F.lit(FLOOR)) / 8
    before = scores.select((F.col("pos") + 1).alias("first"), F.col("frame_id").alias("cursor_frame"))
    best = runs.withColumn("_merit", settled(merit)).join(F.broadcast(before), "first").orderBy(F.desc("_merit"), "first").limit(1)
    return best.select("cursor_frame", "first_stable_frame", F.least(sure, F.lit(1.0)).alias("confidence"), "jump", "post_p90", "constancy_p90", "stable_run_frames", F.lit(width).alias("stable_window_frames"))


def black_crop(bands: DataFrame, height: int, min_band: int = 2, share: float = 0.8, content: float = 0.25) -> DataFrame:
    """One row: black rows to cut at top and bottom; a band counts if `share` of all frames have one, and is their tenth percentile, cut to whole rows.

    A crop that leaves less than `content` of the height is refused. All frames vote, none are sampled.
    """
    parts = [F.count(F.lit(1)).alias("n_frames")]
    for side in ("top", "bottom"):
        seen = F.when(F.col(f"{side}_black_rows") >= min_band, F.col(f"{side}_black_rows"))
        low = F.floor(F.percentile(seen, 0.1))
        parts += [F.coalesce(F.avg(seen.isNotNull().cast("double")), F.lit(0.0)).alias(f"{side}_detected_fraction"), F.when((F.avg(seen.isNotNull().cast("double")) >= share) & (low >= min_band), low).otherwise(0).cast("int").alias(f"_{side}")]
    voted = bands.agg(*parts).withColumn("_left", F.lit(height) - F.col("_top") - F.col("_bottom"))
    wanted = F.col("_top") + F.col("_bottom") > 0
    empty, little = wanted & (F.col("_left") <= 0), wanted & (F.col("_left") < max(1, round(height * content)))
    reason = F.when(empty, "unsafe_crop_empty_content").when(little, "unsafe_crop_too_little_content").when(wanted, "detected_consistent_black_bands").otherwise("no_consistent_black_bands")
    keep = wanted & ~little
    return voted.select(
        "n_frames", keep.alias("applied"), F.when(keep, F.col("_top")).otherwise(0).alias("top"), F.when(keep, F.col("_bottom")).otherwise(0).alias("bottom"),
        F.when(keep, F.col("_left")).otherwise(height).alias("cropped_height"), "top_detected_fraction", "bottom_detected_fraction", reason.alias("reason"),
    )
