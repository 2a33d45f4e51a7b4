"""Cluster activity: pooled fractions, dominant clusters, entropy, fronts, change against the first frames, hole responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import pick_first, settled
from ringframe.operators.reshape import ordered_places
from ringframe.sources.scratch import checkpointed

FRONT = 0.15
# Places of a grid are broadcast up to so many.
BROADCAST_PLACES = 100_000


def pooled(tensor: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, cluster): pixels, all pixels of the keys, and the cluster's share."""
    counts = tensor.groupBy(*keys, "cluster_id").agg(F.sum("pixel_count").alias("pixel_count"))
    total = F.sum("pixel_count").over(Window.partitionBy(*keys))
    return counts.withColumn("n_valid_pixels", total).withColumn("pixel_fraction", F.col("pixel_count") / F.greatest(F.col("n_valid_pixels"), F.lit(1)))


def dominant(fractions: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: the cluster of the largest share, the least id among equals, and the entropy in bits."""
    p = F.col("pixel_fraction")
    return fractions.groupBy(*keys).agg(
        pick_first("cluster_id", "pixel_count", "cluster_id").alias("dominant_cluster"),
        F.max("pixel_fraction").alias("dominant_fraction"),
        (-F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))).alias("entropy_bits"),
    )


def front_metrics(tensor: DataFrame, threshold: float = FRONT) -> DataFrame:
    """Per (frame, cluster) over terrace shares: weighted mean terrace, first peak terrace, outermost terrace at `threshold` or more."""
    terraces = pooled(tensor, ["frame_id", "terrace_index"])
    p = F.col("pixel_fraction")
    return terraces.groupBy("frame_id", "cluster_id").agg(
        F.try_divide(F.sum(F.col("terrace_index") * p), F.sum(p)).alias("mean_terrace"),
        pick_first("terrace_index", "pixel_fraction", "terrace_index").alias("peak_terrace"),
        F.max(F.when(p >= threshold, F.col("terrace_index"))).alias("front_terrace"),
    )


def hole_front_metrics(tensor: DataFrame, threshold: float = FRONT) -> DataFrame:
    """Per (frame, cluster) over the shares of each hole's terraces, which are numbered from 1: the mean terrace weighted by share, the
    terrace of the largest share (the least among equals), the outermost one where a hole reaches `threshold`, and over holes that
    have the cluster: mean, deviation, P10 and P90 of their own weighted mean terraces, and their number.
    """
    shares = pooled(tensor, ["frame_id", "hole_id", "terrace_index"]).select("frame_id", "hole_id", "cluster_id", (F.col("terrace_index") + 1).alias("t"), F.col("pixel_fraction").alias("p"))
    holes = shares.groupBy("frame_id", "cluster_id", "hole_id").agg(
        F.sum("p").alias("_p"), F.sum(F.col("t") * F.col("p")).alias("_tp"), F.max(F.when(F.col("p") >= threshold, F.col("t"))).alias("_outer"), F.max(F.struct(settled(F.col("p")).alias("p"), (-F.col("t")).alias("t"))).alias("_peak")
    )
    own = F.when(F.col("_p") > 0, F.col("_tp") / F.greatest("_p", F.lit(1e-12)))
    return holes.withColumn("_own", own).groupBy("frame_id", "cluster_id").agg(
        (F.sum("_tp") / F.greatest(F.sum("_p"), F.lit(1e-12))).alias("weighted_mean_terrace"), (-F.max("_peak")["t"]).alias("peak_terrace"), F.max("_outer").alias("outer_front_terrace"),
        F.avg("_own").alias("hole_mean_weighted_mean_terrace"), F.stddev_pop("_own").alias("hole_sd_weighted_mean_terrace"),
        F.percentile("_own", 0.1).alias("hole_q10_weighted_mean_terrace"), F.percentile("_own", 0.9).alias("hole_q90_weighted_mean_terrace"), F.count("_own").alias("n_holes"),
    )


def full_tensor(tensor: DataFrame, n_sectors: int) -> DataFrame:
    """All clusters of every (frame, hole, terrace, sector) that has pixels, those without pixels there as 0: counts, shares, the
    pixels of the place and the middle of the sector in degrees.
    """
    place = ["frame_id", "hole_id", "terrace_index", "sector_id"]
    counts = tensor.groupBy(*place, "cluster_id").agg(F.sum("pixel_count").alias("pixel_count"))
    held = counts.groupBy(*place).agg(F.sum("pixel_count").alias("n_valid_pixels"), F.map_from_entries(F.collect_list(F.struct("cluster_id", "pixel_count"))).alias("_of"))
    clusters = tensor.agg(F.array_sort(F.collect_set("cluster_id")).alias("_clusters"))  # few, and the same for all
    rows = held.crossJoin(F.broadcast(clusters)).select(*place, "n_valid_pixels", "_of", F.explode("_clusters").alias("cluster_id"))
    count = F.coalesce(F.element_at("_of", F.col("cluster_id")), F.lit(0).cast("bigint"))
    theta = (F.col("sector_id") + 0.5) * 360.0 / n_sectors
    return rows.select(*place, theta.alias("theta_center_deg"), "cluster_id", count.alias("pixel_count"), (count / F.greatest("n_valid_pixels", F.lit(1))).alias("pixel_fraction"), "n_valid_pixels")


def hole_consistency(tensor: DataFrame) -> DataFrame:
    """Per (frame, terrace): mean and deviation over holes of the similarity (1 - Jensen-Shannon divergence, base 2) of their cluster shares to all holes' shares."""
    keys = ["frame_id", "terrace_index"]
    hole = pooled(tensor, [*keys, "hole_id"]).select(*keys, "hole_id", "cluster_id", F.col("pixel_fraction").alias("p"))
    whole = pooled(tensor, keys).select(*keys, "cluster_id", F.col("pixel_fraction").alias("q"))
    pairs = hole.select(*keys, "hole_id").distinct().join(whole, keys).join(hole, [*keys, "hole_id", "cluster_id"], "left")
    p, q = F.coalesce("p", F.lit(0.0)), F.col("q")
    m = (p + q) / 2
    term = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    alike = pairs.groupBy(*keys, "hole_id").agg((1 - F.sum(term) / 2).alias("_s"))
    return alike.groupBy(*keys).agg(F.avg("_s").alias("mean_js_similarity"), F.stddev_pop("_s").alias("sd_js_similarity"), F.count("_s").alias("n_holes"))


def hole_spread(tensor: DataFrame) -> DataFrame:
    """Per (frame, cluster): mean, deviation, P10 and P90 over holes of the cluster's share."""
    holes = pooled(tensor, ["frame_id", "hole_id"])
    return holes.groupBy("frame_id", "cluster_id").agg(
        F.avg("pixel_fraction").alias("mean_fraction"), F.stddev_pop("pixel_fraction").alias("std_fraction"),
        F.percentile("pixel_fraction", 0.1).alias("p10_fraction"), F.percentile("pixel_fraction", 0.9).alias("p90_fraction"),
    )


def js_similarity(tensor: DataFrame) -> DataFrame:
    """Per frame and hole: 1 - Jensen-Shannon divergence (base 2) between the hole's cluster shares and the frame's."""
    hole = pooled(tensor, ["frame_id", "hole_id"]).select("frame_id", "hole_id", "cluster_id", F.col("pixel_fraction").alias("p"))
    frame = pooled(tensor, ["frame_id"]).select("frame_id", "cluster_id", F.col("pixel_fraction").alias("q"))
    pairs = hole.select("frame_id", "hole_id").distinct().join(frame, "frame_id").join(hole, ["frame_id", "hole_id", "cluster_id"], "left")
    p, q = F.coalesce("p", F.lit(0.0)), F.col("q")
    m = (p + q) / 2
    term = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    return pairs.groupBy("frame_id", "hole_id").agg((1 - F.sum(term) / 2).alias("js_similarity"))


def activity(tensor: DataFrame, keys: list[str], baseline_frames: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per (frame, keys, cluster) on the dense grid: raw share, its mean over the first frames, and what exceeds it.

    Active is max(0, raw - baseline), null where the raw share is (a cell without pixels); normalised by the sum over a (frame,
    cluster). The grid is frames x keys x clusters, whose sizes the instrument sets.
    """
    counts = checkpointed(tensor.groupBy("frame_id", *keys, "cluster_id").agg(F.sum("pixel_count").alias("pixel_count")))
    cells = counts.groupBy("frame_id", *keys).agg(F.sum("pixel_count").alias("n_valid"))
    frames, places, clusters = (counts.select(*c).distinct() for c in (["frame_id"], keys, ["cluster_id"]))
    places = F.broadcast(places) if places.count() <= BROADCAST_PLACES else places
    grid = frames.crossJoin(places).crossJoin(F.broadcast(clusters))
    dense = grid.join(cells, ["frame_id", *keys], "left").join(counts, ["frame_id", *keys, "cluster_id"], "left")
    raw = dense.withColumn("raw_fraction", F.when(F.col("n_valid") > 0, F.coalesce("pixel_count", F.lit(0)) / F.col("n_valid")))
    first = frames.orderBy("frame_id").limit(baseline_frames).agg(F.max("frame_id").alias("_last"))
    raw = raw.crossJoin(F.broadcast(first))
    base = F.avg(F.when(F.col("frame_id") <= F.col("_last"), F.col("raw_fraction"))).over(Window.partitionBy(*keys, "cluster_id"))
    out = raw.withColumn("baseline_fraction", base)
    over = F.col("raw_fraction") - F.col("baseline_fraction")
    out = out.withColumn("active_fraction", F.when(over.isNotNull(), F.greatest(over, F.lit(0.0))))
    total = F.sum("active_fraction").over(Window.partitionBy("frame_id", "cluster_id"))
    return out.withColumn("active_normalized", F.when(total > 1e-12, F.col("active_fraction") / total)).select(
        "frame_id", *keys, "cluster_id", "raw_fraction", "baseline_fraction", "active_fraction", "active_normalized", *keep
    )


def run_activity(tensor: DataFrame, baseline_frames: int = 3) -> DataFrame:
    """Per (frame, cluster) of the whole frame: share of pixels (0 where a cluster is missing), its mean over the first frames that
    have the cluster, what exceeds that, and this divided by the run's largest (0 if nothing exceeds).

    The first frames are the first `baseline_frames` of the run (one at least); a cluster that none of them has starts from 0.
    """
    counts = tensor.groupBy("frame_id", "cluster_id").agg(F.sum("pixel_count").alias("pixel_count"))
    whole = counts.groupBy("frame_id").agg(F.sum("pixel_count").alias("n_valid_px"))
    first = whole.orderBy("frame_id").limit(max(1, baseline_frames)).select("frame_id")
    share = F.col("pixel_count") / F.greatest("n_valid_px", F.lit(1))
    base = counts.join(F.broadcast(first), "frame_id", "left_semi").join(whole, "frame_id").groupBy("cluster_id").agg(F.avg(share).alias("baseline_fraction"))
    grid = whole.crossJoin(F.broadcast(counts.select("cluster_id").distinct()))  # clusters are few
    full = grid.join(counts, ["frame_id", "cluster_id"], "left").join(F.broadcast(base), "cluster_id", "left")
    full = full.withColumns({"pixel_count": F.coalesce("pixel_count", F.lit(0)), "baseline_fraction": F.coalesce("baseline_fraction", F.lit(0.0))})
    full = full.withColumn("raw_fraction", share).withColumn("active_fraction", F.greatest(F.col("raw_fraction") - F.col("baseline_fraction"), F.lit(0.0)))
    full = checkpointed(full)
    most = full.agg(F.max("active_fraction").alias("_most"))
    out = full.crossJoin(F.broadcast(most)).withColumn("normalized_active_fraction", F.when(F.col("_most") > 0, F.col("active_fraction") / F.col("_most")).otherwise(0.0))
    return out.select("frame_id", "cluster_id", "pixel_count", "n_valid_px", "raw_fraction", "baseline_fraction", "active_fraction", "normalized_active_fraction")


def activity_front(active: DataFrame) -> DataFrame:
    """Per (frame, cluster): mean and spread of the terrace weighted by activity, null where the total is 1e-12 or less."""
    w, x = F.col("active_fraction"), F.col("terrace_index")
    sums = active.groupBy("frame_id", "cluster_id").agg(F.sum(w).alias("t"), F.sum(w * x).alias("t1"), F.sum(w * x * x).alias("t2"))
    mean = F.when(F.col("t") > 1e-12, F.col("t1") / F.col("t"))
    out = sums.withColumn("front_terrace", mean)
    variance = F.col("t2") / F.col("t") - F.col("front_terrace") * F.col("front_terrace")
    spread = F.when(variance > 1e-12, F.sqrt(variance)).otherwise(0.0)  # below is the rounding of the two squares
    return out.select("frame_id", "cluster_id", F.col("t").alias("total_activity"), "front_terrace", F.when(F.col("t") > 1e-12, spread).alias("front_spread"))


def hole_response(tensor: DataFrame, baseline_frames: int = 3) -> DataFrame:
    """Per (frame, hole): the sum over terraces and clusters of what exceeds the cell's mean over the first frames; no grid is filled in."""
    keys = ["hole_id", "terrace_index"]
    shares = pooled(tensor, ["frame_id", *keys])
    first = shares.select("frame_id").distinct().orderBy("frame_id").limit(baseline_frames).agg(F.max("frame_id").alias("_last"))
    known = shares.crossJoin(F.broadcast(first))
    base = F.avg(F.when(F.col("frame_id") <= F.col("_last"), F.col("pixel_fraction"))).over(Window.partitionBy(*keys, "cluster_id"))
    over = known.withColumn("_b", base).withColumn("_a", F.when(F.col("_b").isNotNull(), F.greatest(F.col("pixel_fraction") - F.col("_b"), F.lit(0.0))))
    return over.groupBy("frame_id", "hole_id").agg(F.sum("_a").alias("response"))


def response_order(response: DataFrame) -> DataFrame:
    """Holes by the frame of their largest response (first), then their summed response, falling, then id."""
    peak = F.min_by("frame_id", F.struct((-F.round("response", 9)).alias("r"), "frame_id"))
    known = response.where("response IS NOT NULL")
    return known.groupBy("hole_id").agg(peak.alias("peak_frame"), F.sum("response").alias("integrated_response"))


def onsets(response: DataFrame, level: float) -> DataFrame:
    """The frames (hole_id, onset_frame) whose response exceeds `level`; one that equals it but for the noise of its sum does not."""
    return response.where(settled(F.col("response")) > level).select("hole_id", F.col("frame_id").alias("onset_frame"))


def response_places(response: DataFrame, phenotypes: DataFrame, onsets: DataFrame) -> DataFrame:
    """All holes of `response` with their place (from 0) by phenotype, onset, frame of the largest response, summed response (falling) and id.

    `phenotypes` (hole_id, phenotype_label; the least one if a hole has several, '' if it has none) and `onsets` (hole_id,
    onset_frame; the least one, last if it has none). A hole whose responses are all null has its first frame as peak and a sum of 0.
    """
    value = F.when(F.col("response").isNotNull() & ~F.isnan("response"), F.col("response"))
    peak = F.min_by("frame_id", F.struct(F.coalesce(-settled(value), F.lit(float("inf"))).alias("r"), "frame_id"))
    holes = response.where("hole_id IS NOT NULL").groupBy("hole_id").agg(peak.alias("peak_frame"), settled(F.coalesce(F.sum(value), F.lit(0.0))).alias("integrated_response"))
    kinds = phenotypes.groupBy("hole_id").agg(F.min("phenotype_label").alias("_kind"))
    firsts = onsets.groupBy("hole_id").agg(F.min("onset_frame").alias("onset_frame"))
    known = holes.join(kinds, "hole_id", "left").join(firsts, "hole_id", "left").withColumn("phenotype_label", F.coalesce("_kind", F.lit(""))).drop("_kind")
    order = ["phenotype_label", F.col("onset_frame").asc_nulls_last(), "peak_frame", F.col("integrated_response").desc(), "hole_id"]
    return ordered_places(known, order, "place")


def barcode(response: DataFrame, places: DataFrame) -> DataFrame:
    """The matrix of mean responses: a row for each hole in its place and each frame of `response`, null where there is none."""
    frames = response.select("frame_id").distinct()
    means = response.groupBy("hole_id", "frame_id").agg(F.avg("response").alias("response"))
    grid = places.select("place", "hole_id").crossJoin(F.broadcast(frames))  # frames are as many as the recording has
    return grid.join(means, ["hole_id", "frame_id"], "left").select("place", "hole_id", "frame_id", "response")


def sector_fan(active: DataFrame) -> DataFrame:
    """Per (frame, sector, cluster): activity over terraces weighted by their pixels (`n_valid`), null where there are none."""
    n = F.coalesce("n_valid", F.lit(0))
    sums = active.groupBy("frame_id", "sector_id", "cluster_id").agg(F.sum(F.coalesce("active_fraction", F.lit(0.0)) * n).alias("_a"), F.sum(n).alias("n_pixels"))
    return sums.select("frame_id", "sector_id", "cluster_id", "n_pixels", F.when(F.col("n_pixels") > 0, F.col("_a") / F.col("n_pixels")).alias("active_fraction"))


def ring_snapshots(active: DataFrame, keys: list[str], least: float = 1e-12) -> DataFrame:
    """Per (frame, keys): the cluster of the largest activity if there is any, else of the largest raw share; the least id among equals."""
    value = lambda c: F.when(F.col(c).isNotNull(), F.struct(settled(F.col(c)), -F.col("cluster_id")))
    sums = active.groupBy("frame_id", *keys).agg(
        (F.coalesce(F.sum("active_fraction"), F.lit(0.0)) > least).alias("is_active"), F.max_by("cluster_id", value("active_fraction")).alias("_a"), F.max_by("cluster_id", value("raw_fraction")).alias("_r")
    )
    return sums.select("frame_id", *keys, F.when(F.col("is_active"), F.col("_a")).otherwise(F.col("_r")).alias("cluster_id"), "is_active")


def front_totals(front: DataFrame) -> DataFrame:
    """Per cluster its activity over all frames, null where no frame has any known."""
    return front.groupBy("cluster_id").agg(F.sum("total_activity").alias("total_activity"), F.count("total_activity").alias("n_frames"))
