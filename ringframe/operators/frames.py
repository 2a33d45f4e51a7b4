"""Frame-level measures: colour statistics, histograms, jumps, black rows, separability, selection of frames and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import hsl, hsv8, settled


def grey() -> Column:
    """Luma of 8-bit channels in whole numbers: (299 r + 587 g + 114 b) div 1000."""
    return F.expr("CAST((299 * r + 587 * g + 114 * b) div 1000 AS INT)")


def region_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean channels (0..255), mean hue and saturation (0..1, hue averaged as a number) and area."""
    h, s, light = hsl(F.col("r"), F.col("g"), F.col("b"))
    full = pixels.withColumns({"h": h, "s": s, "l": light})
    return full.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_{c.upper()}") for c in "rgb"], F.avg("h").alias("mean_H"), F.avg("s").alias("mean_S"), F.avg("l").alias("mean_L"),
        *[F.stddev_pop(c).alias(f"std_{c.upper()}") for c in "rgb"], F.count(F.lit(1)).alias("area_px"),
    )


def histogram(pixels: DataFrame, bins: int = 64) -> DataFrame:
    """Per frame the share and running share of grey values by bin; only bins that occur."""
    counts = pixels.select("frame_id", F.expr(f"CAST(({'CAST((299 * r + 587 * g + 114 * b) div 1000 AS INT)'}) * {bins} div 256 AS INT)").alias("bin")).groupBy("frame_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("frame_id")
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(w))
    return share.withColumn("cdf", F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w))


def histogram_jumps(hist: DataFrame) -> DataFrame:
    """Distance between each frame's histogram and the one's before, each scaled to unit length; null for the first frame.

    |a - b|^2 = 2 - 2 a.b for unit vectors, so only bins that both have are joined.
    """
    unit = hist.withColumn("u", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("frame_id"))))
    frames = hist.select("frame_id").distinct().withColumn("before", F.lag("frame_id").over(Window.orderBy("frame_id")))
    now = unit.select("frame_id", "bin", "u").join(F.broadcast(frames), "frame_id")
    old = unit.select(F.col("frame_id").alias("before"), "bin", F.col("u").alias("v"))
    dot = now.join(old, ["before", "bin"], "left").groupBy("frame_id", "before").agg(F.sum(F.col("u") * F.coalesce("v", F.lit(0.0))).alias("dot"))
    return dot.select("frame_id", F.when(F.col("before").isNotNull(), F.sqrt(F.greatest(2 - 2 * F.col("dot"), F.lit(0.0)))).alias("jump"))


def dense_profiles(hist: DataFrame, bins: int) -> DataFrame:
    """Every frame's share and running share for every bin, those that don't occur included."""
    frames = hist.select("frame_id").distinct()
    grid = frames.crossJoin(F.broadcast(frames.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))))
    dense = grid.join(hist.select("frame_id", "bin", "share"), ["frame_id", "bin"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return dense.withColumn("cdf", F.sum("share").over(Window.partitionBy("frame_id").orderBy("bin")))


def transition_scores(hist: DataFrame, bins: int = 256) -> DataFrame:
    """Of neighbouring frames' histograms: half the L1 distance, twice the mean distance of running sums, half that of mean grey values.

    With 256 bins a bin is a grey value, so the means' distance (in 0..1) comes of the same differences.
    """
    dense = dense_profiles(hist, bins)
    by = Window.partitionBy("bin").orderBy("frame_id")
    moved = dense.withColumn("_h", F.col("share") - F.lag("share").over(by)).withColumn("_c", F.abs(F.col("cdf") - F.lag("cdf").over(by)))
    grey = F.abs(F.sum(F.col("_h") * F.col("bin"))) / (bins - 1)
    return moved.groupBy("frame_id").agg((0.5 * F.sum(F.abs("_h")) + 2 * F.avg("_c") + 0.5 * grey).alias("score"))


def hsv_stats(pixels: DataFrame, least_saturation: float = 0.2) -> DataFrame:
    """Per frame the means of 8-bit HSV, and the share of pixels whose hue counts: saturation of `least_saturation` or more."""
    h, s, v = hsv8(F.col("r"), F.col("g"), F.col("b"))
    known = pixels.select("frame_id", h.alias("h"), s.alias("s"), v.alias("v"))
    return known.groupBy("frame_id").agg(F.avg("h").alias("mean_h"), F.avg("s").alias("mean_s"), F.avg("v").alias("mean_v"), F.avg((F.col("s") >= least_saturation).cast("double")).alias("hue_share"))


def colour_series(pixels: DataFrame) -> DataFrame:
    """Per frame the means of channels over 255 and of 8-bit hue, saturation and value, and the channels' deviations."""
    h, s, v = hsv8(F.col("r"), F.col("g"), F.col("b"))
    known = pixels.select("frame_id", *[(F.col(c) / F.lit(255.0)).alias(c) for c in "rgb"], h.alias("h"), s.alias("s"), v.alias("v"))
    return known.groupBy("frame_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in "rgbhsv"], *[F.stddev_pop(c).alias(f"std_{c}") for c in "rgb"])


def brightness(pixels: DataFrame, factor: float) -> DataFrame:
    """Channels multiplied, clipped to 0..255 and cut to whole numbers."""
    return pixels.withColumns({c: F.floor(F.least(F.greatest(settled(F.col(c) * factor), F.lit(0.0)), F.lit(255.0))).cast("int") for c in "rgb"})


DESCRIPTORS = ("r", "g", "b", "h", "s")


def descriptor(pixels: DataFrame, name: str) -> DataFrame:
    """The pixels with `value`: a channel over 255, or 8-bit hue or saturation over their range; other names raise."""
    if name not in DESCRIPTORS:
        raise ValueError(f"unknown descriptor: {name}")
    h, s, _ = hsv8(F.col("r"), F.col("g"), F.col("b"))
    return pixels.withColumn("value", {"h": h, "s": s}.get(name, F.col(name) / F.lit(255.0)))


def masked_hue(pixels: DataFrame, least_saturation: float = 0.2) -> DataFrame:
    """The pixels with `hue`, null where saturation is below `least_saturation`."""
    h, s, _ = hsv8(F.col("r"), F.col("g"), F.col("b"))
    return pixels.withColumn("hue", F.when(s >= least_saturation, h))


def saturation(pixels: DataFrame, threshold: int = 250) -> DataFrame:
    """Per frame the share of saturated values of each channel and whether the frame is accepted (under 5 % in each)."""
    shares = {c: F.avg((F.col(c) >= threshold).cast("double")) for c in "rgb"}
    out = pixels.groupBy("frame_id").agg(*[v.alias(f"saturation_{c}") for c, v in shares.items()])
    return out.withColumn("accepted", F.greatest("saturation_r", "saturation_g", "saturation_b") < 0.05)


def audit(pixels: DataFrame, blur: DataFrame, least_blur: float = 0.8, bins: int = 64) -> DataFrame:
    """Each frame's record: blur score (`blur`: frame_id, blur_score; larger is sharper), saturated shares, jump from the frame before
    (0 for the first) and whether it is accepted: sharp enough and less than 5 % saturated in each channel. No score: not accepted.
    """
    jumps = histogram_jumps(histogram(pixels, bins)).select("frame_id", F.coalesce("jump", F.lit(0.0)).alias("jump"))
    both = saturation(pixels).join(blur, "frame_id", "left").join(jumps, "frame_id", "left")
    sharp = F.coalesce(settled(F.col("blur_score")) >= least_blur, F.lit(False))
    return both.withColumn("accepted", F.col("accepted") & sharp)


def separability(pixels: DataFrame, inside: Column) -> DataFrame:
    """For each descriptor (r, g, b, h, s): (m1 - m2)^2 / max(v1 + v2, 1e-6) between pixels inside and outside."""
    h, s, _ = hsl(F.col("r"), F.col("g"), F.col("b"))
    values = {"r": F.col("r") / F.lit(255.0), "g": F.col("g") / F.lit(255.0), "b": F.col("b") / F.lit(255.0), "h": h, "s": s}
    long = pixels.select(inside.alias("_in"), F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("v")) for k, v in values.items()])).alias("_d")).select("_in", "_d.name", "_d.v")
    pick = lambda flag: F.when(F.col("_in") == flag, F.col("v"))
    sums = long.groupBy("name").agg(F.avg(pick(True)).alias("m1"), F.avg(pick(False)).alias("m2"), F.var_pop(pick(True)).alias("v1"), F.var_pop(pick(False)).alias("v2"))
    gap = F.col("m1") - F.col("m2")
    return sums.select(F.col("name").alias("descriptor"), (gap * gap / F.greatest(F.col("v1") + F.col("v2"), F.lit(1e-6))).alias("score"))


def best_descriptor(scores: DataFrame) -> DataFrame:
    """The largest score, the last name among equals."""
    return scores.agg(F.max_by("descriptor", F.struct("score", "descriptor")).alias("descriptor"), F.max("score").alias("score"))


def best_correction(scores: DataFrame) -> DataFrame:
    """From (method, frame_id, score): the method of the least mean score, the first name among equals."""
    means = scores.groupBy("method").agg(F.avg("score").alias("score"))
    return means.agg(F.min_by("method", F.struct("score", "method")).alias("method"), F.min("score").alias("score"))


def window(frames: DataFrame, start: int, end: int, every: int = 1) -> DataFrame:
    """Frames in [start, end], each `every`-th from the start; ids keep the source's numbers. Both filters reach the scan."""
    return frames.where(F.col("frame_id").between(start, end) & (F.pmod(F.col("frame_id") - start, F.lit(every)) == 0))


def nearest_centres(points: DataFrame, centres: list[tuple[float, float, float]]) -> DataFrame:
    """Label each pixel by the first nearest centre in (s cos 2 pi h, s sin 2 pi h, l); the few centres are literals of the plan."""
    h, s, light = hsl(F.col("r"), F.col("g"), F.col("b"))
    turn = 2 * 3.141592653589793
    full = points.withColumns({"_x": s * F.cos(h * turn), "_y": s * F.sin(h * turn), "_l": light})
    sq = lambda c, v: (F.col(c) - v) * (F.col(c) - v)
    pairs = F.array(*[F.struct(F.round(sq("_x", a) + sq("_y", b) + sq("_l", c), 9).alias("d"), F.lit(i).alias("i")) for i, (a, b, c) in enumerate(centres)])
    return full.withColumn("cluster_id", F.array_min(pairs)["i"]).drop("_x", "_y", "_l")
