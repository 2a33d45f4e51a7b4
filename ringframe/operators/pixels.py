"""Pixel measures over exploded frames: membership in holes and terraces, black rows, corrections, sampled pixels, blur."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def met(pixels: DataFrame, holes: DataFrame, reach: float, radii: tuple[str, ...] = ()) -> DataFrame:
    """Pixels with each hole whose centre is within `reach`, its columns `radii`, and their distance as `_r`.

    Cells of size `reach` make it an equi-join; a pixel meets the holes of its cell and of those around it.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    offsets = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in (-1, 0, 1) for v in (-1, 0, 1)])
    near = holes.select("hole_id", F.col("x").alias("_hx"), F.col("y").alias("_hy"), *radii).withColumn("_o", F.explode(offsets))
    near = near.select("hole_id", "_hx", "_hy", *radii, (cell("_hx") + F.col("_o.u")).alias("_cx"), (cell("_hy") + F.col("_o.v")).alias("_cy"))
    both = pixels.withColumns({"_cx": cell("x"), "_cy": cell("y")}).join(near, ["_cx", "_cy"])
    return both.withColumn("_r", F.hypot(F.col("x") - F.col("_hx"), F.col("y") - F.col("_hy"))).where(F.col("_r") <= reach)


def regions(pixels: DataFrame, holes: DataFrame, reach: float, shrink: float = 2.0, rim: float = 2.0) -> DataFrame:
    """Pixels of each hole's interior (within the inner radius less `shrink`) and rim (the outer `rim` of its disk); radii are at least 1 px."""
    inner = F.col("_r") <= F.greatest(F.col("radius_inner_px") - shrink, F.lit(1.0))
    edge = (F.col("_r") <= F.greatest(F.col("radius_outer_px"), F.lit(1.0))) & (F.col("_r") > F.greatest(F.col("radius_outer_px") - rim, F.lit(1.0)))
    kinds = F.filter(F.array(F.when(inner, "interior"), F.when(edge, "rim")), lambda k: k.isNotNull())
    return met(pixels, holes, reach, ("radius_inner_px", "radius_outer_px")).withColumn("region", F.explode(kinds)).select("frame_id", "hole_id", "region", "y", "x", "r", "g", "b")


def terraces(pixels: DataFrame, annuli: DataFrame, holes: DataFrame, reach: float, exclusive: bool = True) -> DataFrame:
    """Pixels of each hole's terraces: annulus by r_inner <= r < r_outer, and no other hole nearer (equally near ones share it).

    Not `exclusive`: holes' terraces may overlap.
    """
    own = met(pixels, holes, reach)
    if exclusive:
        own = own.withColumn("_least", F.min("_r").over(Window.partitionBy("frame_id", "y", "x"))).where("_r = _least")
    inside = own.join(annuli, "hole_id").where((F.col("_r") >= F.col("r_inner_px")) & (F.col("_r") < F.col("r_outer_px")))
    return inside.select("frame_id", "hole_id", "annulus_id", "y", "x", "r", "g", "b")


def outside_holes(pixels: DataFrame, holes: DataFrame, expand: float = 0.0) -> DataFrame:
    """Pixels in no hole's disk: an anti-join on cells as wide as the largest disk, which is a property of the few holes."""
    reach = (holes.agg(F.max("radius_outer_px")).first()[0] or 1.0) + expand
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    offsets = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in (-1, 0, 1) for v in (-1, 0, 1)])
    near = holes.select(F.col("x").alias("_hx"), F.col("y").alias("_hy"), (F.col("radius_outer_px") + expand).alias("_hr")).withColumn("_o", F.explode(offsets))
    near = near.select("_hx", "_hy", "_hr", (cell("_hx") + F.col("_o.u")).alias("_hcx"), (cell("_hy") + F.col("_o.v")).alias("_hcy"))
    on = (cell("x") == F.col("_hcx")) & (cell("y") == F.col("_hcy")) & (F.hypot(F.col("x") - F.col("_hx"), F.col("y") - F.col("_hy")) <= F.col("_hr"))
    return pixels.join(near, on, "left_anti")


def black_rows(pixels: DataFrame, dark: int = 12, share: float = 0.995, mean: float = 5.0, deviation: float = 3.5) -> DataFrame:
    """Per frame the leading and trailing run of black rows: nearly all pixels dark, low mean, low deviation."""
    luma = (299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")) / 1000
    rows = pixels.groupBy("frame_id", "y").agg(((F.avg((luma <= dark).cast("double")) >= share) & (F.avg(luma) <= mean) & (F.stddev_pop(luma) <= deviation)).alias("black"))
    ends = rows.groupBy("frame_id").agg(F.min(F.when(~F.col("black"), F.col("y"))).alias("first"), F.max(F.when(~F.col("black"), F.col("y"))).alias("last"), (F.max("y") + 1).alias("height"))
    return ends.select("frame_id", F.coalesce("first", "height").alias("top_black_rows"), F.coalesce(F.col("height") - 1 - F.col("last"), F.col("height")).alias("bottom_black_rows"))


def grey_world(pixels: DataFrame) -> DataFrame:
    """Each channel scaled to the mean of the channels' means of its frame, clipped and cut to whole numbers.

    Means are aggregated first, a row for each frame, so that pixels are joined to a small table and not sorted by frame.
    """
    means = pixels.groupBy(F.col("frame_id").alias("_frame")).agg(*[F.avg(c).alias(f"_{c}") for c in "rgb"])
    target = (F.col("_r") + F.col("_g") + F.col("_b")) / 3
    scaled = {c: F.floor(F.least(F.greatest(F.col(c) * target / F.greatest(F.col(f"_{c}"), F.lit(1e-6)), F.lit(0.0)), F.lit(255.0))).cast("int") for c in "rgb"}
    joined = pixels.join(means, F.col("frame_id").eqNullSafe(F.col("_frame")))
    return joined.withColumns(scaled).drop("_frame", "_r", "_g", "_b")


def chromatic_distance(pixels: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each pixel's RGB distance to the baseline image's pixel of the same place, null where that has none."""
    base = baseline.groupBy(F.col("y").alias("_y"), F.col("x").alias("_x")).agg(*[F.min(c).alias(f"_{c}") for c in "rgb"])
    square = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "rgb"), F.lit(0))
    return pixels.join(base, (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x")), "left").withColumn("distance", F.sqrt(square)).drop("_y", "_x", "_r", "_g", "_b")


def hotspot_score(values: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(frame_id, y, x, value) with score: the value, or its absolute difference to the baseline (y, x, value) of the place."""
    if baseline is None:
        return values.withColumn("score", F.col("value"))
    base = baseline.groupBy(F.col("y").alias("_y"), F.col("x").alias("_x")).agg(F.min("value").alias("_value"))
    return values.join(base, (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x")), "left").withColumn("score", F.abs(F.col("value") - F.col("_value"))).drop("_y", "_x", "_value")


def sampled(pixels: DataFrame, per_frame: int = 5000, seed: int = 0) -> DataFrame:
    """At most `per_frame` pixels of each frame, the first by a hash: the same ones in every run. A sampling operator."""
    order = F.xxhash64("frame_id", "y", "x", F.lit(seed))
    return pixels.withColumn("_k", F.row_number().over(Window.partitionBy("frame_id").orderBy(order))).where(F.col("_k") <= per_frame).drop("_k")


def bulk_rows(support: DataFrame, holes: DataFrame, most: int = 5000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The places of the support that no hole covers, and one row for each frame about them.

    `support` is (frame_id, y, x), `holes` (hole_id, x, y, radius_outer_px). The first table is a sample of at most `most` places of
    each frame by a hash (a sampling operator, like `sampled`); the second counts all: n_support_px, n_hole_px (support places in
    holes), n_valid_px, n_sampled_px and valid_fraction_of_support.
    """
    valid = outside_holes(support.select("frame_id", "y", "x"), holes)
    total = support.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_support_px"))
    free = valid.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_valid_px"))
    rows = total.join(free, "frame_id", "left").withColumn("n_valid_px", F.coalesce("n_valid_px", F.lit(0).cast("bigint")))
    return sampled(valid, most, seed), rows.select(
        "frame_id", "n_support_px", (F.col("n_support_px") - F.col("n_valid_px")).alias("n_hole_px"), "n_valid_px", F.least("n_valid_px", F.lit(most).cast("bigint")).alias("n_sampled_px"), (F.col("n_valid_px") / F.col("n_support_px")).alias("valid_fraction_of_support")
    )


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two pixel sets (y, x): intersection over union (1 if both are empty) and over the smaller one."""
    both = a.select("y", "x", F.lit(1).alias("_a")).join(b.select("y", "x", F.lit(1).alias("_b")), ["y", "x"], "full")
    sums = both.agg(F.coalesce(F.sum(F.coalesce("_a", F.lit(0))), F.lit(0)).alias("na"), F.coalesce(F.sum(F.coalesce("_b", F.lit(0))), F.lit(0)).alias("nb"), F.count(F.lit(1)).alias("n"), F.count(F.col("_a") + F.col("_b")).alias("both"))
    return sums.select(F.coalesce(F.try_divide("both", "n"), F.lit(1.0)).alias("iou"), F.coalesce(F.expr("try_divide(both, least(na, nb))"), F.lit(0.0)).alias("overlap_fraction"))
