"""Filters over the places of frames: Gaussian blur, flat field, gradients, Laplacian, exact distances. Rows first, then columns.

An image is rows (frame_id, y, x, ...). Places beyond an edge are mirrored without repeating the edge; places without a pixel count as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringframe.functions.expressions import settled


def by_line(values: DataFrame, fixed: str, moving: str, filtered: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Filter each line (the places of a frame that share `fixed`) of (frame_id, y, x, v): `filtered` gets its places and values.

    Lines are dealt to tasks and come one after the other, so a task holds one line and one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []

        def done(line: list[np.ndarray]) -> pa.RecordBatch:
            frame, at, places, v = line[0][0], line[1][0], *filtered(line[2].astype(np.int64), line[3])
            named = {"frame_id": np.full(len(v), frame, np.int32), fixed: np.full(len(v), at, np.int32), moving: places.astype(np.int32), "v": v}
            return pa.RecordBatch.from_arrays([pa.array(named[c]) for c in ("frame_id", "y", "x", "v")], names=["frame_id", "y", "x", "v"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("frame_id", fixed, moving, "v")]
            if left:
                columns = [np.concatenate(c) for c in zip(left, columns, strict=True)]
            new = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
            begins = [0, *new]
            for a, b in zip(begins, begins[1:], strict=False):
                yield done([c[a:b] for c in columns])
            left = [c[begins[-1] :] for c in columns] if len(columns[0]) else []
        if left:
            yield done(left)

    places = values.select(F.col("frame_id").cast("int"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("v").cast("double"))
    return places.repartition("frame_id", fixed).sortWithinPartitions("frame_id", fixed).mapInArrow(run, "frame_id int, y int, x int, v double")


def gaussian(values: DataFrame, height: int, width: int, sigma: float) -> DataFrame:
    """The values under a Gaussian of `sigma`, cut at four sigmas: weighted sums along rows, then along columns. All places come out."""
    reach = round(4 * sigma)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()

    def along(length: int):
        def filtered(places: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            line = np.zeros(length)
            line[places] = v
            return np.arange(length), np.convolve(np.pad(line, reach, mode="reflect"), weights, "valid")

        return filtered

    return by_line(by_line(values, "y", "x", along(width)), "x", "y", along(height))


def grey_places(pixels: DataFrame) -> DataFrame:
    """The mean luma of each place."""
    return pixels.groupBy("frame_id", "y", "x").agg(F.avg((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")) / 1000).alias("v"))


def flat_field(pixels: DataFrame, height: int, width: int, sigma: float = 32.0) -> DataFrame:
    """Channels divided by the blurred luma (1 at least) and multiplied by its mean over the frame, clipped and cut to whole numbers."""
    ground = gaussian(grey_places(pixels), height, width, sigma).withColumn("_ground", F.greatest("v", F.lit(1.0))).drop("v")
    means = ground.groupBy(F.col("frame_id").alias("_f")).agg(F.avg("_ground").alias("_mean"))
    level = settled(F.col("_mean") / F.col("_ground"))
    joined = pixels.join(ground, ["frame_id", "y", "x"]).join(means, F.col("frame_id") == F.col("_f"))
    scaled = {c: F.floor(F.least(F.greatest(settled(F.col(c) * level), F.lit(0.0)), F.lit(255.0))).cast("int") for c in "rgb"}
    return joined.withColumns(scaled).select(*pixels.columns)


def positive_prominence(pixels: DataFrame, height: int, width: int, sigma: float = 5.0) -> DataFrame:
    """Per frame the mean of what luma exceeds its blur by, over the places where it does; 0 where there is none."""
    grey = grey_places(pixels)
    blur = gaussian(grey, height, width, sigma).withColumnRenamed("v", "_blur")
    over = settled(F.col("v") - F.col("_blur"))
    return grey.join(blur, ["frame_id", "y", "x"]).groupBy("frame_id").agg(F.coalesce(F.avg(F.when(over > 0, over)), F.lit(0.0)).alias("prominence"))


def dense(places: DataFrame, height: int, width: int) -> DataFrame:
    """All places of each frame: `v` (0 where there is none) and whether there is one."""
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = places.select("frame_id").distinct().select("frame_id", span(height).alias("y")).select("frame_id", "y", span(width).alias("x"))
    return grid.join(places, ["frame_id", "y", "x"], "left").select("frame_id", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"), F.col("v").isNotNull().alias("present"))


def sides(column: str, fixed: str, moving: str) -> tuple:
    """The values before and after along a line of a dense image, mirrored at its ends (a line of one place is its own neighbour)."""
    line = Window.partitionBy("frame_id", fixed).orderBy(moving)
    before, after = F.lag(column).over(line), F.lead(column).over(line)
    return F.coalesce(before, after, F.col(column)), F.coalesce(after, before, F.col(column))


def gradients(places: DataFrame, height: int, width: int) -> DataFrame:
    """Sobel gradients (gx, gy) of a dense image: differences and sums along rows, then along columns; two sorts."""
    left, right = sides("v", "y", "x")
    rows = dense(places, height, width).withColumns({"_l": left, "_r": right})
    rows = rows.withColumns({"_d": F.col("_r") - F.col("_l"), "_s": F.col("_l") + 2 * F.col("v") + F.col("_r")})
    (up_d, down_d), (up_s, down_s) = sides("_d", "x", "y"), sides("_s", "x", "y")
    out = rows.withColumns({"gx": up_d + 2 * F.col("_d") + down_d, "gy": down_s - up_s})
    return out.select("frame_id", "y", "x", "present", "gx", "gy")


def edge_energy(pixels: DataFrame, height: int, width: int, border: int) -> DataFrame:
    """Per frame: the mean gradient of the border's pixels over that of the centre's, at least 1e-6. Pixels of one place are averaged."""
    b = max(1, min(border, min(height, width) // 4))
    outer = (F.col("y") < b) | (F.col("y") >= height - b) | (F.col("x") < b) | (F.col("x") >= width - b)
    size = F.hypot("gx", "gy")
    found = gradients(grey_places(pixels), height, width).where("present")
    means = found.groupBy("frame_id").agg(F.avg(F.when(outer, size)).alias("_b"), F.coalesce(F.avg(F.when(~outer, size)), F.lit(1.0)).alias("_c"))
    return means.select("frame_id", (F.col("_b") / F.greatest(F.col("_c"), F.lit(1e-6))).alias("edge_energy_ratio"))


def whole_grey(pixels: DataFrame) -> DataFrame:
    """Luma in whole numbers, the mean of a place's pixels."""
    return pixels.groupBy("frame_id", "y", "x").agg(F.floor(F.avg(F.expr("CAST((299 * r + 587 * g + 114 * b) div 1000 AS INT)"))).cast("double").alias("v"))


def laplacian_blur(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Per frame the variance of the Laplacian (neighbours less four times the place) of whole luma: large for sharp frames."""
    (left, right), (up, down) = sides("v", "y", "x"), sides("v", "x", "y")
    found = dense(whole_grey(pixels), height, width).withColumn("_row", left + right).withColumn("_lap", F.col("_row") + up + down - 4 * F.col("v"))
    return found.groupBy("frame_id").agg(F.var_pop("_lap").alias("blur_score"))


def haar_blur(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Per frame the sum of the mean absolute Haar details (along x, along y, diagonal) of whole luma / 255 over 2 x 2 blocks.

    The last row or column is repeated where their number is odd. A block without all its places is left out.
    """
    at = lambda u, v: F.max(F.when((F.col("x") % 2 == u) & (F.col("y") % 2 == v), F.col("v") / 255))
    blocks = whole_grey(pixels).groupBy("frame_id", F.expr("y div 2").alias("_by"), F.expr("x div 2").alias("_bx")).agg(at(0, 0).alias("a"), at(1, 0).alias("b"), at(0, 1).alias("c"), at(1, 1).alias("d"))
    last_x, last_y = 2 * F.col("_bx") + 1 >= width, 2 * F.col("_by") + 1 >= height
    blocks = blocks.withColumns({"b": F.when(last_x, F.col("a")).otherwise(F.col("b")), "c": F.when(last_y, F.col("a")).otherwise(F.col("c"))})
    blocks = blocks.withColumn("d", F.when(last_x, F.col("c")).when(last_y, F.col("b")).otherwise(F.col("d"))).dropna(subset=["a", "b", "c", "d"])
    a, b, c, d = (F.col(n) for n in "abcd")
    return blocks.groupBy("frame_id").agg(sum((F.avg(F.abs(x) / 2) for x in (a - b + c - d, a + b - c - d, a - b - c + d)), F.lit(0.0)).alias("blur_score"))


def distances(region: DataFrame, height: int, width: int) -> DataFrame:
    """Each place's exact Euclidean distance to the nearest place of the frame outside the region (frame_id, y, x); none if all is inside.

    Two passes: squared distances along rows, then the least of these plus the squared way along columns.
    """
    far = float((height + width) ** 2)  # no distance of the frame is as large

    def along_row(places: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.unique(places)
        outside = np.setdiff1d(np.arange(width), places)
        if not len(outside):
            return places, np.full(len(places), far)
        at = np.searchsorted(outside, places)
        near = np.minimum(np.abs(places - outside[np.maximum(at - 1, 0)]), np.abs(outside[np.minimum(at, len(outside) - 1)] - places))
        return places, near.astype(float) ** 2

    def along_column(places: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = np.zeros(height)
        line[places] = v
        rows = np.arange(height)
        return places, np.concatenate([((part[:, None] - rows) ** 2 + line).min(axis=1) for part in np.array_split(places, -(-len(places) // 256))])

    squares = by_line(by_line(region.select("frame_id", "y", "x", F.lit(1.0).alias("v")), "y", "x", along_row), "x", "y", along_column)
    return squares.where(F.col("v") < far).select("frame_id", "y", "x", F.sqrt("v").alias("distance"))


def distance_terraces(region: DataFrame, height: int, width: int, terraces: int) -> DataFrame:
    """Places of a region by their distance to what is outside: `terraces` steps of equal width from 0 to the frame's largest distance.

    A terrace takes its lower end and not its upper one, so the places of the largest distance are in none. Frames that
    the region fills have no terraces.
    """
    found = distances(region, height, width)
    most = found.groupBy(F.col("frame_id").alias("_f")).agg(F.max("distance").alias("_most"))
    step = F.floor(settled(F.col("distance") * terraces / F.col("_most"))).cast("int")
    placed = found.join(most, F.col("frame_id") == F.col("_f")).withColumn("terrace", step)
    return placed.where(F.col("terrace") < terraces).select("frame_id", "y", "x", "terrace", "distance")


def support(height: int, width: int, frames: DataFrame, mask: DataFrame | None = None, circle: DataFrame | None = None) -> DataFrame:
    """The places of each frame that count (frame_id, y, x): those of its mask, else of its circle, else all.

    `frames` has frame_id; `mask` (frame_id, height, width, y, x) holds for a frame if its size is the frame's; `circle` has
    frame_id, x, y and radius (the first by these where a frame has several).
    """
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ids = frames.select("frame_id").distinct()
    own = mask.where((F.col("height") == height) & (F.col("width") == width)) if mask is not None else None
    parts = []
    if own is not None:
        parts.append(own.join(ids, "frame_id", "left_semi").where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select("frame_id", "y", "x").distinct())
        ids = ids.join(own, "frame_id", "left_anti")
    grid = ids
    if circle is not None:
        first = circle.groupBy("frame_id").agg(F.min(F.struct(F.col("x").alias("_cx"), F.col("y").alias("_cy"), F.col("radius").alias("_cr"))).alias("_c"))
        grid = ids.join(first, "frame_id", "left")
    grid = grid.withColumn("y", span(height)).withColumn("x", span(width))
    if circle is not None:
        away = (F.col("x") - F.col("_c._cx")) * (F.col("x") - F.col("_c._cx")) + (F.col("y") - F.col("_c._cy")) * (F.col("y") - F.col("_c._cy"))
        grid = grid.where(F.col("_c").isNull() | (away <= F.col("_c._cr") * F.col("_c._cr")))
    parts.append(grid.select("frame_id", "y", "x"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
