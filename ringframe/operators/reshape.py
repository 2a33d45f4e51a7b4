"""Tables for plots: first rows, counts by label, dense series and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringframe.sources.scratch import checkpointed


def first_rows(rows: DataFrame, order: str, value: str, limit: int = 12) -> DataFrame:
    return rows.orderBy(order).limit(limit).select(F.concat(F.lit("hole_"), F.col(order).cast("string")).alias("label"), F.col(value))


def count_by(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def matrix(rows: DataFrame, row: str, column: str, value: str, columns: list[int], last_by: str) -> DataFrame:
    """Row x column with the last value by `last_by` where cells repeat, null where there is none."""
    return rows.groupBy(row).agg(*[F.max_by(F.when(F.col(column) == c, F.col(value)), F.when(F.col(column) == c, F.col(last_by))).alias(f"c{c}") for c in columns])


def trajectories(rows: DataFrame, entity: str, value: str, order: str = "frame_id") -> DataFrame:
    """Each entity's values in order, as one array; an entity has as many rows as there are frames."""
    pairs = F.sort_array(F.collect_list(F.struct(order, value)))
    return rows.groupBy(entity).agg(F.transform(pairs, lambda p: p[value]).alias("values"))


def dense_rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("rank", F.dense_rank().over(Window.orderBy(*keys)))


def smoothed(rows: DataFrame, keys: list[str], order: str, values: list[str], width: int = 3) -> DataFrame:
    """Centred averages of `width` (odd) of each value along `order`, the end values standing in beyond the ends."""
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(order)
    around, whole = w.rowsBetween(-half, half), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    short = F.greatest(half + 1 - F.row_number().over(w), F.lit(0)), F.greatest(half - F.count(F.lit(1)).over(whole) + F.row_number().over(w), F.lit(0))
    padded = lambda c: (F.sum(c).over(around) + short[0] * F.first(c).over(whole) + short[1] * F.last(c).over(whole)) / width
    return rows.select(*keys, order, *[padded(c).alias(c) for c in values])


def smooth_values(rows: DataFrame, keys: list[str], order: str, value: str, width: int = 3) -> DataFrame:
    """Moving averages of `width` along `order` for each key, the end values standing in beyond the ends: (keys, place from 0, value).

    Series of fewer than three values, and widths below two, come back as they are. An even width has one value more than the
    series. A window with a null has no value. A series is held as one array; it is as long as there are frames.
    """
    pairs = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda p: p[value])
    series = rows.groupBy(*keys).agg(pairs.alias("_v"))
    n, pad = F.size("_v"), width // 2
    inside = lambda i: F.element_at("_v", F.least(F.greatest(i, F.lit(1)), n))
    window = lambda i: F.aggregate(F.sequence(i - pad, i - pad + width - 1), F.lit(0.0), lambda total, k: total + inside(k)) / width
    averaged = F.transform(F.sequence(F.lit(1), n + 2 * pad + 1 - width), window) if width > 1 else F.col("_v")
    return series.select(*keys, F.posexplode(F.when(n < 3, F.col("_v")).otherwise(averaged)).alias("place", value))


def bars(rows: DataFrame, label: str, value: str, order: str, limit: int = 12) -> DataFrame:
    """A bar chart's first `limit` rows by `order` (a plot's limit): label and value, null values as 0."""
    return rows.orderBy(order).limit(limit).select(F.col(label).cast("string").alias("label"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))


def line_series(rows: DataFrame, group: str, x: str, y: str, last_by: str, limit: int = 12) -> DataFrame:
    """The first `limit` groups (a plot's lines) on all x alike: a row for each group and x, the last y by `last_by`, null where there is none."""
    lines = rows.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).limit(limit)
    kept = rows.join(F.broadcast(lines), group)
    grid = kept.select(x).distinct().crossJoin(F.broadcast(lines))
    return grid.join(kept.groupBy(group, x).agg(F.max_by(y, last_by).alias(y)), [group, x], "left")


def last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by `order` (nulls first; then by all columns): what a lookup that is filled row by row ends with."""
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(*order, *[c for c in rest if c not in order])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_last")).select(*keys, "_last.*")


def snapshot_frames(rows: DataFrame, baseline: int = 3) -> DataFrame:
    """The distinct frames in order, with their place from 0 and whether they are among the first `baseline`; a row for each frame."""
    frames = rows.where("frame_id IS NOT NULL").select("frame_id").distinct()
    return ordered_places(frames, ["frame_id"], "place").withColumn("is_baseline", F.col("place") < baseline)


def signatures(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A signature of each key's rows (SHA-256 of their sorted texts), equal only for equal rows; columns as text, null as \\N.

    Rows are hashed one by one first, so that a key's rows meet as short digests.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    digests = rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.md5(F.encode(text, "utf-8")))), "").alias("_d"))
    return digests.select(*keys, F.sha2(F.encode("_d", "utf-8"), 256).alias("signature"))


def ordered_places(rows: DataFrame, keys: list, name: str) -> DataFrame:
    """Number all rows from 0 in the order of `keys`: each range of the global order counts its own, and the ranges before it are added."""
    parts = checkpointed(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return parts.withColumn("_in", inside).join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + F.col("_in") - 1).drop("_part", "_begin", "_in")
