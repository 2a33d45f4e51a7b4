"""Reading and writing tables: CSV at the edges, Parquet inside, JSON models, frames as binary rows, optional inputs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringframe.functions.expressions import finite

HOLES = "hole_id INT, x DOUBLE, y DOUBLE, radius_inner_px DOUBLE, radius_outer_px DOUBLE, confidence DOUBLE"
RADIAL = "hole_id INT, frame_id INT, annulus_id INT, descriptor_value DOUBLE, lattice_u INT, lattice_v INT"
FRAME = "frame_id INT, time_s DOUBLE, height INT, width INT, n_channels INT, data BINARY"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A table with NaN and infinities as null."""
    return finite(spark.read.parquet(path))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table by schema: empty, nan and inf cells are null, cells that don't parse too."""
    target = T.StructType.fromDDL(schema)
    text = spark.read.option("header", True).csv(path)
    cell = lambda f: F.lower(F.trim(F.col(f.name)))
    missing = lambda f: cell(f).isin("", "nan", "inf", "-inf", "none", "null")
    return text.select(*[F.when(~missing(f), F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")).alias(f.name) if f.name in text.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target])


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of this schema if there is none."""
    try:
        return read_parquet(spark, path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def write(df: DataFrame, path: str, csv: bool = False) -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if csv else writer.parquet(path)


def read_json_model(spark: SparkSession, path: str, default: str | None = None) -> DataFrame:
    """A JSON document as one row; an empty frame of the `default` schema where it is missing."""
    try:
        return spark.read.option("multiLine", True).json(path)
    except Exception as error:
        if default is None or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], default)


def write_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines with all its structs, arrays and maps; nulls are written, so that reading back gives every column."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str, default: bool = False) -> DataFrame:
    """What write_json wrote, by schema; with `default`, an empty table where there is none."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as error:
        if not default or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def frame_window(n_frames: int, start: int | None = None, end: int | None = None) -> tuple[int, int | None]:
    """First and last frame, moved into what is there: the first is 0 at least, the last neither before it nor beyond the n frames."""
    first = max(0, int(start or 0))
    last = n_frames - 1 if end is None else max(first, int(end))
    return first, (min(last, n_frames - 1) if n_frames > 0 else None if end is None else last)


def windowed(frames: DataFrame, start: int | None = None, end: int | None = None, every: int = 1, fps: float = 1.0) -> DataFrame:
    """Frames in [start, end], each `every`-th from the start, with their time; ids stay. The filters reach the scan."""
    first, every = max(0, int(start or 0)), max(1, int(every))
    rows = frames.where((F.col("frame_id") >= first) & (F.pmod(F.col("frame_id") - first, F.lit(every)) == 0))
    if end is not None:
        rows = rows.where(F.col("frame_id") <= max(first, int(end)))
    return rows.withColumn("time_s", F.col("frame_id") / F.lit(fps if fps > 0 else 1.0))


def read_frames(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, every: int = 1, fps: float = 1.0) -> DataFrame:
    """Frames stored as Parquet rows (FRAME, or with a column dtype): a window of them."""
    return windowed(spark.read.parquet(path), start, end, every, fps)


def probe(frames: DataFrame, fps: float = 1.0) -> DataFrame:
    """One row: number of frames, rate, size and channels, from the rows' headers alone (the data column is not read)."""
    largest = [F.coalesce(F.max(c), F.lit(0)).alias(n) for c, n in (("width", "width"), ("height", "height"), ("n_channels", "channels"))]
    return frames.agg(F.count(F.lit(1)).alias("n_frames"), F.lit(fps if fps > 0 else 1.0).alias("fps"), *largest)


def rgb8(image):
    """An array of any kind of number as 8-bit RGB: grey is repeated, channels beyond three are dropped. Integers are scaled from
    their type's range; floats by 255 if all finite ones lie in 0 to 1. NaN is 0, infinities are the ends.
    """
    import numpy as np

    if image.ndim == 2:
        image = image[..., None]
    image = image[..., [0, 0, 0]] if image.shape[2] < 3 else image[..., :3]
    if image.dtype == np.uint8:
        return image
    if np.issubdtype(image.dtype, np.integer):
        low, high = np.iinfo(image.dtype).min, np.iinfo(image.dtype).max
        scaled = (image.astype(np.float64) - low) * 255.0 / (float(high) - low)
    else:
        known = image[np.isfinite(image)]
        scaled = image.astype(np.float64) * (255.0 if known.size and known.min() >= 0 and known.max() <= 1 else 1.0)
        scaled = np.zeros_like(scaled) if not known.size else np.nan_to_num(scaled, nan=0.0, posinf=255.0, neginf=0.0)
    return np.clip(np.rint(scaled), 0, 255).astype(np.uint8)


def frame_pixels(frames: DataFrame) -> DataFrame:
    """Explode frames into pixel rows (frame_id, y, x, r, g, b) of 8 bits, frame by frame in Arrow batches.

    A column `dtype` tells the kind of number (uint8 if it is missing or null), little-endian; see rgb8. A frame whose data is null
    or of another length than its size says raises.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kind = np.dtype(row.get("dtype") or "uint8").newbyteorder("<")
                image = rgb8(np.frombuffer(row["data"], kind).astype(kind.newbyteorder("=")).reshape(row["height"], row["width"], row["n_channels"]))
                for y in range(0, row["height"], 64):
                    part = image[y : y + 64].astype(np.int32)
                    yy, xx = np.mgrid[y : y + part.shape[0], 0 : row["width"]]
                    columns = [np.full(yy.size, row["frame_id"]), yy.ravel(), xx.ravel(), *(part[..., c].ravel() for c in range(3))]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns], names=["frame_id", "y", "x", "r", "g", "b"])

    return frames.mapInArrow(run, "frame_id int, y int, x int, r int, g int, b int")
