"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import re
import sys
import tempfile
import types
from uuid import uuid4

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Functions of this subpackage travel with the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

# Bytes of an Arrow batch that Spark hands to Python, where a stage asks for small ones.
BATCH_BYTES = 2_000_000


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    store = sys.modules.setdefault("_ringframe_worker", types.ModuleType("_ringframe_worker"))
    return vars(store).setdefault(name, {})


def sliced(batches, rows: int = 256, size: int = 4_000_000):
    """Arrow batches of at most `rows` rows and about `size` bytes (or one row), so that what Python makes of a batch stays small."""
    for batch in batches:
        parts = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while parts:
            part = parts.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                parts += [part.slice(half), part.slice(0, half)]
            else:
                yield part
        del batch
        pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in Arrow batches of BATCH_BYTES (or one row) from now on: both sides hold a task's batch, and 10,000 texts are a large one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not (told and 0 < int(told[1]) <= BATCH_BYTES):
        spark.conf.set(name, BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and everything runs on this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", ""):
        return folder
    if folder := spark.sparkContext.getCheckpointDir():
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoints-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder. Spark removes the files once nothing refers to them; for results of an operator."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Tables:
    """Named intermediate tables as compressed Parquet in the shared folder; each goes once it is superseded, all at the end.

    They cut the lineage as checkpoints do, take less disk, are read by column, and can be dropped when they are done with.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.names: dict[str, str] = {}
        base = f"ringframe_{spark.sparkContext.applicationId}".lower().replace("-", "_")
        self.base = f"spark_catalog.{base}"
        if not spark.catalog.databaseExists(self.base):
            folder = shared_folder(spark)
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.base} LOCATION '{folder}/{base}'")

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*list(self.names))

    def keep(self, label: str, df: DataFrame) -> DataFrame:
        """Write `df` and read it back; what was kept under this label before is dropped after."""
        name = f"{self.base}.{label}_{uuid4().hex}"
        df.write.format("parquet").saveAsTable(name)
        before = self.names.get(label)
        self.names[label] = name
        if before:
            self.spark.sql(f"DROP TABLE {before}")
        return self.spark.table(name)

    def drop(self, *labels: str) -> None:
        for label in labels:
            self.spark.sql(f"DROP TABLE {self.names.pop(label)}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet (whatever the case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: str = "text"):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def hex_digits(rows: int, per_bucket: int = 100_000) -> int:
    """How many leading hex digits of an md5 make buckets of about `per_bucket` rows; 3 at least, 7 at most."""
    return min(7, max(3, math.ceil(math.log(max(1, rows) / per_bucket, 16))))


def numbered(df: DataFrame, within: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Dense row numbers from 0 within `within`, ordered by (bucket, *order), with no group in one task.

    Rows are numbered inside each (within, bucket); the offset of a bucket is the running sum of
    the bucket counts, which are few rows. `df` should be cheap to read twice (a checkpoint).
    """
    keys = [*within, bucket]
    offsets = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.sum("_n").over(Window.partitionBy(*within).orderBy(bucket)) - F.col("_n"))
        .select(*[F.col(k).alias(f"_o_{k}") for k in keys], "_offset")
    )
    on = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    numbered_in = df.withColumn("_in_bucket", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = numbered_in.join(offsets, on, "left")
    return joined.withColumn(name, F.col("_offset") + F.col("_in_bucket") - 1).drop(
        "_in_bucket", "_offset", *[f"_o_{k}" for k in keys]
    )
