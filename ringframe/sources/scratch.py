"""Where intermediate rows go: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and everything runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-streams-")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder: later plans start there, and survive lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Scratch:
    """Intermediate rows as compressed Parquet in the shared folder: each goes once it is superseded, all at the end.

    They cut plans off as checkpoints do, but take less disk, and Spark knows their size.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.paths = spark, f"{shared_folder(spark)}/rows_{uuid4().hex}", {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.base)

    def keep(self, label: str, df: DataFrame) -> DataFrame:
        """Write `df` and read it back; what was kept under this label before is removed after."""
        path, before = f"{self.base}/{label}_{uuid4().hex}", self.paths.get(label)
        df.write.parquet(path)
        self.paths[label] = path
        if before:
            remove(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
