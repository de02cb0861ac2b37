"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of this machine only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
    return folder


class Scratch:
    """Named tables below the shared folder. They survive lost executors and cut lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/galley-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, frame: DataFrame) -> DataFrame:
        """Write a frame and return a reader of what was written."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def path(self) -> str:
        """Of the table written last."""
        return f"{self.root}/{self.n}"

    def drop(self, path: str) -> None:
        """Delete a table that nothing reads any more."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
