"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from galley.errors import SettingsError


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of this machine only where it is unset on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise SettingsError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
