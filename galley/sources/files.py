"""Names of files, and folders that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_names(frame: DataFrame, name: str = "name") -> DataFrame:
    """Names that several documents share get the beginning of the document's id before them."""
    n = F.count("*").over(Window.partitionBy(name))
    return frame.withColumn(name, F.when(n > 1, F.concat(F.substring("document_id", 1, 8), F.lit("."), name)).otherwise(F.col(name)))


def store(folder: str) -> tuple:
    """(file system, path in it) of a folder, a path or a URI that every executor reaches."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    return system, root.rstrip("/") or "/"
