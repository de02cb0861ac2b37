"""An extension: documents that arrive in a folder are checked batch by batch, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galley.plans import manuscripts
from galley.plans.ruleset import Ruleset
from galley.sources import ooxml


def watch(spark: SparkSession, folder: str, ruleset: Ruleset, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Check new files and hand the violations of each batch to a sink."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.docx").load(folder)
    files = files.withColumn("document_id", F.sha2("content", 256)).withWatermark("modificationTime", "7 days").dropDuplicatesWithinWatermark(["document_id"])

    def batch(frame: DataFrame, number: int) -> None:
        paragraphs, blocks, _ = ooxml.read(frame)
        sink(manuscripts.check(manuscripts.cut(paragraphs), manuscripts.cut(blocks), ruleset).violations, number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
