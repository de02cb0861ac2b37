"""Answers kept between runs: an append-only table in a folder that all executors reach, one part a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.batches import few

SCHEMA = "cache_key string, answer string, failure string"
ANSWERED = f"{SCHEMA}, attempts int"
_ANSWERED = pa.schema([("cache_key", pa.string()), ("answer", pa.string()), ("failure", pa.string()), ("attempts", pa.int32())])

#: Answers to prompts: (cache_key, prompt) to ANSWERED, answer as JSON.
Client = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def answered(prompts: DataFrame, client: Client) -> DataFrame:
    """ANSWERED for (cache_key, prompt). The client gets a few prompts at a time, however many an Arrow batch holds."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in client(some.to_pandas() for some in few(batches, "prompt")):
            yield pa.RecordBatch.from_pandas(out, _ANSWERED, preserve_index=False)

    return prompts.select("cache_key", "prompt").mapInArrow(kernel, ANSWERED)


class Answers:
    """Rows of SCHEMA below folder/run=ID. Failures are kept to be told, but only answers count as known.

    A run that fails and is repeated under its id replaces its own part. Rows that a failed run left are whole answers, so
    reading them is right as well; of several answers to one key the least counts, whichever run gave it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)

    def runs(self) -> list[str]:
        """Ids of the runs kept so far."""
        path = self._path()
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(n.removeprefix("run=") for n in names if n.startswith("run="))

    def read(self, run: str) -> DataFrame:
        """All rows of one run."""
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/run={run}")

    def known(self, but: str | None = None) -> DataFrame:
        """(cache_key, answer, failure) of all answers, one row a key; those of one run can be left out."""
        paths = [f"{self.folder}/run={r}" for r in self.runs() if r != but]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        best = rows.where("answer is not null and failure is null").groupBy("cache_key").agg(F.min("answer").alias("answer"))
        return best.withColumn("failure", F.lit(None).cast("string"))

    def ask(self, prompts: DataFrame, client: Client, run: str, tasks: int) -> DataFrame:
        """SCHEMA for all distinct keys of (cache_key, prompt): those known are read, all others asked once and kept under the run."""
        distinct = prompts.select("cache_key", "prompt").dropDuplicates(["cache_key"])
        known = self.known(but=run)
        new = answered(distinct.join(known, "cache_key", "left_anti").repartition(tasks), client)
        new.select("cache_key", "answer", "failure").write.mode("overwrite").parquet(f"{self.folder}/run={run}")
        return self.read(run).unionByName(known.join(distinct, "cache_key", "left_semi"))
