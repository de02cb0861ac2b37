"""A training corpus from raw documents, in stages that each read what the one before has written.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows as Parquet below the shared folder, so a lost executor costs tasks, not stages. Rows whose text is
null or empty pass through the stages like any others, as their operators define.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.op1_quality import QualityModel
from galley.llm.op4_lsh_forest import near_duplicates
from galley.llm.op5_secrets import scanned
from galley.llm.op8_benchmark import decontaminated
from galley.llm.op9_bpe import encoded
from galley.llm.scratch import Scratch


def _held(docs: DataFrame) -> DataFrame:
    """Documents as (row, text), so that no column of theirs clashes with an operator's."""
    rest = [F.col(c) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), "text")


def _columns(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of documents, from (row, text, ...)."""
    return [changed.get(c, F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = QualityModel.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.scored(_held(docs), ["row", "text"]).where("predicted = 1").select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id; rows with repeated or null ids are rows apart."""
    rows = Scratch(spark).table(_held(docs).withColumn("at", F.monotonically_increasing_id()))
    groups = near_duplicates(rows.select(F.col("at").alias("doc_id"), "text")).select(F.col("doc_id").alias("at"), "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))["at"]
    kept = rows.select("at", F.col("row.doc_id").alias("id")).join(groups, "at").groupBy("component_id").agg(first.alias("at"))
    return rows.join(kept, "at", "left_semi").select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    judged = decontaminated(_held(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["row", "text"])
    return judged.where("not contaminated").select(*_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    clean = scanned(_held(docs), ["row", "text"], redact=True)
    text, size = F.col("redacted"), F.char_length("redacted").cast("long")
    return clean.select(*_columns(docs, text=text, n_chars=F.when(text == F.col("text"), F.col("row.n_chars")).otherwise(F.coalesce(size, "row.n_chars"))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of documents, with digests of the ids and of what they decode to, beside the columns of documents but text."""
    out = encoded(_held(docs), ["row"])
    new = [c for c in out.columns if c != "row"]
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in {"text", *new}), *new)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SQL can't express the quality classifier; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    scratch = Scratch(spark)
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        if path:
            scratch.drop(path)
        path = scratch.path()
    return docs
