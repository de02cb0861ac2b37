"""Registers of queries and their SQL, and the driver's tables in the shapes that the engine works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.plans import schemas

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL counterpart."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(schema: str, **columns: Column) -> list[Column]:
    """Columns of a schema in order, null where none is given."""
    return [columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in schemas.kinds(schema).items()]


def run(**fields: Column) -> Column:
    """A run with the fields given, others at their resting values."""
    rest = {"text": F.lit("x"), "bold": F.lit(False), "italic": F.lit(False), "superscript": F.lit(False), "uppercase_literal": F.lit(False), "all_caps_property": F.lit(False)}
    own = rest | fields
    return F.struct(*(own.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in schemas.kinds(schemas.PARAGRAPHS, "runs").items()))


#: The order of line items within an order, total because equal rows are alike in every column used.
ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def items(spark: SparkSession, sf_dir: str, owner: str = "l_orderkey") -> DataFrame:
    """Line items with their place in the order, from 1; dealt by the order's key, or by a column of another name that holds it as text."""
    rows = table(spark, sf_dir, "lineitem")
    rows = rows if owner == "l_orderkey" else rows.withColumn(owner, F.col("l_orderkey").cast("string"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(*ITEM_ORDER)))


def orders_as_paragraphs(spark: SparkSession, sf_dir: str, item: Column, text: Column | None = None) -> DataFrame:
    """Each order as a document of one paragraph, whose runs are its line items; one exchange on the document's id."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("l_orderkey"), F.struct(*ITEM_ORDER, item.alias("run")).alias("r"))
    rows = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("r")).withColumn("runs", F.transform("r", lambda r: r["run"]))
    whole = F.array_join(F.transform("runs", lambda r: r["text"]), "") if text is None else text
    return rows.select(*shaped(schemas.PARAGRAPHS, document_id=F.col("l_orderkey"), ord=F.lit(1), id=F.lit("p0001"), text=whole, style_name=F.lit(""), line_break_after=F.lit(False), runs=F.col("runs")),
                       *shaped(schemas.LABELS, section_confidence=F.lit(0.0), section_source=F.lit("unknown")))


def healthy(paragraphs: DataFrame) -> DataFrame:
    """Segmentation of documents in which nothing is missing, as rules need it."""
    none = F.array().cast("array<string>")
    return paragraphs.select("document_id").distinct().select("document_id", none.alias("missing"), F.lit(False).alias("front_matter_only"), F.lit("").alias("degraded_reason"), F.lit(None).cast("string").alias("first_id"))
