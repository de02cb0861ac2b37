"""Documents as nested values: paragraphs by section, cells by table, and the whole as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the JSON of a run, a table and a figure holds, in order.
RUN = ("text", "font_name", "font_size_pt", "bold", "italic", "superscript", "uppercase_literal", "all_caps_property")
FIGURE = ("id", "caption_paragraph_id", "caption_position", "numbering_style", "referenced_in_paragraph_ids")
TABLE = (*FIGURE[:4], "cell_font_size_pt", FIGURE[4])
_NULLS = {"ignoreNullFields": "false"}


def _ids(rows: DataFrame, owner: str) -> DataFrame:
    own = rows.where(F.col(owner).isNotNull()).groupBy("document_id", owner).agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("rows"))
    return own.select("document_id", owner, F.col("rows.id").alias("ids"))


def section_ids(labelled: DataFrame) -> DataFrame:
    """(document_id, section, ids): the paragraphs of each section in order."""
    return _ids(labelled, "section")


def cell_ids(paragraphs: DataFrame) -> DataFrame:
    """(document_id, in_table, ids): the paragraphs in the cells of each table in order."""
    return _ids(paragraphs, "in_table")


def _paragraph() -> Column:
    """A paragraph as JSON; those in cells say their table and place."""
    runs = F.transform("runs", lambda r: F.struct(*(r[f].alias(f) for f in RUN)))
    own = ["id", "text", "style_name", "section", runs.alias("runs"), "alignment", F.lit(False).alias("is_table_caption"), "line_break_after"]
    place = F.when(F.col("cell").isNotNull(), F.array("cell.row", "cell.col"))
    return F.when(F.col("in_table").isNull(), F.to_json(F.struct(*own), _NULLS)).otherwise(F.to_json(F.struct(*own, "in_table", place.alias("cell")), _NULLS))


def documents(labelled: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """(document_id, tree): each document as one JSON object of paragraphs, tables and figures in order. Each kind is gathered by
    itself, so paragraphs that are dealt by document already, as windows leave them, aren't shuffled again as JSON."""

    def listed(kind: str, rows: DataFrame, json: Column) -> DataFrame:
        own = rows.select("document_id", F.struct("ord", json.alias("json")).alias("x")).groupBy("document_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
        return own.select("document_id", F.array_join(F.col("x.json"), ",").alias(kind))

    own = {kind: listed(kind, items, F.to_json(F.struct(*fields), _NULLS)) for kind, items, fields in (("tables", tables, TABLE), ("figures", figures, FIGURE))}
    found = listed("paragraphs", labelled, _paragraph()).join(own["tables"].join(own["figures"], "document_id", "full"), "document_id", "full")
    parts = [F.concat(F.lit(f'"{kind}":['), F.coalesce(kind, F.lit("")), F.lit("]")) for kind in ("paragraphs", "tables", "figures")]
    return found.select("document_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("tree"))
