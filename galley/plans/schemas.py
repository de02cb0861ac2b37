"""Schemas of the tables that rules run over."""

from __future__ import annotations

RUN = (
    "text:string,font_name:string,font_size_pt:double,bold:boolean,italic:boolean,superscript:boolean,uppercase_literal:boolean,"
    "all_caps_property:boolean,font_name_source:string,font_size_source:string,bold_source:string,italic_source:string"
)
PARAGRAPHS = (
    "document_id string, ord int, id string, text string, style_name string, alignment string, line_break_after boolean, in_table string, "
    f"cell struct<row:int,col:int>, runs array<struct<{RUN}>>"
)
BLOCKS = "document_id string, container_id string, sibling_ord int, kind string, node_id string, has_drawing boolean, text string, figure_ord int"
LABELS = "section string, section_confidence double, section_source string"
ITEMS = (
    "document_id string, ord int, id string, paragraph_id string, caption_paragraph_id string, caption_position string, numbering_style string, "
    "caption_number string, referenced_in_paragraph_ids array<string>, cell_font_size_pt double"
)
VIOLATION = (
    "rule_id string, rule_seq int, severity string, section string, paragraph_id string, anchor_paragraph_id string, expected string, found string, "
    "auto_fixable boolean, status string, run_indices array<int>, failure_reason string, message string, details map<string,string>, node_ord int"
)
EXTRA = "explanation string, suggested_fix string"
CHANGE = "font_name string, font_size_pt double, bold boolean, italic boolean, superscript boolean, uppercase_literal boolean, numbering_style string"


def _split(fields: str) -> list[str]:
    """Fields of a DDL string or struct, at its own depth."""
    out, depth = [""], 0
    for c in fields:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def kinds(schema: str, name: str | None = None) -> dict[str, str]:
    """Spark types by column of a DDL string, or of the structs in one of its array columns."""
    found = dict(f.split(" ", 1) for f in _split(schema))
    if name is None:
        return found
    inner = found[name].removeprefix("array<struct<").removesuffix(">>")
    return dict(f.split(":", 1) for f in _split(inner))
