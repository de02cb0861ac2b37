"""A manuscript that keeps every rule, as rows, and changes to it."""

import copy

from galley.plans import schemas

FONT = "Times New Roman"


def run(text, size, bold=False, italic=False, superscript=False, font=FONT):
    letters = [c for c in text if c.isascii() and c.isalpha()]
    return {"text": text, "font_name": font, "font_size_pt": float(size), "bold": bold, "italic": italic, "superscript": superscript,
            "uppercase_literal": bool(letters) and text.upper() == text, "all_caps_property": False}


class Manuscript:
    """Blocks in order: (name, kind, runs or rows of cells, drawing)."""

    def __init__(self):
        self.blocks = []
        p = lambda name, *runs, drawing=False: self.blocks.append({"name": name, "kind": "p", "runs": list(runs), "drawing": drawing})
        head = lambda name, text: p(name, run(text, 9, bold=True), run("", 9))
        body = lambda name, text: p(name, run(text, 9))
        p("title", run("A Study Of Small Rivers", 14, bold=True))
        p("author", run("Ana B. Ray", 10, True), run("1", 10, True, superscript=True), run(", Ole C. Lund", 10, True), run("2", 10, True, superscript=True))
        p("abstract_heading", run("Abstract", 9, italic=True))
        p("abstract_body", run("Rivers were measured over two years and found to be small in most of the months that were seen.", 9, italic=True))
        p("keywords", run("Keywords: water, river, month, measure", 9, italic=True))
        p("affiliation", run("1", 7, italic=True, superscript=True), run("Department of Rivers, ray@example.org, ORCID 0000", 7, italic=True))
        head("introduction_heading", "INTRODUCTION")
        p("introduction_body", run("Rivers are known to be of use to many towns in the plain ", 9), run("[1]", 9, superscript=True), run(" and further up.", 9))
        head("methods_heading", "METHODS AND MATERIALS")
        body("methods_body", "We measured the depth of each river once a month with a long pole and wrote it down.")
        head("result_heading", "RESULT")
        body("table1_citing", "The depths of all rivers are listed in Table I for the first of the two years.")
        body("table1_caption", "Table I. Depths in metres by month, for each of the rivers seen.")
        self.blocks.append({"name": "table1", "kind": "tbl", "cells": [[[run("a", 8)], [run("b", 8)]], [[run("1", 8)], [run("2", 8)]]]})
        body("table2_citing", "The widths are listed in Table II and differ little from what was known of them.")
        body("table2_caption", "Table II. Widths in metres by month, for each of the rivers seen.")
        self.blocks.append({"name": "table2", "kind": "tbl", "cells": [[[run("c", 8)], [run("d", 8)]]]})
        body("figure1_citing", "A map of all of the rivers and towns is drawn in Figure 1 as it was in spring.")
        p("figure1", drawing=True)
        body("figure1_caption", "Figure 1. A map of all of the rivers and towns as of spring.")
        body("figure2_citing", "The same map is drawn in Figure 2 for the autumn of the first of the two years.")
        p("figure2", drawing=True)
        body("figure2_caption", "Figure 2. A map of all of the rivers and towns as of autumn.")
        for s in ("DISCUSSION", "CONCLUSION", "CONFLICT OF INTEREST", "FUNDING", "ACKNOWLEDGEMENT"):
            head(f"{s.lower()}_heading", s)
            body(f"{s.lower()}_body", "There is little to add to what was said of the rivers before in this text.")
        head("references_heading", "REFERENCES")
        for i in range(3):
            p(f"reference{i}", run(f"{i + 1}. Ray AB, Lund OC. On rivers of the plain. J Riv. 2001;{i}(2):1-9.", 8, italic=True))
        head("corresponding_heading", "CORRESPONDING AUTHOR")
        body("corresponding", "Ana B. Ray, Riverside 5, Plain, 555, ray@example.org, ORCID 0000-0001")

    def block(self, name):
        return next(b for b in self.blocks if b["name"] == name)

    def run(self, name, i=0):
        return self.block(name)["runs"][i]

    def move(self, name, before):
        b = self.block(name)
        self.blocks.remove(b)
        self.blocks.insert(next(i for i, x in enumerate(self.blocks) if x["name"] == before), b)

    def rows(self, document_id):
        paragraphs, blocks, n, t = [], [], 0, 0
        self.ids = {}

        def add(runs, table=None, cell=None):
            nonlocal n
            n += 1
            own = [{"font_name_source": "run", "font_size_source": "run", "bold_source": "run", "italic_source": "run", **r} for r in runs]
            broken = bool(runs) and runs[-1]["text"] == "" and not table
            paragraphs.append({"document_id": document_id, "ord": n, "id": f"p{n:04d}", "text": "".join(r["text"] for r in runs), "style_name": "", "alignment": "left",
                               "line_break_after": broken, "in_table": table, "cell": cell, "runs": own})
            return f"p{n:04d}"

        for k, b in enumerate(self.blocks):
            if b["kind"] == "p":
                node = add(b["runs"])
            else:
                t += 1
                node = f"t{t:02d}"
                for i, row in enumerate(b["cells"]):
                    for j, runs in enumerate(row):
                        add(runs, node, {"row": i, "col": j})
            self.ids[b["name"]] = node
            blocks.append({"document_id": document_id, "container_id": "body", "sibling_ord": k, "kind": b["kind"], "node_id": node, "has_drawing": b.get("drawing", False)})
        return paragraphs, blocks


def frames(spark, manuscripts):
    """(paragraphs, blocks) of manuscripts by id."""
    paragraphs, blocks = [], []
    for name, m in manuscripts.items():
        p, b = m.rows(name)
        paragraphs += p
        blocks += b
    return spark.createDataFrame(paragraphs, schemas.PARAGRAPHS), spark.createDataFrame(blocks, schemas.BLOCKS)


def _set(block, field, value, i=0):
    def change(m):
        r = m.run(block, i)
        r.update(run(value, r["font_size_pt"], r["bold"], r["italic"], r["superscript"]) if field == "text" else {field: value})

    return change


def _cell(m):
    m.block("table1")["cells"][0][1][0]["font_size_pt"] = 10.0


def _no_break(m):
    m.block("introduction_heading")["runs"].pop()


#: By rule: the one change that breaks it, and rules that then break too.
MUTATIONS = {
    "global-font": (_set("introduction_body", "font_name", "Arial"), set()),
    "title-size": (_set("title", "font_size_pt", 11.0), set()),
    "title-bold": (_set("title", "bold", False), set()),
    "title-case": (_set("title", "text", "a study of small rivers"), set()),
    "title-wordlimit": (_set("title", "text", "A Study " + " ".join(f"Word{i}" for i in range(30))), set()),
    "author-bold": (_set("author", "bold", False), set()),
    "author-size": (_set("author", "font_size_pt", 12.0), set()),
    "author-affiliation-superscript": (_set("author", "superscript", False, 1), set()),
    "abstract-heading-italic": (_set("abstract_heading", "italic", False), set()),
    "abstract-body-italic": (_set("abstract_body", "italic", False), set()),
    "abstract-size": (_set("abstract_body", "font_size_pt", 11.0), set()),
    "abstract-wordlimit": (_set("abstract_body", "text", "word " * 260 + "end."), set()),
    "affiliation-italic": (_set("affiliation", "italic", False, 1), set()),
    "affiliation-size": (_set("affiliation", "font_size_pt", 9.0, 1), set()),
    "heading-uppercase-literal": (_set("introduction_heading", "text", "Introduction"), set()),
    "heading-bold": (_set("introduction_heading", "bold", False), set()),
    "heading-size": (_set("introduction_heading", "font_size_pt", 11.0), set()),
    "heading-no-colon": (_set("introduction_heading", "text", "INTRODUCTION:"), set()),
    "heading-line-break-after": (_no_break, set()),
    "body-text-size": (_set("introduction_body", "font_size_pt", 11.0), set()),
    "citation-superscript": (_set("introduction_body", "superscript", False, 1), set()),
    "citation-bracket-format": (_set("introduction_body", "text", "(1)", 1), set()),
    "table-caption-position": (lambda m: m.move("table1", "table1_caption"), set()),
    "table-caption-numbering-style": (_set("table1_caption", "text", "Table 1. Depths in metres by month, for each of the rivers seen."), {"table-cited-in-text"}),
    "table-numbering-sequence": (_set("table2_caption", "text", "Table III. Widths in metres by month, for each of the rivers seen."), {"table-cited-in-text"}),
    "table-text-size": (_cell, set()),
    "table-cited-in-text": (_set("table1_citing", "text", "The depths of all rivers are listed below for the first of the two years."), set()),
    "figure-caption-position": (lambda m: m.move("figure1_caption", "figure1"), set()),
    "figure-caption-numbering-style": (_set("figure1_caption", "text", "Figure I. A map of all of the rivers and towns as of spring."), {"figure-cited-in-text"}),
    "figure-numbering-sequence": (_set("figure2_caption", "text", "Figure 4. A map of all of the rivers and towns as of autumn."), {"figure-cited-in-text"}),
    "figure-cited-in-text": (_set("figure1_citing", "text", "A map of all of the rivers and towns is drawn below as it was in spring."), set()),
    "reference-style-italic": (_set("reference0", "italic", False), set()),
    "reference-style-size": (_set("reference0", "font_size_pt", 10.0), set()),
}


def mutated(rule_id):
    m = copy.deepcopy(Manuscript())
    MUTATIONS[rule_id][0](m)
    return m
