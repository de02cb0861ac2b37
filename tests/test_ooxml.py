import io
import json
import zipfile
from xml.sax.saxutils import escape

import pytest
from manuscript import Manuscript, mutated

from galley import cli
from galley.errors import RulesetError
from galley.plans import manuscripts as M
from galley.plans.journal import journal
from galley.sources import ooxml, writeback

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f"""<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:asciiTheme="minorHAnsi"/><w:sz w:val="20"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="H"><w:name w:val="heading 1"/><w:basedOn w:val="B"/><w:rPr><w:b/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="B"><w:name w:val="Base"/><w:basedOn w:val="H"/><w:rPr><w:i/><w:sz w:val="30"/></w:rPr></w:style>
<w:style w:type="character" w:styleId="C"><w:rPr><w:caps/><w:b w:val="0"/></w:rPr></w:style></w:styles>"""
THEME = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:majorFont><a:latin typeface="Big"/></a:majorFont><a:minorFont><a:latin typeface="Small"/></a:minorFont></a:theme>'


def docx(body, styles=STYLES):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {NS} xmlns:x="urn:x"><w:body>{body}<w:sectPr/></w:body></w:document>')
        z.writestr("word/styles.xml", styles)
        z.writestr("word/theme/theme1.xml", THEME)
    return out.getvalue()


def xml_run(r):
    flags = "".join(f"<w:{t}/>" for t, f in (("b", "bold"), ("i", "italic")) if r[f])
    props = f'<w:rFonts w:ascii="{r["font_name"]}"/>{flags}<w:sz w:val="{int(r["font_size_pt"] * 2)}"/>' + ('<w:vertAlign w:val="superscript"/>' if r["superscript"] else "")
    inner = f'<w:t xml:space="preserve">{escape(r["text"])}</w:t>' if r["text"] else "<w:br/>"
    return f"<w:r><w:rPr>{props}</w:rPr>{inner}</w:r>"


def as_docx(m):
    out = []
    for b in m.blocks:
        if b["kind"] == "p":
            out.append("<w:p>" + "".join(map(xml_run, b["runs"])) + ("<w:r><w:drawing/></w:r>" if b["drawing"] else "") + "</w:p>")
        else:
            rows = "".join("<w:tr>" + "".join("<w:tc><w:p>" + "".join(map(xml_run, c)) + "</w:p></w:tc>" for c in row) + "</w:tr>" for row in b["cells"])
            out.append(f"<w:tbl>{rows}</w:tbl>")
    return docx("".join(out))


def test_effective_formatting():
    body = """<w:p><w:pPr><w:pStyle w:val="H"/><w:jc w:val="both"/></w:pPr><w:r><w:t>a b</w:t></w:r><w:r><w:rPr><w:rStyle w:val="C"/><w:rFonts w:ascii="Own"/></w:rPr><w:t>x</w:t></w:r></w:p>
      <w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:bookmarkStart/>"""
    paragraphs, blocks = ooxml.parse(docx(body))
    one, two = paragraphs[0]["runs"]
    assert (one["text"], one["font_name"], one["font_name_source"], one["font_size_pt"], one["bold"], one["italic"], one["bold_source"]) == ("a b", "Small", "theme", 15.0, True, True, "paragraph_style")
    assert (two["font_name"], two["bold"], two["all_caps_property"], two["superscript"]) == ("Own", False, True, False)
    assert (paragraphs[0]["style_name"], paragraphs[0]["alignment"]) == ("heading 1", "justify")
    assert [(p["in_table"], p["cell"] and (p["cell"]["row"], p["cell"]["col"])) for p in paragraphs[1:]] == [("t01", (0, 0)), ("t01", (0, 2)), ("t01", (1, 1))]
    assert [b["kind"] for b in blocks] == ["p", "tbl", "other", "other"]


def grid_of(rows):
    """Brute force: the owner of each place of the grid, then each owner where it is first seen, with its column in the row.
    rows: (columns left out before, [(span, merge)])."""
    grid, seen, out = {}, set(), []
    for i, (before, own) in enumerate(rows):
        at = before
        for k, (span, merge) in enumerate(own):
            owner = grid.get((i - 1, at)) if merge == "continue" else None
            owner = owner or (i, k)
            for g in range(at, at + span):
                grid[i, g] = owner
            if owner not in seen:
                seen.add(owner)
                out.append((i, at - before, owner))
            at += span
    return out


def test_merged_cells_equal_the_grid():
    import random

    rng = random.Random(8)
    for _ in range(200):
        rows = [(rng.choice([0, 0, 1, 2]), [(rng.choice([1, 1, 2, 3]), rng.choice([None, None, "restart", "continue", "continue"])) for _ in range(rng.randint(1, 4))]) for _ in range(rng.randint(1, 5))]
        xml = ""
        for i, (before, own) in enumerate(rows):
            xml += "<w:tr>" + (f'<w:trPr><w:gridBefore w:val="{before}"/></w:trPr>' if before else "")
            for k, (span, merge) in enumerate(own):
                mark = {None: "", "restart": '<w:vMerge w:val="restart"/>', "continue": "<w:vMerge/>"}[merge]
                xml += f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/>{mark}</w:tcPr><w:p><w:r><w:t>{i},{k}</w:t></w:r></w:p></w:tc>'
            xml += "</w:tr>"
        paragraphs, _ = ooxml.parse(docx(f"<w:tbl>{xml}</w:tbl>"))
        assert [(p["cell"]["row"], p["cell"]["col"], p["text"]) for p in paragraphs] == [(i, j, f"{a},{b}") for i, j, (a, b) in grid_of(rows)]


def test_figures_in_cells_and_boxes(spark):
    p = lambda text, inner="": f'<w:p><w:r><w:t xml:space="preserve">{text}</w:t></w:r>{inner}</w:p>'
    image = "<w:r><w:drawing/></w:r>"
    box = f'<w:r><w:pict><w:txbxContent>{p("", image)}{p("Figure 4. In a box")}</w:txbxContent></w:pict></w:r>'
    nested = f'<w:tbl><w:tr><w:tc>{p("Figure 3. Nested")}{p("", image)}</w:tc></w:tr></w:tbl>'
    body = p("a", image) + p("Figure 1. Body") + f'<w:tbl><w:tr><w:tc>{p("", image)}{p("Figure 2. In a cell")}</w:tc><w:tc>{nested}<w:p/></w:tc></w:tr></w:tbl>' + p("see Figure 2 and Figure 4 ", box) + p("Table 1. x")
    docs = spark.createDataFrame([("d", "x/a.docx", docx(body))], "document_id string, path string, content binary")
    paragraphs, blocks, errors = ooxml.read(docs)
    assert errors.isEmpty()
    from galley.operators import captions

    rows = captions.figures(blocks, paragraphs).orderBy("ord").collect()
    got = [(r.id, r.paragraph_id, r.caption_paragraph_id, r.caption_position, r.caption_number, r.position, list(r.referenced_in_paragraph_ids)) for r in rows]
    assert got == [("f01", "p0001", "p0002", "below", "1", 1, []), ("f02", "p0003", "p0004", "below", "2", 2, ["p0006"]), ("f03", None, None, "above", "3", 3, []),
                   ("f04", "p0006", None, None, None, None, []), ("f05", None, None, "below", "4", 4, ["p0006"])]
    (table,) = captions.tables(blocks, paragraphs).collect()
    assert (table.id, table.caption_number) == ("t01", None)


def test_patch_keeps_the_rest():
    content = as_docx(Manuscript())
    assert writeback.patch(content, {}) is content
    new = writeback.patch(content, {"p0001": [{"text": "New", "bold": False, "font_size_pt": 11.5, "font_name": "F"}]})
    before, after = ooxml.parse(content)[0], ooxml.parse(new)[0]
    assert after[1:] == before[1:] and (after[0]["text"], after[0]["runs"][0]["bold"], after[0]["runs"][0]["font_size_pt"], after[0]["runs"][0]["font_name"]) == ("New", False, 11.5, "F")
    assert zipfile.ZipFile(io.BytesIO(new)).read("word/styles.xml") == STYLES.encode()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("docs")
    for name, m in {"good": Manuscript(), **{r: mutated(r) for r in ("title-size", "heading-no-colon", "heading-line-break-after", "table-caption-numbering-style")}}.items():
        (where / f"{name}.docx").write_bytes(as_docx(m))
    return where


def test_files_to_corrected_files(spark, folder):
    docs = M.cut(ooxml.documents(spark, str(folder)))
    paragraphs, blocks, errors = map(M.cut, ooxml.read(docs))
    assert errors.isEmpty()
    rules = journal()
    state = M.check(paragraphs, blocks, rules)
    names = {r.document_id: r.path.rsplit("/", 1)[-1][:-5] for r in docs.collect()}
    found = {}
    for v in state.violations.collect():
        found.setdefault(names[v.document_id], set()).add(v.rule_id)
    assert found == {"title-size": {"title-size"}, "heading-no-colon": {"heading-no-colon"}, "heading-line-break-after": {"heading-line-break-after"},
                     "table-caption-numbering-style": {"table-caption-numbering-style", "table-cited-in-text"}}
    after, outcome, _ = M.fix(state, rules)
    new = {names[r.document_id]: bytes(r.content) for r in writeback.corrected(docs, paragraphs, after).collect()}
    assert new["good"] == (folder / "good.docx").read_bytes()
    again = spark.createDataFrame([(k, v) for k, v in new.items()], "path string, content binary")
    p, b, _ = map(M.cut, ooxml.read(again))
    assert sorted({(v.rule_id, v.found) for v in M.check(p, b, rules).violations.collect()}) == []


def test_unreadable_file_is_an_error_row(spark, tmp_path):
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    paragraphs, _, errors = ooxml.read(ooxml.documents(spark, str(tmp_path)))
    assert paragraphs.collect() == [] and errors.first().error.startswith("BadZipFile")
    assert cli.validate(spark, str(tmp_path), str(tmp_path / "out"), journal(), False, False) == 3
    assert cli.main([]) == 2


def test_command_line(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.docx").write_bytes((folder / "title-size.docx").read_bytes())
    (tmp_path / "in/bad.docx").write_bytes(b"no zip")
    out = tmp_path / "out"
    assert cli.validate(spark, str(tmp_path / "in"), str(out), journal(), False, True) == 3
    assert json.loads((out / "errors.json").read_text())["errors"][0]["path"].endswith("bad.docx")
    assert json.loads((out / "one.report.json").read_text())["summary"]["auto_fixed"] == 1
    (entry,) = json.loads((out / "one.audit.json").read_text())["entries"]
    assert entry["rule_id"] == "title-size" and entry["before"]["font_size_pt"] == 11.0 and entry["after"]["font_size_pt"] == 14.0
    for kind in ("corrected", "redline", "annotated"):
        assert ooxml.parse((out / f"one.{kind}.docx").read_bytes())[0][0]["runs"][0]["font_size_pt"] == (11.0 if kind == "annotated" else 14.0)
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == ["errors.json", "one.annotated.docx", "one.audit.json", "one.corrected.docx", "one.redline.docx", "one.report.json"]


def test_capitals_and_lone_breaks_are_written():
    content = as_docx(Manuscript())
    new = writeback.patch(content, {"p0001": [{"all_caps_property": False, "text": "X"}]})
    assert b'caps w:val="0"' in zipfile.ZipFile(io.BytesIO(new)).read("word/document.xml")
    assert not ooxml.parse(new)[0][0]["runs"][0]["all_caps_property"]


def test_prompt_files(tmp_path):
    from galley.plans import ruleset

    rule = {"rule_id": "r", "check_type": "semantic", "prompt_file": "ask.txt", "prompt_vars": ["x"]}
    (tmp_path / "rules.json").write_text(json.dumps({"ruleset_id": "a", "ruleset_version": "1", "rules": [rule]}))
    with pytest.raises(RulesetError, match="rule r, prompt_file"):
        ruleset.load(tmp_path / "rules.json")
    (tmp_path / "ask.txt").write_text("Judge {x}")
    assert ruleset.load(tmp_path / "rules.json").rules[0].prompt_template == "Judge {x}"


def test_folder_is_watched(spark, folder, tmp_path):
    from galley.streaming import dropfolder

    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / f"in/{name}.docx").write_bytes((folder / "title-size.docx").read_bytes())
    seen = []
    q = dropfolder.watch(spark, str(tmp_path / "in"), journal(), lambda frame, n: seen.extend(r.rule_id for r in frame.collect()), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert seen == ["title-size"]
