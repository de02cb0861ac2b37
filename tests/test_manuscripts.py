import json

import pytest
from manuscript import MUTATIONS, Manuscript, frames, mutated

from galley.plans import manuscripts as M
from galley.plans.journal import journal

RULES = journal()


@pytest.fixture(scope="module")
def checked(spark):
    docs = {"compliant": Manuscript(), **{r: mutated(r) for r in MUTATIONS}}
    paragraphs, blocks = (f.cache() for f in frames(spark, docs))
    state = M.check(paragraphs, blocks, RULES)
    state.violations = state.violations.cache()
    return docs, paragraphs, blocks, state


def rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.document_id, []).append(r)
    return out


def test_each_mutation_breaks_its_rule_alone(checked):
    found = rows(checked[3].violations)
    assert found.get("compliant", []) == []
    got = {d: sorted(v.rule_id for v in found.get(d, [])) for d in MUTATIONS}
    assert got == {d: sorted({d} | more) for d, (_, more) in MUTATIONS.items()}


def test_shape_of_violations(checked):
    docs, *_, state = checked
    by = {d: v[0] for d, v in rows(state.violations).items()}
    v = by["global-font"]
    assert (v.paragraph_id, list(v.run_indices), v.found, v.expected, v.auto_fixable, v.section) == (docs["global-font"].ids["introduction_body"], [0], "font_name == 'Arial'", "font_name == 'Times New Roman'", True, "introduction")
    assert by["title-size"].found == "font_size_pt == 11.0" and by["title-bold"].found == "bold == False"
    assert by["table-text-size"].details == {"table_id": "t01"} and list(by["table-text-size"].run_indices) == [0]
    v = next(v for v in rows(state.violations)["table-numbering-sequence"] if v.rule_id == "table-numbering-sequence")
    assert v.found == "caption_number == 'III' (position 2)" and v.details == {"id": "t02"}


def test_sections(checked):
    docs, _, _, state = checked
    by = {r.id: (r.section, r.section_source, r.section_confidence) for r in state.paragraphs.where("document_id = 'compliant'").collect()}
    ids = docs["compliant"].ids
    assert by[ids["title"]] == ("title", "positional", 0.7) and by[ids["author"]][:2] == ("author", "positional") and by[ids["affiliation"]][0] == "affiliation"
    assert by[ids["keywords"]] == ("abstract", "positional", 0.9) and by[ids["abstract_heading"]] == ("abstract", "heading", 1.0)
    assert by[ids["methods_body"]] == ("methods_and_materials", "inherited", 0.5) and by[ids["corresponding"]][0] == "corresponding_author_address"
    seg = state.segmentation.where("document_id = 'compliant'").first()
    assert seg.missing == [] and not seg.front_matter_only and seg.body_heading_count == 10


def test_fix_and_check_again(spark, checked):
    docs, paragraphs, blocks, state = checked
    after, outcome, applied = M.fix(state, RULES)
    status = {(r.document_id, r.rule_id): (r.status, r.failure_reason) for r in outcome.collect()}
    fixable = {r.rule_id for r in RULES.rules if r.auto_fixable}
    assert {d: status[d, d] for d in MUTATIONS if d in fixable} == {d: ("fixed", "") for d in MUTATIONS if d in fixable}
    assert {d for d, _ in status if d in fixable} == {r.document_id for r in applied.where("ok").collect()} & fixable
    again = rows(M.check(after, blocks, RULES).violations)
    left = {d: {v.rule_id for v in again.get(d, [])} for d in fixable}
    assert {d: own for d, own in left.items() if d in MUTATIONS and d in own} == {}


def test_report_and_semantic_stub(checked):
    *_, state = checked
    both = M.ask(state, RULES)
    found = rows(both.violations)
    assert sorted({v.status for v in found["compliant"]}) == ["check_failed"] and len(found["compliant"]) == 7
    out = {r.document_id: json.loads(r.report) for r in M.report(both, both.violations, RULES, "2026-01-01T00:00:00Z").collect()}
    assert out["title-size"]["summary"] == {"total": 8, "auto_fixed": 0, "needs_review": 1, "check_failed": 7}
    first = out["title-size"]["violations"][0]
    assert list(first)[:8] == ["rule_id", "severity", "section", "paragraph_id", "expected", "found", "auto_fixable", "status"] and first["rule_id"] == "title-size"


def test_degraded_and_missing(spark):
    m = Manuscript()
    m.blocks = [b for b in m.blocks if not b["name"].startswith("discussion")]
    few = Manuscript()
    few.blocks = few.blocks[:8]
    paragraphs, blocks = frames(spark, {"gap": m, "few": few})
    found = rows(M.check(paragraphs, blocks, RULES).violations)
    assert [(v.rule_id, v.found, v.anchor_paragraph_id) for v in found["gap"]] == [("section-present-discussion", "section 'discussion' not found", "p0001")]
    assert {v.status for v in found["few"] if v.rule_id == "body-text-size"} == {"check_failed"}
    assert {v.rule_id for v in found["few"] if v.rule_id.startswith("section-present")} >= {"section-present-result"}


def test_overrides_win(spark, checked):
    docs, paragraphs, blocks, _ = checked
    own = paragraphs.where("document_id = 'compliant'")
    chosen = spark.createDataFrame([("compliant", docs["compliant"].ids["methods_body"], "result"), ("compliant", "p9999", "title")], "document_id string, id string, section string")
    state = M.check(own, blocks.where("document_id = 'compliant'"), RULES, chosen)
    (r,) = state.paragraphs.where(f"id = '{docs['compliant'].ids['methods_body']}'").collect()
    assert (r.section, r.section_source, r.section_confidence) == ("result", "override", 1.0)


def test_report_tells_notes_and_overrides(spark, checked):
    docs, paragraphs, blocks, _ = checked
    one = "document_id in ('compliant', 'title-size')"
    chosen = spark.createDataFrame([("compliant", docs["compliant"].ids["methods_body"], "result"), ("compliant", "p0001", "title")], "document_id string, id string, section string")
    state = M.check(paragraphs.where(one), blocks.where(one), RULES, chosen)
    out = {r.document_id: json.loads(r.report) for r in M.report(state, state.violations, RULES, "2026-01-01T00:00:00Z", ['said "so"']).collect()}
    assert out["compliant"]["section_overrides"] == {"p0001": "title", docs["compliant"].ids["methods_body"]: "result"} and out["compliant"]["notes"] == ['said "so"']
    assert "section_overrides" not in out["title-size"] and list(out["compliant"])[-2:] == ["notes", "section_overrides"]


def test_semantic_rules_ask_about_what_they_select(checked):
    docs, *_, state = checked
    own = state.paragraphs.where("document_id = 'compliant'")
    from galley.operators import semantic

    asked = {r.rule_id: r for r in semantic.prompts(own, RULES, "m").collect()}
    texts = {r.id: (r.section, r.text, r.section_source) for r in own.collect()}
    entries = [t for s, t, source in texts.values() if s == "references" and source != "heading"]
    assert asked["reference-style-vancouver-format"].text == " ".join(entries) and len(entries) == 3
    assert asked["abstract-keywords-count"].text.startswith("Keywords:") and asked["doc-order"].text.startswith("title -> author -> abstract")
    assert all("{" not in r.prompt for r in asked.values())


def test_trees_hold_all_of_a_document(checked):
    from galley.operators import trees

    docs, *_, state = checked
    mine = "document_id = 'compliant'"
    labelled, items = state.paragraphs.where(mine), {k: v.where(mine) for k, v in state.items.items()}
    tree = json.loads(trees.documents(labelled, items["tables"], items["figures"]).first().tree)
    rows = sorted(labelled.collect(), key=lambda r: r.ord)
    assert [(p["id"], p["text"], p["section"], [x["text"] for x in p["runs"]]) for p in tree["paragraphs"]] == [(r.id, r.text, r.section, [x.text for x in r.runs]) for r in rows]
    assert [p["cell"] for p in tree["paragraphs"] if "in_table" in p] == [[r.cell.row, r.cell.col] for r in rows if r.in_table]
    assert [(t["id"], t["caption_position"], t["cell_font_size_pt"]) for t in tree["tables"]] == [("t01", "above", 8.0), ("t02", "above", 8.0)] and len(tree["figures"]) == 2
    assert {r.in_table: r.ids for r in trees.cell_ids(labelled).collect()} == {t: [r.id for r in rows if r.in_table == t] for t in ("t01", "t02")}
