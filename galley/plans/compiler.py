"""Rules to Column expressions: all rules of one node type are one scan.

Each rule becomes an array of one hit that is null where it holds; the hits of a node's rules are one array that is inlined,
and what they say of their rule is looked up in a constant. Run rules are higher-order functions over the
runs of a paragraph, so no run is exploded.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.errors import RulesetError
from galley.functions import numerals as N
from galley.functions import text as T
from galley.functions.once import once
from galley.operators.predicates import predicate
from galley.plans import schemas
from galley.plans.ruleset import BODY, Condition, DeterministicRule, Ruleset, SemanticRule

_RUN = schemas.kinds(schemas.PARAGRAPHS, "runs")
_PARAGRAPH = {k: v for k, v in schemas.kinds(f"{schemas.PARAGRAPHS}, {schemas.LABELS}").items()}
_ITEM = schemas.kinds(schemas.ITEMS)
#: Rules that no condition can express, by id.
SEQUENCES = {"table-numbering-sequence": "tables", "figure-numbering-sequence": "figures"}
TABLE_TEXT = "table-text-size"


def condition(c: Condition, source: Column | None, kinds: dict[str, str], lenient: bool = False) -> Column:
    """A test of a row (source None) or of a struct. An unknown attribute is an error, or null if lenient."""
    if c.attribute not in kinds:
        if not lenient:
            raise RulesetError(f"no attribute {c.attribute!r}")
        return predicate(c.operator, F.lit(None).cast("string"), c.value, "string")
    actual = F.col(c.attribute) if source is None else source[c.attribute]
    return predicate(c.operator, actual, c.value, kinds[c.attribute])


def selected(rule: DeterministicRule | SemanticRule) -> Column:
    """Whether a rule looks at a paragraph: not in a table, in its sections, through its filter, not excluded."""
    test = F.col("in_table").isNull()
    if rule.applies_to_section:
        test &= F.coalesce(F.col("section").isin(*rule.applies_to_section), F.lit(False))
    if rule.selector.paragraph_filter:
        test &= condition(rule.selector.paragraph_filter, None, _PARAGRAPH)
    for pattern in rule.exclude_patterns:
        test &= ~T.matches(F.col("text"), pattern, True)
    return test


#: What a rule says of a node; all else follows from the rule's number and the node.
_HIT = {"rule_seq": "int", "run_indices": "array<int>", "found": "string", "status": "string", "failure_reason": "string", "anchor": "string", "own_section": "string", "own_ord": "int"}


def hit(seq: int | Column, **more: Column) -> Column:
    values = {"rule_seq": F.lit(seq) if isinstance(seq, int) else seq, "found": F.lit(""), "status": F.lit("open"), "failure_reason": F.lit("")} | more
    return F.struct(*((values[n] if n in values else F.lit(None).cast(kind)).alias(n) for n, kind in _HIT.items()))


def rule_facts(rules: Sequence[tuple[int, DeterministicRule]]) -> Column:
    """What violations say of their rule, an array by rule_seq: a constant that the optimizer folds."""
    rows: list[dict | None] = [None] * (max((i for i, _ in rules), default=0) + 1)
    for i, r in rules:
        rows[i] = {"rule_id": r.rule_id, "severity": r.severity, "expected": r.expected, "fixable": r.auto_fixable, "message": r.message}
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule_id:string,severity:string,expected:string,fixable:boolean,message:string>>")


def violations(hits: DataFrame, facts: Column, **node: Column) -> DataFrame:
    """Hits with all columns of violations; facts: what they say of their rule, node: what the scanned node gives."""
    hits = hits.withColumn("rule", F.get(facts, F.col("rule_seq")))
    facts = {n: F.col(f"rule.{n}") for n in ("rule_id", "severity", "expected", "message")}
    values = facts | {"auto_fixable": F.col("rule.fixable") & (F.col("status") == "open"), "anchor_paragraph_id": F.col("anchor")} | node
    own = (values.get(n, F.col(n) if n in hits.columns else F.lit(None)).cast(kind).alias(n) for n, kind in schemas.kinds(schemas.VIOLATION).items())
    return hits.select("document_id", *own)


def shown(attribute: str, value: Column, kind: str) -> Column:
    return F.concat(F.lit(f"{attribute} == "), T.python_repr(value, kind))


#: What each run says of each rule on runs: one pass over the runs, whatever the number of rules.
TOLD = "told_of_runs"


def told_of_runs(rules: Sequence[tuple[int, DeterministicRule]], cells: Sequence[int]) -> Column:
    """For each run a struct with, by rule, whether the rule looks at it (seen) and whether it fails (fails). Blank runs count in
    cells only."""

    def told(run: Column) -> Column:
        shown, own = [], []
        for i, r in rules:
            fails = ~condition(r.condition, run, _RUN)
            if i in cells:
                own.append(F.coalesce(fails, F.lit(False)).alias(f"fails{i}"))
                continue
            seen = condition(r.selector.filter, run, _RUN) if r.selector.filter else F.lit(True)
            shown.append(F.coalesce(seen & fails, F.lit(False)).alias(f"fails{i}"))
            if r.selector.scope != "every":
                shown.append(F.coalesce(seen, F.lit(False)).alias(f"seen{i}"))
        visible = [F.when(T.non_blank(run["text"]), F.struct(*shown)).alias("shown")] if shown else []
        return F.struct(*visible, *own)

    looked = [F.col("in_table").isNotNull() if i in cells else selected(r) for i, r in rules]
    return F.when(reduce(Column.__or__, looked), F.transform("runs", told))


def _where(test: Callable[[Column], Column]) -> Column:
    """Indices of the runs of which something is told."""
    return F.filter(F.transform(TOLD, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())


def _failing_runs(seq: int, rule: DeterministicRule, visible_only: bool) -> Column:
    """Indices of the runs for which a paragraph fails, by the selector's scope; empty or null where it doesn't."""
    if not visible_only:
        return _where(lambda t: t[f"fails{seq}"])
    failing = _where(lambda t: t["shown"][f"fails{seq}"])
    if rule.selector.scope == "every":
        return failing
    every = _where(lambda t: t["shown"][f"seen{seq}"])
    if rule.selector.scope == "any":
        return F.when(F.size(failing) == F.size(every), failing)
    return F.when(F.get(failing, F.lit(0)) == F.get(every, F.lit(0)), F.slice(failing, 1, 1))


def _runs_hit(seq: int, failing: Column, name: str) -> Column:
    """The indices are bound by a lambda, so that their expression stands in the plan once."""

    def said(indices: Column) -> Column:
        first = F.get(F.col("runs"), F.get(indices, F.lit(0)))[name]
        return F.when(F.coalesce(F.size(indices), F.lit(0)) > 0, hit(seq, run_indices=indices, found=shown(name, first, _RUN[name])))

    return F.transform(F.array(failing), said)


def run_rule(rule: DeterministicRule, seq: int) -> Column:
    return _runs_hit(seq, F.when(selected(rule), _failing_runs(seq, rule, True)), rule.condition.attribute)


def paragraph_rule(rule: DeterministicRule, seq: int) -> Column:
    name = rule.condition.attribute
    row = hit(seq, found=shown(name, F.col(name), _PARAGRAPH[name]))
    return F.array(F.when(selected(rule) & ~condition(rule.condition, None, _PARAGRAPH), row))


def table_text_rule(rule: DeterministicRule, seq: int) -> Column:
    """Cells of tables, blank runs included."""
    return _runs_hit(seq, F.when(F.col("in_table").isNotNull(), _failing_runs(seq, rule, False)), rule.condition.attribute)


def item_rule(rule: DeterministicRule, seq: int) -> Column:
    name = rule.condition.attribute
    if rule.rule_id in SEQUENCES:
        right = N.numeral_value(F.col("caption_number"), F.col("numbering_style")).eqNullSafe(F.col("position"))
        found = F.concat(F.lit("caption_number == "), T.python_repr(F.col("caption_number"), "string"), F.lit(" (position "), F.col("position").cast("string"), F.lit(")"))
        return F.array(F.when(F.col("caption_number").isNotNull() & ~right, hit(seq, found=found)))
    return F.array(F.when(~condition(rule.condition, None, _ITEM), hit(seq, found=shown(name, F.col(name), _ITEM[name]))))


def section_text_rule(rule: DeterministicRule, seq: int, own: Column) -> Column:
    """own: the paragraphs of a document that the rule selects, in order, read as one text."""
    c = rule.condition
    if c.attribute != "text":
        raise RulesetError(f"no attribute {c.attribute!r}")

    def said(rows: Column) -> Column:
        text, head = F.array_join(F.transform(rows, lambda x: x["text"]), " "), F.get(rows, F.lit(0))
        section = F.lit(rule.applies_to_section[0]) if rule.applies_to_section else head["section"]
        row = hit(seq, own_section=section, anchor=head["id"], own_ord=head["ord"], found=shown("text", text, "string"))
        return F.when((F.size(rows) > 0) & ~predicate(c.operator, text, c.value, "string"), row)

    return F.transform(F.array(own), said)


def inlined(frame: DataFrame, hits: Column, *keep: str) -> DataFrame:
    """A row for each hit in an array of hits, with the columns kept. One select, whatever the number of rules."""
    return frame.select("document_id", *keep, F.inline(hits))


def together(hits: Sequence[Column]) -> Column | None:
    """Arrays of hits as one, without those that hold."""
    return F.array_compact(F.concat(*hits)) if hits else None


def gates(rules: Sequence[tuple[int, DeterministicRule]]) -> Column:
    """What decides, with a document's segmentation, whether a rule can be checked: a constant, so that the tests below stand in
    the plan once, whatever the number of rules."""
    rows = []
    for i, r in rules:
        name = r.condition.attribute.removeprefix("section:") if r.selector.node_type == "document" and r.condition.attribute.startswith("section:") else None
        rows.append({"seq": i, "sections": sorted(r.applies_to_section), "body": bool(set(r.applies_to_section) & set(BODY)), "told": r.on_missing_section != "skip",
                     "status": "open" if r.on_missing_section == "violation" else "check_failed", "present": name})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<seq:int,sections:array<string>,body:boolean,told:boolean,status:string,present:string>>")


def _untrusted(gate: Column) -> Column:
    return gate["body"] & F.col("front_matter_only")


def _gone(gate: Column) -> Column:
    return (F.size(gate["sections"]) > 0) & (F.size(F.array_except(gate["sections"], F.col("missing"))) == 0)


def unchecked(gate: Column) -> Column:
    """The hit that stands for a rule that a document's segmentation doesn't let it check, or for a section that must be there."""
    reason = F.when(_untrusted(gate), F.coalesce(F.nullif(F.col("degraded_reason"), F.lit("")), F.lit("section boundaries undetected")))
    reason = F.coalesce(reason, F.when(gate["told"] & _gone(gate), F.concat(F.lit("section not found: "), F.array_join(gate["sections"], ", "))))
    absent = F.array_contains(F.col("missing"), gate["present"])
    open_one = F.lit("open")
    status = F.when(reason.isNotNull(), gate["status"]).otherwise(open_one)
    found = F.coalesce(reason, F.concat(F.lit("section '"), gate["present"], F.lit("' not found")))
    row = hit(gate["seq"], status=status, failure_reason=F.coalesce(reason, F.lit("")), found=found, anchor=F.when(reason.isNull(), F.col("first_id")))
    return F.when(reason.isNotNull() | F.coalesce(absent, F.lit(False)), row)


@dataclass(frozen=True)
class Compiled:
    """The deterministic rules of a ruleset as Columns: what runs say of them; hits of paragraphs, of tables and figures, of section texts; the parts of
    those texts; facts of rules; rules that a document's segmentation switches off, and what is told of them."""

    runs: Column | None
    paragraphs: Column | None
    items: dict[str, Column]
    texts: Column | None
    parts: tuple[Column, ...]
    cells: tuple[int, ...]
    facts: Column
    off: Column | None
    told: Column | None


@once
def compiled(text: str) -> Compiled:
    """From a ruleset's JSON."""
    rules = [(i, r) for i, r in enumerate(Ruleset.model_validate_json(text).with_presence_rules().ordered()) if isinstance(r, DeterministicRule)]
    cells = [i for i, r in rules if r.rule_id == TABLE_TEXT]
    per_paragraph = [run_rule(r, i) for i, r in rules if r.selector.node_type == "run"]
    per_paragraph += [paragraph_rule(r, i) for i, r in rules if r.selector.node_type == "paragraph"]
    per_paragraph += [table_text_rule(r, i) for i, r in rules if i in cells]
    items = {kind: together([item_rule(r, i) for i, r in rules if r.selector.node_type == kind and i not in cells]) for kind in ("table", "figure")}
    texts = [(i, r) for i, r in rules if r.selector.node_type == "section_text"]
    part = F.struct("ord", "text", "id", "section")
    parts = tuple(F.array_sort(F.collect_list(F.when(selected(r), part))).alias(f"own{i}") for i, r in texts)
    # rules without sections can't be switched off, and only rules of documents say what is absent
    closable = any(r.applies_to_section for _, r in rules)
    present = any(r.selector.node_type == "document" and r.condition.attribute.startswith("section:") for _, r in rules)
    off = F.transform(F.filter(gates(rules), lambda g: _untrusted(g) | _gone(g)), lambda g: g["seq"]) if closable else None
    told = F.array_compact(F.transform(gates(rules), unchecked)) if closable or present else None
    on_runs = [(i, r) for i, r in rules if r.selector.node_type == "run" or i in cells]
    return Compiled(told_of_runs(on_runs, cells) if on_runs else None, together(per_paragraph), {k: v for k, v in items.items() if v is not None}, together([section_text_rule(r, i, F.col(f"own{i}")) for i, r in texts]), parts, tuple(cells), rule_facts(rules), off, told)


def hits(paragraphs: DataFrame, ruleset: Ruleset) -> DataFrame:
    """Paragraphs with what rules on them and on their runs find, an array beside each; a hit holds the facts of its rule. Rulesets
    that look at more than single paragraphs are an error."""
    rules = compiled(ruleset.model_dump_json())
    if rules.items or rules.texts is not None or rules.off is not None or rules.told is not None:
        raise RulesetError("rules that look at more than single paragraphs")
    told = paragraphs if rules.runs is None else paragraphs.withColumn(TOLD, rules.runs)
    found = F.array().cast(f"array<struct<{','.join(f'{n}:{k}' for n, k in _HIT.items())}>>") if rules.paragraphs is None else rules.paragraphs
    return told.withColumn("hits", F.transform(found, lambda h: h.withField("rule", F.get(rules.facts, h["rule_seq"])))).drop(TOLD)


def validate(paragraphs: DataFrame, items: dict[str, DataFrame], segmentation: DataFrame, ruleset: Ruleset) -> DataFrame:
    """Violations of the deterministic rules in labelled documents.

    A scan for each kind of node that has rules, whatever their number: paragraphs, section texts, tables, figures; and the
    segmentation where sections decide. rule_seq and node_ord give the order of rules and of nodes. A ruleset without
    deterministic rules finds nothing.
    """
    rules = compiled(ruleset.model_dump_json())
    out: list[DataFrame] = []
    if rules.paragraphs is not None:
        in_cell = F.col("rule_seq").isin(*rules.cells)
        details = F.when(in_cell, F.create_map(F.lit("table_id"), F.col("in_table")))
        told = paragraphs if rules.runs is None else paragraphs.withColumn(TOLD, rules.runs)
        hits = inlined(told, rules.paragraphs, "section", "id", "ord", "in_table")
        out.append(violations(hits, rules.facts, section=F.when(in_cell, "result").otherwise(F.col("section")), paragraph_id=F.col("id"), node_ord=F.col("ord"), details=details))
    for kind, own in rules.items.items():
        hits = inlined(items[f"{kind}s"], own, "caption_paragraph_id", "ord", "id")
        out.append(violations(hits, rules.facts, section=F.lit("result"), paragraph_id=F.col("caption_paragraph_id"), node_ord=F.col("ord"), details=F.create_map(F.lit("id"), F.col("id"))))
    if rules.texts is not None:
        hits = inlined(paragraphs.groupBy("document_id").agg(*rules.parts), rules.texts)
        out.append(violations(hits, rules.facts, section=F.col("own_section"), node_ord=F.col("own_ord")))
    found = None
    for p in out:
        found = p if found is None else found.unionByName(p)
    if found is not None and rules.off is not None:
        closed = segmentation.select("document_id", rules.off.alias("off"))
        found = found.join(closed, "document_id", "left").where(~F.coalesce(F.array_contains("off", F.col("rule_seq")), F.lit(False))).drop("off")
    if rules.told is not None:
        judged = violations(inlined(segmentation, rules.told), rules.facts)
        found = judged if found is None else found.unionByName(judged)
    return paragraphs.sparkSession.createDataFrame([], f"document_id string, {schemas.VIOLATION}") if found is None else found
