"""Queries that run the rule engine itself over the driver's tables: sections, rules, captions, fixes, prompts, reports.

The tables hold no manuscripts, so orders stand for documents and line items for their paragraphs or runs; a line item's
quantity picks a text from a fixed list. The SQL beside each query states the same semantics by relational means.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import text as T
from galley.operators import captions, fixes, reports, sections, semantic, trees
from galley.plans import compiler, ruleset, schemas
from galley.plans.journal import journal
from galley.plans.manuscripts import cut
from galley.plans.tables import healthy, items, orders_as_paragraphs, query, run, shaped, table

STAMP = "2026-01-01T00:00:00Z"


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _rules(*rules: dict, **more) -> ruleset.Ruleset:
    """A ruleset as a file would hold it."""
    return ruleset.parse(json.dumps({"ruleset_id": "orders", "ruleset_version": "1.0.0", "rules": list(rules)} | more))


def _rule(name: str, node: str, attribute: str, operator: str, value=None, scope: str = "every", only=None, fix: str | None = None, params: dict | None = None, **more) -> dict:
    selector = {"node_type": node, "scope": scope} | ({"filter": only} if only else {})
    if "paragraph_filter" in more:
        selector["paragraph_filter"] = more.pop("paragraph_filter")
    condition = {"attribute": attribute, "operator": operator} | ({} if value is None else {"value": value})
    return {"rule_id": name, "check_type": "deterministic", "selector": selector, "condition": condition, "auto_fixable": fix is not None, "fix_action": fix, "fix_params": params or {}} | more


def _number(c: str):
    return F.col(c).cast("bigint")


def _joined(c) -> Column:
    return F.array_join(F.transform(c, lambda i: i.cast("string")), ",")


# Rules over runs: an order is a paragraph, its line items are runs

_ITEMS = """(select l_orderkey, l_quantity, l_discount, l_returnflag, l_linestatus, row_number() over (partition by l_orderkey
  order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as i from lineitem)"""


def _found(paragraphs: DataFrame, *rules: dict) -> DataFrame:
    return compiler.validate(paragraphs, {}, healthy(paragraphs), _rules(*rules)).withColumn("l_orderkey", _number("document_id"))


def _sized() -> Column:
    return run(font_size_pt=F.col("l_quantity"))


@query(f"select l_orderkey, string_agg(i::varchar, ',' order by i) as failing from {_ITEMS} where not l_quantity <= 45 group by l_orderkey")
def run_every(spark, sf_dir):
    """Orders with line items that fail, and which."""
    out = _found(orders_as_paragraphs(spark, sf_dir, _sized()), _rule("size", "run", "font_size_pt", "<=", 45))
    return out.select("l_orderkey", _joined("run_indices").alias("failing"))


@query(f"select l_orderkey, count(*)::bigint as n from {_ITEMS} group by l_orderkey having not bool_or(l_quantity <= 10)")
def run_any(spark, sf_dir):
    """Orders none of whose line items passes."""
    out = _found(orders_as_paragraphs(spark, sf_dir, _sized()), _rule("size", "run", "font_size_pt", "<=", 10, "any"))
    return out.select("l_orderkey", F.size("run_indices").cast("bigint").alias("n"))


@query(f"select l_orderkey, l_quantity as found from {_ITEMS} where i = 0 and not l_quantity <= 25")
def run_first(spark, sf_dir):
    """Orders whose first line item fails."""
    out = _found(orders_as_paragraphs(spark, sf_dir, _sized()), _rule("size", "run", "font_size_pt", "<=", 25, "first"))
    return out.select("l_orderkey", F.replace("found", F.lit("font_size_pt == "), F.lit("")).cast("double").alias("found"))


@query(f"select l_orderkey, string_agg(i::varchar, ',' order by i) as failing from {_ITEMS} where l_returnflag = 'R' and not l_discount <= 0.05 group by l_orderkey")
def select_runs(spark, sf_dir):
    """A filter on runs before the test, with the places in the whole order kept."""
    returned = {"attribute": "text", "operator": "==", "value": "R"}
    runs = run(text=F.col("l_returnflag"), font_size_pt=F.col("l_discount"))
    out = _found(orders_as_paragraphs(spark, sf_dir, runs), _rule("discount", "run", "font_size_pt", "<=", 0.05, only=returned))
    return out.select("l_orderkey", _joined("run_indices").alias("failing"))


@query("select o_orderkey, o_orderpriority, l_linenumber, l_quantity from orders join lineitem on l_orderkey = o_orderkey where l_quantity > 48")
def table_cells(spark, sf_dir):
    """Cells of tables that fail, with their table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity").join(orders, "o_orderkey")
    rows = cells.select(*shaped(schemas.PARAGRAPHS, document_id=F.col("o_orderkey"), ord=F.col("l_linenumber"), id=F.col("l_linenumber"), text=F.lit("x"), in_table=F.col("o_orderpriority"), runs=F.array(_sized())), *shaped(schemas.LABELS))
    out = _found(rows, _rule(compiler.TABLE_TEXT, "table", "font_size_pt", "<=", 48))
    size = F.replace("found", F.lit("font_size_pt == "), F.lit("")).cast("double")
    return out.select(F.col("l_orderkey").alias("o_orderkey"), F.col("details")["table_id"].alias("o_orderpriority"), F.col("paragraph_id").cast("int").alias("l_linenumber"), size.alias("l_quantity"))


def _turns(spark, sf_dir, section, text=None) -> DataFrame:
    """Conversations as documents, turns as labelled paragraphs."""
    rows = table(spark, sf_dir, "conversations")
    own = shaped(schemas.PARAGRAPHS, document_id=F.col("conv_id"), ord=F.col("turn"), id=F.col("turn"), text=F.col("text") if text is None else text, style_name=F.lit(""), line_break_after=F.lit(False), runs=F.array())
    return rows.select(*own, *shaped(schemas.LABELS, section=section, section_confidence=F.lit(0.5), section_source=F.lit("inherited")))


@query(r"""select conv_id, length(regexp_extract_all(t, '[^ \n\t\r]+'))::bigint as words, anchor from (select conv_id, string_agg(text, ' ' order by turn) as t, min(turn) as anchor
from conversations where role = 'user' group by conv_id) where length(regexp_extract_all(t, '[^ \n\t\r]+')) > 40""")
def section_text_rule(spark, sf_dir):
    """Turns of a role as one text, in order, over a limit of words."""
    rows = _turns(spark, sf_dir, F.when(F.col("role") == "user", "abstract"))
    rule = _rule("words", "section_text", "text", "word_count_lte", 40, applies_to_section=["abstract"])
    out = compiler.validate(rows, {}, healthy(rows), _rules(rule)).select("document_id", "anchor_paragraph_id")
    texts = semantic.section_texts(rows, F.col("section") == "abstract").select("document_id", T.word_count(F.col("text")).alias("words"))
    return out.join(texts, "document_id").select(_number("document_id").alias("conv_id"), "words", _number("anchor_paragraph_id").alias("anchor"))


# Sections of conversations and sources

_SPEAKERS = _rules(section_synonyms={"introduction": ["system"], "result": ["user"]}, required_sections=["introduction", "result"])


@query("""select conv_id, turn, last_value(case when role in ('system', 'user') then role end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as section from conversations""")
def forward_fill_section(spark, sf_dir):
    """The last heading's section for each turn."""
    labelled, _ = sections.segment(_turns(spark, sf_dir, F.lit(None), F.col("role")).drop(*schemas.kinds(schemas.LABELS)), _SPEAKERS)
    section = F.when(F.col("section") == "introduction", "system").when(F.col("section") == "result", "user")
    return labelled.select(_number("document_id").alias("conv_id"), F.col("ord").cast("bigint").alias("turn"), section.alias("section"))


@query("select conv_id, count(*) filter (where role = 'user')::bigint as n, count(*) filter (where role = 'user') < 4 as degraded from conversations group by conv_id")
def degraded_docs(spark, sf_dir):
    """Documents with too few headings."""
    rows = _turns(spark, sf_dir, F.lit(None), F.col("role")).drop(*schemas.kinds(schemas.LABELS))
    _, segmentation = sections.segment(rows, _rules(section_synonyms={"result": ["user"]}))
    return segmentation.select(_number("document_id").alias("conv_id"), F.col("body_heading_count").alias("n"), F.col("front_matter_only").alias("degraded"))


@query("""select conv_id, string_agg(role, ' -> ' order by turn) as sections from (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as was from conversations)
where role is distinct from was group by conv_id""")
def section_order(spark, sf_dir):
    """Roles in order of appearance, runs of one role once."""
    return semantic.section_order(_turns(spark, sf_dir, F.col("role"))).select(_number("document_id").alias("conv_id"), F.col("text").alias("sections"))


#: Languages stand for sections with the same order of names.
_LANGUAGES = {"de": "abstract", "en": "author", "es": "conclusion", "fr": "discussion", "it": "funding"}


@query("""with need as (select source, l.lang from (select distinct source from documents), (values ('en'), ('de'), ('fr'), ('es'), ('it')) l(lang)),
gone as (select source, lang from need except select source, lang from documents)
select d.source, coalesce((select string_agg(lang, ',' order by lang) from gone g where g.source = d.source), '') as missing, (select count(distinct lang) from documents e where e.source = d.source)::bigint as n_found
from (select distinct source from documents) d""")
def missing_sections(spark, sf_dir):
    """Required languages that a source lacks."""
    to, back = (F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in (_LANGUAGES, {v: k for k, v in _LANGUAGES.items()}))
    labelled = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), to[F.col("lang")].alias("section"), F.lit(0).alias("counted"))
    out = sections.summary(labelled, _rules(required_sections=list(_LANGUAGES.values())))
    return out.select(F.col("document_id").alias("source"), F.array_join(F.transform("missing", lambda s: back[s]), ",").alias("missing"), F.size("detected").cast("bigint").alias("n_found"))


@query("select doc_id, coalesce('q' || quality, lang) as section, case when quality is null then 'inherited' else 'override' end as source, case when quality is null then 0.5 else 1.0 end::double as confidence from documents left join labels using (doc_id)")
def override_labels(spark, sf_dir):
    """Labels that a reader has set win."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "doc_id", F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("section"), F.lit(0.5).alias("section_confidence"), F.lit("inherited").alias("section_source"))
    given = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("section"))
    given = given.join(docs.select("doc_id", "document_id", "id"), "doc_id").drop("doc_id")
    out, _ = sections.override(docs, healthy(docs).withColumns({"detected": F.array().cast("array<string>"), "body_heading_count": F.lit(0)}), given, _rules())
    return out.select("doc_id", "section", F.col("section_source").alias("source"), F.col("section_confidence").alias("confidence"))


@query("select doc_id, 'q' || quality as section from documents join labels using (doc_id) where quality is not null and 'q' || quality <> case when n_chars % 2 = 0 then 'q1' else 'q0' end")
def changed_overrides(spark, sf_dir):
    """Choices that differ from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("q"), (F.col("n_chars") + 1) % 2).alias("section"))
    chosen = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("section"))
    chosen = chosen.join(docs.drop("section"), "doc_id").select("document_id", "id", "section")
    return reports.changed_overrides(docs, chosen).select(_number("id").alias("doc_id"), "section")


# Orders as manuscripts: each line item is a paragraph whose text its quantity picks

TEXTS = [
    "ABSTRACT", "Keywords: a, b", "Dept of Rivers, ray@example.org", "Introduction", "RESULTS:", "materials methods and", "", "Ana Ray, Ole Lund",
    "Plain words that say little more than what was said before them.", "2. Discussion", "conclusion", "Conclusions:", "References", "   ", "12",
]
_JOURNAL = journal()
_VOCABULARY = ", ".join(f"('{s}', '{w}', {i})" for i, (s, w) in enumerate((s, w) for s, ws in _JOURNAL.section_synonyms.items() for w in ws))

_LINES = f"""lines as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as ord,
  {_sql_list(TEXTS)}[l_quantity::int % {len(TEXTS)} + 1] as txt, l_quantity as size, l_linestatus = 'O' as bold, l_returnflag = 'R' as sup, l_discount > 0.085 as styled, l_discount < 0.005 as cell from lineitem)"""
_SEGMENT = f"""with {_LINES}, vocabulary(section, word, place) as (values {_VOCABULARY}),
scored as (select *, trim(txt) <> '' as shown, len(regexp_extract_all(txt, '[^ ]+')) as words,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(txt)), '^([0-9]+|[ivxlcdm]+|[a-z])[.)] +', ''), ':+$', ''), ' +', ' ', 'g')) as norm,
  3 * styled::int + 2 * bold::int + 2 * (regexp_matches(txt, '[A-Za-z]') and upper(txt) = txt)::int + (len(regexp_extract_all(txt, '[^ ]+')) <= 8)::int + (not suffix(trim(txt), '.'))::int as structural from lines),
hits as (select norm, coalesce((select first(section order by place) from vocabulary v where v.word = n.norm), (select first(section order by place) from vocabulary v
    where list_sort(list_distinct(string_split(v.word, ' '))) = list_sort(list_distinct(list_filter(string_split(n.norm, ' '), lambda x: x <> ''))))) as hit,
  case when exists (select 1 from vocabulary v where v.word = n.norm) then 1.0 else 0.95 end::double as hit_confidence from (select distinct norm from scored where shown) n),
heads as (select s.*, hit, hit_confidence, shown and structural + case when hit is null then 0 else 3 end >= 3 as heading from scored s left join hits using (norm)),
started as (select *, coalesce(min(ord) filter (where heading and hit is not null and hit not in ('title', 'author', 'abstract', 'affiliation') and not cell) over (partition by doc), max(ord) over (partition by doc) + 1) as body from heads),
titled as (select *, ord < body and shown as front, min(ord) filter (where ord < body and shown) over (partition by doc) as title from started),
abstracted as (select *, min(ord) filter (where front and ord > title and heading and hit = 'abstract') over (partition by doc) as abstract from titled),
filled as (select *, ord >= body and heading and hit is not null and not cell as head, last_value(case when ord >= body and heading and hit is not null and not cell then hit end ignore nulls)
  over (partition by doc order by ord rows between unbounded preceding and current row) as so_far, 2 * sup::int + (words between 1 and 20)::int + (contains(txt, ',') or contains(lower(txt), ' and '))::int as author,
  (regexp_matches(txt, '(?i)orcid|e-?mail|@') or sup and regexp_matches(trim(txt), '^[0-9]+$')) as affiliation, regexp_matches(lower(trim(txt)), '^(keywords|key words|keyword)') as keywords from abstracted),
kinds as (select *, case when front then case when ord = title then 'title' when ord = abstract then 'heading' when keywords then 'keywords' when affiliation then 'affiliation' when abstract is null or ord < abstract then 'author' else 'text' end
  when ord >= body then case when head then 'head' else 'inherited' end else 'none' end as kind from filled),
labelled as (select doc, ord, txt, size, bold, sup, cell, shown, head, body,
  case kind when 'title' then 'title' when 'heading' then 'abstract' when 'keywords' then 'abstract' when 'affiliation' then 'affiliation' when 'author' then 'author' when 'text' then 'abstract' when 'head' then hit when 'inherited' then so_far end as section,
  case kind when 'title' then 0.7 when 'heading' then hit_confidence when 'keywords' then 0.9 when 'affiliation' then 0.9 when 'author' then round(0.5 + 0.1 * least(author, 4), 1) when 'text' then 0.6 when 'head' then hit_confidence
    when 'inherited' then case when cell then 0.4 else 0.5 end else 0 end::double as confidence,
  case kind when 'heading' then 'heading' when 'head' then 'heading' when 'inherited' then 'inherited' when 'none' then 'unknown' else 'positional' end as source from kinds)"""


def manuscripts(spark, sf_dir) -> DataFrame:
    rows = items(spark, sf_dir)
    text = F.element_at(F.array(*map(F.lit, TEXTS)), F.col("l_quantity").cast("int") % len(TEXTS) + 1)
    own = run(text=text, font_size_pt=F.col("l_quantity"), bold=F.col("l_linestatus") == "O", superscript=F.col("l_returnflag") == "R", uppercase_literal=T.is_upper_literal(text))
    return rows.select(*shaped(schemas.PARAGRAPHS, document_id=F.col("l_orderkey"), ord=F.col("place"), id=F.format_string("p%04d", "place"), text=text, style_name=F.when(F.col("l_discount") > 0.085, "Heading 1").otherwise("Normal"),
                               line_break_after=F.lit(False), in_table=F.when(F.col("l_discount") < 0.005, "t01"), runs=F.array(own)))


@query(_SEGMENT + " select doc as document_id, ord::int as ord, section, confidence, source from labelled")
def segment_orders(spark, sf_dir):
    """Every paragraph's section, how sure it is and where it is from."""
    labelled, _ = sections.segment(manuscripts(spark, sf_dir), _JOURNAL)
    return labelled.select(_number("document_id").alias("document_id"), "ord", "section", F.round("section_confidence", 2).alias("confidence"), F.col("section_source").alias("source"))


_REQUIRED = _sql_list(sorted(_JOURNAL.required_sections))


@query(_SEGMENT + f""" select doc as document_id, coalesce(string_agg(distinct section, ',' order by section), '') as detected, array_to_string(list_filter({_REQUIRED}, lambda x: not coalesce(list_contains(list(section), x), false)), ',') as missing,
count(*) filter (where head)::bigint as n, count(*) filter (where head) < 4 as front_matter_only, case when count(*) filter (where head) < 4 then 'only ' || count(*) filter (where head) || ' body headings found' else '' end as reason from labelled group by doc""")
def segment_summary(spark, sf_dir):
    """Sections found and missing, and whether the headings can be trusted."""
    _, out = sections.segment(manuscripts(spark, sf_dir), _JOURNAL)
    return out.select(_number("document_id").alias("document_id"), F.array_join("detected", ",").alias("detected"), F.array_join("missing", ",").alias("missing"), F.col("body_heading_count").alias("n"), "front_matter_only", F.col("degraded_reason").alias("reason"))


_HEADING = {"attribute": "section_source", "operator": "==", "value": "heading"}
_CHECKS = _rules(
    _rule("body-size", "run", "font_size_pt", "<=", 30, fix="set_font_size", params={"font_size_pt": 30}, applies_to_section=["introduction", "result", "discussion", "conclusion"], severity="high", priority=5),
    _rule("no-colon", "paragraph", "text", "not_matches_regex", r":\s*$", fix="strip_trailing_colon", paragraph_filter=_HEADING, priority=4, message="No colon."),
    _rule("abstract-words", "section_text", "text", "word_count_lte", 1, applies_to_section=["abstract"], exclude_patterns=[r"^\s*keywords?\s*:"], severity="low"),
    _rule("references-bold", "run", "bold", "==", True, applies_to_section=["references"], on_missing_section="violation"),
    _rule("discussion-case", "paragraph", "text", "is_title_case", applies_to_section=["discussion"], on_missing_section="check_failed"),
    _rule("title-words", "paragraph", "text", "word_count_lte", 2, applies_to_section=["title"], priority=3),
    _rule(compiler.TABLE_TEXT, "table", "font_size_pt", "<=", 40, priority=6),
    section_synonyms={s: list(w) for s, w in _JOURNAL.section_synonyms.items()}, required_sections=["introduction", "result", "references", "discussion"],
)
#: The rules by number, in the order in which they are evaluated.
_NUMBER = {r.rule_id: i for i, r in enumerate(_CHECKS.with_presence_rules().ordered())}


def _repr(c: str) -> str:
    return f"'text == ''' || {c} || ''''"


def _part(name: str, columns: str, source: str, gate: str) -> str:
    return f"select doc, '{name}' as rule_id, {columns} from {source} join state using (doc) where {gate}"


_NONE = "null::varchar"
_BROKEN = f"""{_SEGMENT}, state as (select doc, count(*) filter (where head) as n, count(*) filter (where head) < 4 as few, min(ord) as first,
  list_filter(['discussion', 'introduction', 'references', 'result'], lambda x: not coalesce(list_contains(list(section), x), false)) as missing from labelled group by doc),
abstracts as (select doc, string_agg(txt, ' ' order by ord) as txt, min(ord) as ord from labelled where section = 'abstract' and not cell and not regexp_matches(txt, '(?i)^ *keywords? *:') group by doc),
broken as (
{_part("title-words", f"section, ord, null::bigint as anchor, 'open' as status, {_repr('txt')} as found, false as fixable, null::varchar as run_indices", "labelled", "section = 'title' and not cell and len(regexp_extract_all(txt, '[^ ]+')) > 2")} union all
{_part("no-colon", f"section, ord, null, 'open', {_repr('txt')}, true, null", "labelled", "source = 'heading' and not cell and suffix(rtrim(txt), ':')")} union all
{_part("body-size", "section, ord, null, 'open', 'font_size_pt == ' || size, true, '0'", "labelled", "section in ('introduction', 'result', 'discussion', 'conclusion') and not cell and shown and size > 30 and not few")} union all
{_part("table-text-size", "'result', ord, null, 'open', 'font_size_pt == ' || size, false, '0'", "labelled", "cell and size > 40")} union all
{_part("abstract-words", f"'abstract', null, ord, 'open', {_repr('txt')}, false, null", "abstracts", "len(regexp_extract_all(txt, '[^ ]+')) > 1")} union all
{_part("references-bold", "section, ord, null, 'open', 'bold == False', false, '0'", "labelled", "section = 'references' and not cell and shown and not bold and not few")} union all
{_part("discussion-case", f"section, ord, null, 'open', {_repr('txt')}, false, null", "labelled", "section = 'discussion' and not cell and not few and not (regexp_matches(txt, '[A-Z]') and not regexp_matches(txt, '[A-Za-z][A-Z]') and not regexp_matches(txt, '(^|[^A-Za-z])[a-z]'))")} union all
select doc, r, null, null, null, s, 'only ' || n || ' body headings found', false, null from state, (values ('body-size', 'check_failed'), ('discussion-case', 'check_failed')) v(r, s) where few union all
select doc, 'references-bold', null, null, null, 'open', 'only ' || n || ' body headings found', false, null from state where few union all
select doc, r, null, null, null, s, 'section not found: ' || w, false, null from state, (values ('references-bold', 'open', 'references'), ('discussion-case', 'check_failed', 'discussion')) v(r, s, w) where not few and list_contains(missing, w) union all
select doc, 'section-present-' || w, null, null, first, 'open', 'section ''' || w || ''' not found', false, null from (select doc, first, unnest(missing) as w from state))"""
_ORDERED = ", ".join(f"('{k}', {v})" for k, v in _NUMBER.items())


def _checked(spark, sf_dir):
    labelled, segmentation = sections.segment(manuscripts(spark, sf_dir), _CHECKS, cut)
    segmentation = cut(segmentation)
    return labelled, segmentation, compiler.validate(labelled, {}, segmentation, _CHECKS)


@query(_BROKEN + f""" select doc as document_id, rule_id, seq as rule_seq, section, printf('p%04d', ord) as paragraph_id, printf('p%04d', anchor) as anchor, status, found, coalesce(fixable and status = 'open', false) as auto_fixable, run_indices
from broken join (values {_ORDERED}) o(rule_id, seq) using (rule_id)""")
def rules_on_orders(spark, sf_dir):
    """Violations of rules of every kind, gates and presence rules included."""
    _, _, found = _checked(spark, sf_dir)
    return found.select(_number("document_id").alias("document_id"), "rule_id", "rule_seq", "section", "paragraph_id", F.col("anchor_paragraph_id").alias("anchor"), "status", "found", "auto_fixable",
                        F.when(F.size("run_indices") > 0, _joined("run_indices")).alias("run_indices"))


@query(_BROKEN + f""", sized as (select doc, count(b.rule_id)::bigint as total, count(*) filter (where status = 'open')::bigint as needs_review, nullif(count(*) filter (where status = 'check_failed'), 0)::bigint as check_failed,
  arg_min(b.rule_id, (seq * 1000 + coalesce(ord, -1))) as first_rule from state left join broken b using (doc) left join (values {_ORDERED}) o(rule_id, seq) on o.rule_id = b.rule_id group by doc)
select doc as document_id, total, 0::bigint as auto_fixed, needs_review, check_failed, array_to_string(missing, ',') as missing, first_rule from sized join state using (doc)""")
def report_json(spark, sf_dir):
    """Reports as JSON, read again: counts, missing sections and the first violation."""
    _, segmentation, found = _checked(spark, sf_dir)
    out = reports.reports(found, segmentation, _CHECKS, STAMP)
    read = F.from_json("report", "summary struct<total: bigint, auto_fixed: bigint, needs_review: bigint, check_failed: bigint>, missing_sections array<string>, violations array<struct<rule_id: string>>")
    return out.select(_number("document_id").alias("document_id"), read.alias("r")).select("document_id", "r.summary.*", F.array_join(F.coalesce("r.missing_sections", F.array().cast("array<string>")), ",").alias("missing"), F.get("r.violations", F.lit(0))["rule_id"].alias("first_rule"))


@query(_BROKEN + """ select doc as document_id, rule_id, printf('p%04d', coalesce(ord, anchor)) as anchor, case rule_id when 'no-colon' then 'No colon.' when 'title-words' then 'title-words: expected text word_count_lte 2, found ' || found else 'other' end as said
from broken where coalesce(ord, anchor) is not null and rule_id in ('no-colon', 'title-words')""")
def report_comments(spark, sf_dir):
    """What comments say and where they stand."""
    _, _, found = _checked(spark, sf_dir)
    some = found.where(F.col("rule_id").isin("no-colon", "title-words"))
    rows = reports.comments(some).select(_number("document_id").alias("document_id"), "anchor", F.col("comment").alias("said"))
    return rows.select("document_id", F.when(F.col("said") == "No colon.", "no-colon").otherwise(F.split_part("said", F.lit(":"), F.lit(1))).alias("rule_id"), "anchor", "said")


@query(_BROKEN + """ select doc as document_id, rule_id, section, case rule_id when 'body-size' then 'high' when 'abstract-words' then 'low' when 'no-colon' then 'medium' else case when starts_with(rule_id, 'section-present-') then 'high' else 'medium' end end as severity, status,
case when rule_id = 'no-colon' then 'No colon.' when starts_with(rule_id, 'section-present-') then 'The section ''' || replace(rule_id, 'section-present-', '') || ''' is required.' else found end as what from broken""")
def result_grid(spark, sf_dir):
    """The rows of a table of results."""
    _, _, found = _checked(spark, sf_dir)
    return reports.grid(found).withColumn("document_id", _number("document_id"))


# Captions: line items as blocks

CAPTIONS = ["Table I. First", "Table 4: Second", "Figure 1. Map", "see Table I and table  4, or Figure 1", "fig. II: Plan", "Table X without a mark", "Fig 3. Shape", ""]
_BLOCKS = f"""blocks as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as ord, l_linestatus = 'O' and l_returnflag = 'R' as tbl,
  l_linestatus = 'F' and l_returnflag = 'R' as drawing, {_sql_list(CAPTIONS)}[l_quantity::int % {len(CAPTIONS)} + 1] as txt from lineitem),
numbered as (select *, case when not tbl then nullif(regexp_extract(txt, '(?i)^ *Table +([IVXLCDM0-9]+)[.:]', 1), '') end as t, case when not tbl then nullif(regexp_extract(txt, '(?i)^ *Fig(?:ure)?\\.? +([IVXLCDM0-9]+)[.:]', 1), '') end as f from blocks),
near as (select *, lag(t) over w as t_before, lead(t) over w as t_after, lag(f) over w as f_before, lead(f) over w as f_after from numbered window w as (partition by doc order by ord)),
words as (select doc, ord, w, lag(w) over x as was from (select doc, ord, unnest(regexp_extract_all(txt, '[A-Za-z0-9]+')) as w, generate_subscripts(regexp_extract_all(txt, '[A-Za-z0-9]+'), 1) as k from numbered where not tbl) window x as (partition by doc, ord order by k))"""


def _blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(blocks, paragraphs) of orders: a returned open item is a table, a returned closed one a paragraph with a drawing."""
    rows = items(spark, sf_dir)
    is_table = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")
    text = F.element_at(F.array(*map(F.lit, CAPTIONS)), F.col("l_quantity").cast("int") % len(CAPTIONS) + 1)
    node = F.when(is_table, F.format_string("t%02d", "place")).otherwise(F.format_string("p%04d", "place"))
    rows = rows.withColumns({"node_id": node, "text": text, "document_id": F.col("l_orderkey").cast("string"), "is_table": is_table})
    blocks = rows.select("document_id", F.lit("body").alias("container_id"), F.col("place").alias("sibling_ord"), F.when(is_table, "tbl").otherwise("p").alias("kind"), "node_id", ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("has_drawing"))
    paragraphs = rows.where(~is_table).select(*shaped(schemas.PARAGRAPHS, document_id=F.col("document_id"), ord=F.col("place"), id=F.col("node_id"), text=F.col("text"), runs=F.array()))
    return blocks, paragraphs


def _style(c: str) -> str:
    return f"case when {c} is null then null when regexp_matches({c}, '^[IVXLCDM]+$') then 'roman' when regexp_matches({c}, '^[0-9]+$') then 'arabic' else 'other' end"


def _items_sql(letter: str, kind: str, choice: str, number: str, place: str, said: str) -> str:
    return f"""with {_BLOCKS}, chosen as (select doc, ord, {choice} as position, {number} as number, {place} as place from near where {kind}),
ranked as (select *, row_number() over (partition by doc order by ord) as n, case when number is not null then row_number() over (partition by doc, number is not null order by ord) end as nth from chosen),
cited as (select r.doc, r.n, string_agg(distinct printf('p%04d', w.ord), ',' order by printf('p%04d', w.ord)) as cited from ranked r join words w on w.doc = r.doc and lower(w.was) {said} and upper(w.w) = upper(r.number) and w.ord <> r.place group by r.doc, r.n)
select r.doc as document_id, printf('{letter}%02d', r.n) as id, position as caption_position, number as caption_number, {_style('number')} as numbering_style, printf('p%04d', place) as caption_paragraph_id, nth::int as position, coalesce(cited, '') as cited
from ranked r left join cited c on c.doc = r.doc and c.n = r.n"""


def _shown_items(found: DataFrame) -> DataFrame:
    return found.select(_number("document_id").alias("document_id"), "id", "caption_position", "caption_number", "numbering_style", "caption_paragraph_id", "position", F.array_join("referenced_in_paragraph_ids", ",").alias("cited"))


@query(_items_sql("t", "tbl", "case when t_before is not null then 'above' when t_after is not null then 'below' end", "coalesce(t_before, t_after)", "case when t_before is not null then ord - 1 when t_after is not null then ord + 1 end", "= 'table'"))
def table_captions(spark, sf_dir):
    """Tables with their captions, numbers, places in the sequence and paragraphs that cite them."""
    return _shown_items(captions.tables(*_blocks(spark, sf_dir)))


@query(_items_sql("f", "drawing", "case when f_after is not null then 'below' when f_before is not null then 'above' end", "coalesce(f_after, f_before)", "case when f_after is not null then ord + 1 when f_before is not null then ord - 1 end", "= 'figure'"))
def figure_captions(spark, sf_dir):
    """Figures with their captions, numbers, places in the sequence and paragraphs that cite them."""
    return _shown_items(captions.figures(*_blocks(spark, sf_dir)))


@query("""select conv_id, turn, role, n from (select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn)::int as n from conversations) where n <> turn + 1""")
def numbering_sequence(spark, sf_dir):
    """Numbers that don't run on from 1."""
    rows = table(spark, sf_dir, "conversations").withColumn("document_id", F.concat_ws(" ", "conv_id", "role"))
    tables = rows.select(*shaped(schemas.ITEMS, document_id=F.col("document_id"), ord=F.col("turn"), id=F.col("turn"), caption_number=F.col("turn") + 1, numbering_style=F.lit("arabic")))
    tables = captions._positions(tables)
    paragraphs = rows.select(*shaped(schemas.PARAGRAPHS, document_id=F.col("document_id"), ord=F.col("turn"), id=F.col("turn"), text=F.col("text"), runs=F.array()), *shaped(schemas.LABELS))
    out = compiler.validate(paragraphs, {"tables": tables}, healthy(paragraphs), _rules(_rule("table-numbering-sequence", "table", "caption_number", "is_non_empty")))
    part = lambda i: F.split_part("document_id", F.lit(" "), F.lit(i))
    return out.select(part(1).cast("bigint").alias("conv_id"), F.col("details")["id"].cast("bigint").alias("turn"), part(2).alias("role"), F.regexp_extract("found", r"position (\d+)", 1).cast("int").alias("n"))


# Fixes: an order is a paragraph, its line items are runs with formats

RUN_TEXTS = ["(3)", "[4]", "word", "Two Words", "ends:", " ", "X", "é: "]
_CITED = {"attribute": "text", "operator": "matches_regex", "value": r"^[\[\(]\d+[\]\)]$"}
_FIXES = _rules(
    _rule("f-font", "run", "font_name", "==", "A", fix="set_font", params={"font_name": "A"}, priority=1),
    _rule("f-size", "run", "font_size_pt", "<=", 30, fix="set_font_size", params={"font_size_pt": 30}, priority=2),
    _rule("f-size-too", "run", "font_size_pt", "<=", 40, fix="set_font_size", params={"font_size_pt": 40}, priority=3),
    _rule("f-bold", "run", "bold", "==", True, fix="set_bold", params={"bold": True}, priority=4),
    _rule("f-italic", "run", "italic", "==", False, fix="set_italic", params={"italic": False}, priority=4),
    _rule("f-super", "run", "superscript", "==", True, only=_CITED, fix="set_superscript", params={"superscript": True}, priority=5),
    _rule("f-brackets", "run", "text", "matches_regex", r"^\[\d+\]$", only=_CITED, fix="set_citation_brackets", priority=11),
    _rule("f-upper", "run", "uppercase_literal", "==", True, only={"attribute": "text", "operator": "==", "value": "word"}, fix="set_uppercase_literal", priority=6),
    _rule("f-colon", "paragraph", "text", "not_matches_regex", r":\s*$", fix="strip_trailing_colon", priority=7),
    _rule("f-break", "paragraph", "line_break_after", "==", True, fix="insert_line_break", priority=8),
    _rule("f-suggest", "paragraph", "text", "not_matches_regex", r"^X", fix="suggest_only", priority=9),
)
_RUNS = f"""runs as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as i, {_sql_list(RUN_TEXTS)}[l_quantity::int % {len(RUN_TEXTS)} + 1] as txt,
  l_returnflag as font, l_quantity as size, l_linestatus = 'O' as bold, l_discount > 0.045 as italic, l_tax > 0.035 as sup, l_returnflag = 'N' as caps from lineitem),
texts as (select doc, string_agg(txt, '' order by i) as whole, max(i) filter (where trim(txt) <> '') as last_shown from runs group by doc),
broken as (select doc, i, 'f-font' as rule, 'set_font' as action, 'font_name' as attribute, 'A' as params, 1 as priority from runs where trim(txt) <> '' and font <> 'A' union all
  select doc, i, 'f-size', 'set_font_size', 'font_size_pt', '30', 2 from runs where trim(txt) <> '' and size > 30 union all
  select doc, i, 'f-size-too', 'set_font_size', 'font_size_pt', '40', 3 from runs where trim(txt) <> '' and size > 40 union all
  select doc, i, 'f-bold', 'set_bold', 'bold', 'true', 4 from runs where trim(txt) <> '' and not bold union all
  select doc, i, 'f-italic', 'set_italic', 'italic', 'false', 4 from runs where trim(txt) <> '' and italic union all
  select doc, i, 'f-super', 'set_superscript', 'superscript', 'true', 5 from runs where txt in ('(3)', '[4]') and not sup union all
  select doc, i, 'f-brackets', 'set_citation_brackets', 'text', '', 11 from runs where txt = '(3)' union all
  select doc, i, 'f-upper', 'set_uppercase_literal', 'text', '', 6 from runs where txt = 'word' union all
  select doc, null, 'f-colon', 'strip_trailing_colon', 'text', '', 7 from texts where regexp_matches(whole, ':[ ]*$') union all
  select doc, null, 'f-break', 'insert_line_break', 'line_break_after', '', 8 from texts union all
  select doc, null, 'f-suggest', 'suggest_only', 'none', '', 9 from texts where starts_with(whole, 'X')),
targeted as (select *, case when i is null then 'p0001' else printf('p0001.r%02d', i) end as target from broken),
kept as (select *, row_number() over (partition by doc order by priority, target, rule, attribute) as seq from targeted semi join (select doc, target, attribute from targeted group by all having count(distinct params) = 1) using (doc, target, attribute))"""


def _planned(spark, sf_dir):
    """(paragraphs, violations marked, operations) of orders."""
    text = F.element_at(F.array(*map(F.lit, RUN_TEXTS)), F.col("l_quantity").cast("int") % len(RUN_TEXTS) + 1)
    own = run(text=text, font_name=F.col("l_returnflag"), font_size_pt=F.col("l_quantity"), bold=F.col("l_linestatus") == "O", italic=F.col("l_discount") > 0.045,
              superscript=F.col("l_tax") > 0.035, uppercase_literal=T.is_upper_literal(text), all_caps_property=F.col("l_returnflag") == "N")
    paragraphs = orders_as_paragraphs(spark, sf_dir, own)
    ops, marked = fixes.plan(compiler.validate(paragraphs, {}, healthy(paragraphs), _FIXES), fixes.rule_table(spark, _FIXES))
    return paragraphs, marked, ops


@query(f"with {_RUNS} select doc as document_id, rule as rule_id, target as target_id, action, attribute, priority::int as priority, seq::int as seq from kept")
def fix_plan(spark, sf_dir):
    """Operations without conflict, in order."""
    _, _, ops = _planned(spark, sf_dir)
    return fixes.in_order(ops).select(_number("document_id").alias("document_id"), "rule_id", "target_id", "action", "attribute", "priority", "seq")


@query(f"""with {_RUNS} select doc as document_id, rule as rule_id, count(*)::bigint as n_targets, case when bool_or(n > 1) then 'conflict' else 'open' end as status
from targeted join (select doc, target, attribute, count(distinct params) as n from targeted group by all) using (doc, target, attribute) group by doc, rule""")
def fix_conflicts(spark, sf_dir):
    """Violations whose operations would set one attribute to several values."""
    _, marked, _ = _planned(spark, sf_dir)
    return marked.select(_number("document_id").alias("document_id"), "rule_id", F.greatest(F.coalesce(F.size("run_indices"), F.lit(0)), F.lit(1)).cast("bigint").alias("n_targets"), "status")


_AFTER = f"""with {_RUNS}, done as (select r.doc, r.i, case when r.txt = 'word' then 'WORD' when r.txt = '(3)' then '[3]' when r.i = t.last_shown and regexp_matches(t.whole, ':[ ]*$') then regexp_replace(r.txt, ':[ ]*$', '') else r.txt end as txt, r.txt as was,
  trim(r.txt) <> '' as shown, r.font, r.size, r.bold, r.italic, r.sup, r.caps from runs r join texts t using (doc)),
after as (select doc, i, was, txt, case when shown then 'A' else font end as font, case when shown and size > 30 and size <= 40 then 30.0 else size end::double as size, bold or shown as bold, italic and not shown as italic,
  sup or was in ('(3)', '[4]') as sup, caps and was <> 'word' as caps, regexp_matches(txt, '[A-Za-z]') and upper(txt) = txt as literal from done)"""


@query(_AFTER + """ select doc as document_id, string_agg(txt, '' order by i) as text, true as line_break_after,
string_agg(concat_ws('|', txt, font, size::varchar, bold::varchar, italic::varchar, sup::varchar, literal::varchar, caps::varchar), ';' order by i) as runs from after group by doc""")
def fix_apply(spark, sf_dir):
    """Paragraphs after the plan: formats, capitals, brackets, colons and breaks."""
    paragraphs, _, ops = _planned(spark, sf_dir)
    after, _ = fixes.apply(paragraphs, ops)
    fields = ("font_name", "font_size_pt", "bold", "italic", "superscript", "uppercase_literal", "all_caps_property")
    shown = F.transform("runs", lambda r: F.concat_ws("|", r["text"], *(r[f].cast("string") for f in fields)))
    return after.select(_number("document_id").alias("document_id"), "text", "line_break_after", F.array_join(shown, ";").alias("runs"))


@query(f"""with {_RUNS}, ends as (select doc, rule, arg_max(action, seq) as action from kept group by doc, rule)
select doc as document_id, rule as rule_id, case when e.action is null then 'conflict' when e.action = 'suggest_only' then 'fix_failed' else 'fixed' end as status, case when e.action = 'suggest_only' then 'no way to apply it' else '' end as failure_reason
from (select distinct doc, rule from targeted) left join ends e using (doc, rule)""")
def fix_outcomes(spark, sf_dir):
    """Violations with the status that their last operation gives them."""
    paragraphs, marked, ops = _planned(spark, sf_dir)
    _, applied = fixes.apply(paragraphs, ops)
    return fixes.outcomes(marked, applied).select(_number("document_id").alias("document_id"), "rule_id", "status", "failure_reason")


@query(_AFTER + f""" select k.doc as document_id, k.rule as rule_id, k.action, (k.i - 1)::varchar as run_indices, a.was as before_text, a.txt as after_text, '{STAMP}' as timestamp from kept k left join after a on a.doc = k.doc and a.i = k.i where k.action <> 'suggest_only'""")
def audit_entries(spark, sf_dir):
    """An entry for each operation applied."""
    paragraphs, _, ops = _planned(spark, sf_dir)
    _, applied = fixes.apply(paragraphs, ops)
    text = lambda c: F.get_json_object(c, "$.text")
    return fixes.audit(applied, STAMP).select(_number("document_id").alias("document_id"), "rule_id", "action", _joined("run_indices").alias("run_indices"), text("before").alias("before_text"), text("after").alias("after_text"), "timestamp")


@query("with " + _RUNS + f""" select doc as document_id, rule as rule_id, target as target_id, case when rule = 'f-suggest' then 'no way to apply it' else 'target not found' end as failure_reason from (select * from kept where doc % 2 = 0 or rule = 'f-suggest')""")
def missing_targets(spark, sf_dir):
    """Operations whose paragraph is gone, here that of every other order."""
    paragraphs, _, ops = _planned(spark, sf_dir)
    _, applied = fixes.apply(paragraphs.where(_number("document_id") % 2 == 1), ops)
    failed = applied.where("not ok").select(_number("document_id").alias("document_id"), "rule_id", "target_id", "failure_reason")
    return failed.withColumn("failure_reason", F.when(F.col("rule_id") == "f-suggest", "no way to apply it").otherwise(F.col("failure_reason")))


_ROMAN = " ".join(f"when {n} then '{'X' * (n // 10 % 4) if n < 40 else 'XL' if n < 50 else 'L'}{['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10]}'" for n in range(1, 51))


@query(f"select p_partkey, 'Table ' || case p_size {_ROMAN} end || '. ' || p_name as fixed, 'fixed' as status from part")
def caption_renumber(spark, sf_dir):
    """Captions whose number is spelled in the style that a rule asks for."""
    rules = _rules(_rule("style", "table", "numbering_style", "==", "roman", fix="set_numbering_style", params={"numbering_style": "roman"}))
    parts = table(spark, sf_dir, "part")
    runs = F.array(run(text=F.lit(" ")), run(text=F.concat(F.lit("Table "), "p_size", F.lit(". "))), run(text=F.col("p_name")))
    paragraphs = parts.select(*shaped(schemas.PARAGRAPHS, document_id=F.col("p_partkey"), ord=F.lit(1), id=F.lit("p0001"), text=F.concat(F.lit("Table "), "p_size", F.lit(". "), "p_name"), line_break_after=F.lit(False), runs=runs), *shaped(schemas.LABELS))
    tables = parts.select(*shaped(schemas.ITEMS, document_id=F.col("p_partkey"), ord=F.lit(1), id=F.lit("t01"), caption_paragraph_id=F.lit("p0001"), caption_position=F.lit("above"), numbering_style=F.lit("arabic"), caption_number=F.col("p_size"))).withColumn("position", F.lit(1))
    found = cut(compiler.validate(paragraphs, {"tables": tables}, healthy(paragraphs), rules))
    ops, marked = map(cut, fixes.plan(found, fixes.rule_table(spark, rules)))
    after, applied = fixes.apply(paragraphs, ops)
    status = fixes.outcomes(marked, applied).select("document_id", "status")
    return after.join(status, "document_id").select(_number("document_id").alias("p_partkey"), F.trim("text").alias("fixed"), "status")


# Prompts and answers: conversations as documents

def _asked(name: str, node: str, variable: str, sections_: list[str], **more) -> dict:
    selector = {"node_type": node, "scope": "first"} | ({"paragraph_filter": more.pop("paragraph_filter")} if "paragraph_filter" in more else {})
    return more | {"rule_id": name, "check_type": "semantic", "selector": selector, "applies_to_section": sections_, "prompt_template": f"Judge {{{variable}}}!", "prompt_vars": [variable], "message": "Ask."}


_MODEL = "m1"
_QUESTIONS = _rules(_asked("order", "document", "section_order", []), _asked("said", "section_text", "abstract_text", ["abstract"]), _asked("keys", "section_text", "keywords_text", ["abstract"]),
                    _asked("short", "paragraph", "reference_text", ["result"], paragraph_filter={"attribute": "text", "operator": "word_count_lte", "value": 60}, exclude_patterns=["de[^a-z]"]))
_ROLES = {"user": "abstract", "system": "introduction", "assistant": "result"}
_PLAIN = "trim(regexp_replace(replace(lower(txt), 'ß', 'ss'), '[ \\n]+', ' ', 'g'))"
_PROMPTS = f"""with turns as (select conv_id, turn, text, case role when 'user' then 'abstract' when 'system' then 'introduction' else 'result' end as section from conversations),
changes as (select *, lag(section) over (partition by conv_id order by turn) as was from turns),
texts as (select conv_id, 'order' as rule_id, 0 as rule_seq, string_agg(section, ' -> ' order by turn) as txt, min(turn) as anchor, 'section_order' as v from changes where section is distinct from was group by conv_id union all
  select c.conv_id, 'said', 1, t.txt, t.anchor, 'abstract_text' from (select distinct conv_id from turns) c left join (select conv_id, string_agg(text, ' ' order by turn) as txt, min(turn) as anchor from turns where section = 'abstract' group by conv_id) t using (conv_id) union all
  select c.conv_id, 'keys', 2, t.txt, t.anchor, 'keywords_text' from (select distinct conv_id from turns) c left join (select conv_id, arg_min(text, turn) as txt, min(turn) as anchor from turns where section = 'abstract' and regexp_matches(lower(trim(text)), '^(keywords|key words|keyword)') group by conv_id) t using (conv_id) union all
  select c.conv_id, 'short', 3, t.txt, t.anchor, 'reference_text' from (select distinct conv_id from turns) c left join (select conv_id, string_agg(text, ' ' order by turn) as txt, min(turn) as anchor from turns
    where section = 'result' and len(regexp_extract_all(text, '[^ \n\t\r]+')) <= 60 and not regexp_matches(text, 'de[^a-z]', 'i') group by conv_id) t using (conv_id)),
asked as (select *, 'Judge ' || txt || '!' as prompt, sha256('1.0.0|' || rule_id || '|Judge {{' || v || '}}!|{_MODEL}|0.0' || coalesce('|' || {_PLAIN}, '')) as cache_key from texts)"""


def _prompts(spark, sf_dir) -> DataFrame:
    section = F.create_map(*(F.lit(x) for kv in _ROLES.items() for x in kv))[F.col("role")]
    return semantic.prompts(_turns(spark, sf_dir, section), _QUESTIONS, _MODEL)


@query(_PROMPTS + " select conv_id, rule_id, rule_seq::int as rule_seq, anchor, prompt, cache_key from asked")
def semantic_prompts(spark, sf_dir):
    """What rules ask of each document, and the keys under which answers are kept."""
    return _prompts(spark, sf_dir).select(_number("document_id").alias("conv_id"), "rule_id", "rule_seq", _number("anchor").alias("anchor"), "prompt", "cache_key")


def _oracle() -> semantic.Client:
    """A client that answers by the length of a prompt: a violation, none, something unreadable, or a failure."""

    def client(batches):
        for b in batches:
            n = b["prompt"].str.len()
            answer = [f'{{"violation": {str(k % 4 == 0).lower()}, "explanation": "{k} long", "confidence": 1.0}}' if k % 4 < 2 else "no" if k % 4 == 2 else None for k in n]
            yield b[["cache_key"]].assign(answer=answer, failure=["timeout" if k % 4 == 3 else None for k in n], attempts=1)

    return client


@query(_PROMPTS + """ select conv_id, rule_id, case when txt is null or length(prompt) % 4 > 1 then 'check_failed' else 'needs_review' end as status,
case when txt is null then 'section_text_unavailable' when length(prompt) % 4 = 2 then 'bad_response' when length(prompt) % 4 = 3 then 'timeout' else '' end as failure_reason,
case when length(prompt) % 4 = 0 then length(prompt) || ' long' end as explanation, case rule_id when 'order' then null when 'short' then 'result' else 'abstract' end as section from asked where txt is null or length(prompt) % 4 <> 1""")
def semantic_verdicts(spark, sf_dir):
    """Answers read, and what becomes of those that fail."""
    asked = cut(_prompts(spark, sf_dir))
    found = semantic.violations(asked, semantic.ask(asked, _oracle()), _QUESTIONS)
    return found.select(_number("document_id").alias("conv_id"), "rule_id", "status", "failure_reason", "explanation", "section")


@query(f"select distinct sha256('1.0.0|said|Judge {{abstract_text}}!|{_MODEL}|0.0|' || {_PLAIN}) as cache_key from (select text as txt from conversations)")
def cache_key_dedup(spark, sf_dir):
    """Distinct prompts by what their answers depend on."""
    key = semantic.cache_key(_QUESTIONS.by_id("said"), _QUESTIONS, _MODEL, F.col("text"))
    return table(spark, sf_dir, "conversations").select(key.alias("cache_key")).distinct()


# Citations: lines as paragraphs

_CAPTIONED = ("RE", "ON", "AND", "ERTH")


@query(f"""with said as (select doc_id, ord, unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')) as w, generate_subscripts(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), 1) as k
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ord from documents)),
near as (select doc_id, ord, upper(w) as token, lag(w) over o as gap, lag(w, 2) over o as lead from said window o as (partition by doc_id, ord order by k))
select doc_id, token, string_agg(distinct ord::varchar, ',' order by ord::varchar) as lines from near where lower(lead) = 'the' and regexp_matches(gap, '^[ \\t]+$') and token in {_CAPTIONED} group by doc_id, token""")
def citations(spark, sf_dir):
    """Lines that mention a caption's number after a word: one search of each line and an equi-join."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    paragraphs = rows.select(*shaped(schemas.PARAGRAPHS, document_id=F.col("doc_id"), ord=F.col("at") + 1, id=F.col("at") + 1, text=F.col("line"), runs=F.array()))
    named = docs.select("doc_id", F.explode(F.array(*map(F.lit, _CAPTIONED))).alias("token"))
    tables = named.select(*shaped(schemas.ITEMS, document_id=F.col("doc_id"), id=F.col("token"), caption_number=F.col("token")))
    out = captions.citations(tables, paragraphs, "the").where("size(referenced_in_paragraph_ids) > 0")
    return out.select(_number("document_id").alias("doc_id"), F.col("id").alias("token"), F.array_join(F.array_sort("referenced_in_paragraph_ids"), ",").alias("lines"))


# Documents as nested values: orders as documents, line items as paragraphs, returned ones in cells of a table

_SECTIONS = ["introduction", "result", "discussion"]
_NESTED = f"""rows as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as ord, l_returnflag = 'R' as cell, l_quantity as size, l_linestatus = 'O' as bold,
  {_sql_list(CAPTIONS)}[l_quantity::int % {len(CAPTIONS)} + 1] as txt, case when l_returnflag <> 'R' then {_sql_list(_SECTIONS)}[l_linenumber % 3 + 1] end as section from lineitem)"""


def _nested(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(labelled paragraphs, tables): one table for each order with returned items, its first run without a size where that is odd."""
    text = F.element_at(F.array(*map(F.lit, CAPTIONS)), F.col("l_quantity").cast("int") % len(CAPTIONS) + 1)
    cell = F.col("l_returnflag") == "R"
    own = run(text=text, font_size_pt=F.when(F.col("l_quantity") % 2 == 0, F.col("l_quantity")), bold=F.col("l_linestatus") == "O", italic=F.lit(None))
    place = F.when(cell, F.struct((F.col("place") - 1).cast("int").alias("row"), F.lit(0).alias("col")))
    rows = items(spark, sf_dir, "document_id").select(
        *shaped(schemas.PARAGRAPHS, document_id=F.col("document_id"), ord=F.col("place"), id=F.format_string("p%04d", "place"), text=text, style_name=F.lit(""), line_break_after=F.lit(False), in_table=F.when(cell, "t01"), cell=place, runs=F.array(own)),
        *shaped(schemas.LABELS, section=F.when(~cell, F.element_at(F.array(*map(F.lit, _SECTIONS)), F.col("l_linenumber") % 3 + 1))))
    blocks = rows.where("in_table is not null").groupBy("document_id").agg(F.lit("body").alias("container_id"), F.lit(1).alias("sibling_ord"), F.lit("tbl").alias("kind"), F.lit("t01").alias("node_id"), F.lit(False).alias("has_drawing"))
    return rows, captions.tables(blocks, rows)


@query(f"""with {_NESTED} select doc as document_id, section as owner, string_agg(printf('p%04d', ord), ',' order by ord) as ids from rows where section is not null group by doc, section union all
select doc, 't01', string_agg(printf('p%04d', ord), ',' order by ord) from rows where cell group by doc""")
def owned_ids(spark, sf_dir):
    """The paragraphs of each section and of each table."""
    rows, _ = _nested(spark, sf_dir)
    both = trees.section_ids(rows).withColumnRenamed("section", "owner").unionByName(trees.cell_ids(rows).withColumnRenamed("in_table", "owner"))
    return both.select(_number("document_id").alias("document_id"), "owner", F.array_join("ids", ",").alias("ids"))


@query(f"""with {_NESTED}, first as (select doc, arg_min(size, ord) filter (where size % 2 = 0) as size from rows where cell group by doc)
select doc as document_id, 'cell_font_size_pt == ' || coalesce(size::double::varchar, 'None') as found from first where size is null or not size <= 20""")
def table_sizes(spark, sf_dir):
    """A rule on tables that tests the size of their first run that has one."""
    rows, tables = _nested(spark, sf_dir)
    out = compiler.validate(rows, {"tables": tables}, healthy(rows), _rules(_rule("sizes", "table", "cell_font_size_pt", "<=", 20)))
    return out.select(_number("document_id").alias("document_id"), "found")


@query(f"""with {_NESTED}, p as (select *, '{{"id":"' || printf('p%04d', ord) || '","text":"' || txt || '","style_name":"","section":' || coalesce('"' || section || '"', 'null') || ',"runs":[{{"text":"' || txt || '","font_name":null,"font_size_pt":' ||
  case when size % 2 = 0 then size::double::varchar else 'null' end || ',"bold":' || bold::varchar || ',"italic":null,"superscript":false,"uppercase_literal":false,"all_caps_property":false}}],"alignment":null,"is_table_caption":false,"line_break_after":false' ||
  case when cell then ',"in_table":"t01","cell":[' || (ord - 1) || ',0]' else '' end || '}}' as json, case when cell then row_number() over (partition by doc, cell order by ord) end as in_cell, nullif(regexp_extract(txt, '(?i)^ *Table +([IVXLCDM0-9]+)[.:]', 1), '') as n from rows),
words as (select doc, ord, w, lag(w) over x as was from (select doc, ord, unnest(regexp_extract_all(txt, '[A-Za-z0-9]+')) as w, generate_subscripts(regexp_extract_all(txt, '[A-Za-z0-9]+'), 1) as k from rows) window x as (partition by doc, ord order by k)),
capt as (select doc, ord, n from p where in_cell = 1),
said as (select c.doc, string_agg(distinct '"' || printf('p%04d', w.ord) || '"', ',' order by '"' || printf('p%04d', w.ord) || '"') as ids from capt c join words w on w.doc = c.doc and lower(w.was) = 'table' and upper(w.w) = upper(c.n) and w.ord <> c.ord group by c.doc),
tab as (select c.doc, '{{"id":"t01","caption_paragraph_id":' || case when n is null then 'null' else '"' || printf('p%04d', c.ord) || '"' end || ',"caption_position":' || case when n is null then 'null' else '"inside"' end || ',"numbering_style":' || coalesce('"' || {_style('n')} || '"', 'null') ||
  ',"cell_font_size_pt":' || coalesce((select arg_min(size, r.ord) filter (where size % 2 = 0) from rows r where r.doc = c.doc and r.cell)::double::varchar, 'null') || ',"referenced_in_paragraph_ids":[' || coalesce(ids, '') || ']}}' as json from capt c left join said using (doc))
select p.doc as document_id, '{{"paragraphs":[' || string_agg(p.json, ',' order by p.ord) || '],"tables":[' || coalesce(any_value(tab.json), '') || '],"figures":[]}}' as tree from p left join tab on tab.doc = p.doc group by p.doc""")
def document_trees(spark, sf_dir):
    """Each document as one JSON object."""
    rows, tables = _nested(spark, sf_dir)
    none = spark.createDataFrame([], schemas.ITEMS)
    return trees.documents(rows, tables, none).select(_number("document_id").alias("document_id"), "tree")


@query(f"""with {_RUNS}, shown as (select *, '{{"rule_id":"' || rule || '","target_id":"' || target || '","action":"' || action || '","params":' || case attribute when 'font_name' then '{{"font_name":"A"}}' when 'font_size_pt' then '{{"font_size_pt":' || params || '.0}}'
  when 'bold' then '{{"bold":true}}' when 'italic' then '{{"italic":false}}' when 'superscript' then '{{"superscript":true}}' else '{{}}' end || '}}' as json from kept)
select doc as document_id, '{{"ops":[' || string_agg(json, ',' order by seq) || ']}}' as plan, '[' || string_agg('"' || rule || '"', ',' order by seq) filter (where rule <> 'f-suggest') || ']' as audited from shown group by doc""")
def plan_files(spark, sf_dir):
    """The plan of each document as JSON, and the rules of its audit file: both in the order of the plan."""
    paragraphs, _, ops = _planned(spark, sf_dir)
    _, applied = fixes.apply(paragraphs, ops)
    audited = F.to_json(F.from_json("audit", "entries array<struct<rule_id:string>>")["entries"]["rule_id"]).alias("audited")
    return fixes.files(applied, STAMP).select(_number("document_id").alias("document_id"), "plan", audited)
