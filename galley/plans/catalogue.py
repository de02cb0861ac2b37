"""All queries of the rule engine over the driver's tables, and their DuckDB counterparts.

The tables hold no fonts, so each operator runs over a table of the shape that it needs: documents, conversations or orders
stand for documents; lines, turns or line items for paragraphs or runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.functions import numerals as N
from galley.functions import text as T
from galley.operators.predicates import predicate
from galley.operators.reports import TO_REVIEW
from galley.plans.tables import ORACLES, QUERIES, query, table  # noqa: F401

_LINES = "(select doc_id, lang, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ord from documents)"
_WORDS = r"length(regexp_extract_all(line, '[^ \n\t\r]+'))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as paragraphs: one row for each line, numbered from 1."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("ord", (F.col("at") + 1).cast("bigint")).drop("at")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels, which only some have."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


_LABELLED = "documents left join labels using (doc_id)"


# Sources, traversal, scalar functions


@query(f"select doc_id, printf('p%04d', ord) as paragraph_id, sha256(line) as line_sha256 from {_LINES}")
def explode_paragraphs(spark, sf_dir):
    """Paragraphs with ids."""
    return lines(spark, sf_dir).select("doc_id", F.format_string("p%04d", "ord").alias("paragraph_id"), F.sha2("line", 256).alias("line_sha256"))


@query("select doc_id, sha256(text) as document_id from documents")
def document_fingerprint(spark, sf_dir):
    """The id of a document is the hash of its content."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("document_id"))


@query(f"select doc_id, printf('p%04d', ord) as paragraph_id, {_WORDS}::bigint as words from {_LINES} where {_WORDS} > 25")
def word_count_lte(spark, sf_dir):
    """Paragraphs of over 25 words."""
    kept = lines(spark, sf_dir).where(~predicate("word_count_lte", F.col("line"), 25, "string"))
    return kept.select("doc_id", F.format_string("p%04d", "ord").alias("paragraph_id"), T.word_count(F.col("line")).alias("words"))


@query("select page_id, coalesce(nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), '') as title, length(regexp_extract_all(html, '<p>'))::bigint as n_paragraphs, length(regexp_extract_all(html, '<li>'))::bigint as n_items from pages")
def html_blocks(spark, sf_dir):
    """Titles and counts of blocks of pages."""
    count = lambda tag: F.regexp_count("html", F.lit(tag)).cast("bigint")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), count("<p>").alias("n_paragraphs"), count("<li>").alias("n_items"))


_ROMAN = " ".join(f"when {n} then '{'X' * (n // 10 % 4) if n < 40 else 'XL' if n < 50 else 'L'}{['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10]}'" for n in range(1, 51))


@query(f"select p_partkey, case p_size {_ROMAN} end as roman, p_size::int as back, 'roman' as style from part")
def roman_roundtrip(spark, sf_dir):
    """Sizes as Roman numerals, and read again."""
    roman = N.int_to_roman(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", roman.alias("roman")).select("p_partkey", "roman", N.numeral_value(F.col("roman"), F.lit("roman")).alias("back"), N.numbering_style(F.col("roman")).alias("style"))


_TOKEN = 'token = "[0-9a-f]{40}"'


@query(r"""select doc_id, regexp_replace(text, 'token = "[0-9a-f]{40}"', '<redacted>', 'g') as text from documents where regexp_matches(text, 'token = "[0-9a-f]{40}"')""")
def redact(spark, sf_dir):
    """Registered patterns replaced in texts that have them."""
    docs = table(spark, sf_dir, "documents").where(T.matches(F.col("text"), _TOKEN))
    return docs.select("doc_id", T.redact(F.col("text"), patterns=[_TOKEN]).alias("text"))


@query(r"select doc_id, ord, line, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(line)), '^(\d+|[ivxlcdm]+|[a-z])[.)]\s+', ''), ':+$', ''), '\s+', ' ', 'g')) as norm from " + _LINES)
def heading_norm(spark, sf_dir):
    """Lines as headings are compared."""
    return lines(spark, sf_dir).select("doc_id", "ord", "line", T.heading_text(F.col("line")).alias("norm"))


@query("select conv_id, turn, replace('Judge only this: {text}', '{text}', text) as prompt, length(regexp_extract_all(text, '\\{[A-Za-z_][A-Za-z0-9_]*\\}'))::bigint as n_left from conversations")
def prompt_render(spark, sf_dir):
    """Prompts from a template, and placeholders that are left."""
    prompt = T.render("Judge only this: {text}", ["text"], F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.alias("prompt")).withColumn("n_left", F.size(T.placeholders(F.col("prompt"))).cast("bigint"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp from events")
def utc_stamp(spark, sf_dir):
    """Timestamps as reports show them."""
    return table(spark, sf_dir, "events").select("event_id", T.utc_timestamp(F.col("ts")).alias("stamp"))


# Predicates


@query(f"select doc_id, quality is not distinct from 1 as eq, quality is distinct from 1 as ne from {_LABELLED}")
def eq_ne_null_safe(spark, sf_dir):
    """Equality and its negation, with nulls."""
    q = F.col("quality")
    return labelled(spark, sf_dir).select("doc_id", predicate("==", q, 1, "int").alias("eq"), predicate("!=", q, 1, "int").alias("ne"))


@query(f"select doc_id, coalesce(quality < 1, false) as lt, coalesce(quality <= 0, false) as le, coalesce(quality > 0, false) as gt, coalesce(quality >= 1, false) as ge from {_LABELLED}")
def ordering_ops(spark, sf_dir):
    """Order, with nulls never true."""
    q = F.col("quality")
    tests = {"lt": ("<", 1), "le": ("<=", 0), "gt": (">", 0), "ge": (">=", 1)}
    return labelled(spark, sf_dir).select("doc_id", *(predicate(op, q, v, "int").alias(n) for n, (op, v) in tests.items()))


@query(f"select doc_id, lang in ('en', 'de') as one_of, coalesce(quality not in (0), true) as none_of, contains(source, 'c1') as part_of from {_LABELLED}")
def in_not_in(spark, sf_dir):
    """Membership in lists and in strings."""
    return labelled(spark, sf_dir).select("doc_id", predicate("in", F.col("lang"), ["en", "de"], "string").alias("one_of"), predicate("not_in", F.col("quality"), [0], "int").alias("none_of"), predicate("in", F.col("source"), "c1", "string").alias("part_of"))


@query(r"select doc_id, regexp_matches(text, '\d{3}') as found, not regexp_matches(text, '\d{3}') as missing from documents")
def regex_ops(spark, sf_dir):
    """Patterns found and not found."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", predicate("matches_regex", t, r"\d{3}", "string").alias("found"), predicate("not_matches_regex", t, r"\d{3}", "string").alias("missing"))


@query(f"select doc_id, ord from {_LINES} where line <> '' and not regexp_matches(line, '(?i)license|copyright')")
def exclude_patterns(spark, sf_dir):
    """Lines that no excluded pattern matches, whatever the case."""
    return lines(spark, sf_dir).where((F.col("line") != "") & ~T.matches(F.col("line"), "license|copyright", True)).select("doc_id", "ord")


_CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


@query(f"""select doc_id, ord, line from {_LINES} where regexp_matches(line, '[\\p{{Lu}}\\p{{Lt}}]')
and not regexp_matches(line, '{_CASED}[\\p{{Lu}}\\p{{Lt}}]') and not regexp_matches(line, '(^|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}])\\p{{Ll}}')""")
def title_case(spark, sf_dir):
    """Lines in title case."""
    return lines(spark, sf_dir).where(predicate("is_title_case", F.col("line"), None, "string")).select("doc_id", "ord", "line")


@query("select n_nationkey as key, n_name as name, regexp_matches(n_name, '[A-Za-z]') and upper(n_name) = n_name as is_upper from nation union all select c_custkey, c_name, regexp_matches(c_name, '[A-Za-z]') and upper(c_name) = c_name from customer")
def uppercase_literal(spark, sf_dir):
    """Names written in capitals."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("name"))
    rows = rows.union(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    return rows.withColumn("is_upper", predicate("is_uppercase_literal", F.col("name"), None, "string"))


@query(f"select doc_id, coalesce(quality <> 0, false) as has_quality, lang <> '' as has_lang, coalesce(toxic <> 0, false) as has_toxic from {_LABELLED}")
def non_empty(spark, sf_dir):
    """Values that count as something."""
    return labelled(spark, sf_dir).select("doc_id", predicate("is_non_empty", F.col("quality"), None, "int").alias("has_quality"), predicate("is_non_empty", F.col("lang"), None, "string").alias("has_lang"), predicate("is_non_empty", F.col("toxic"), None, "int").alias("has_toxic"))


# Sections


@query(f"""select doc_id, ord, (case when regexp_matches(line, '[A-Za-z]') and upper(replace(line, 'ß', 'SS')) = line then 2 else 0 end + case when {_WORDS} <= 8 then 1 else 0 end
+ case when not suffix(rtrim(line), '.') then 1 else 0 end)::int as score from {_LINES}""")
def heading_score(spark, sf_dir):
    """How much a line looks like a heading, without formatting."""
    from galley.operators.sections import structural_score

    runs = F.array().cast("array<struct<bold:boolean>>")
    return lines(spark, sf_dir).select("doc_id", "ord", structural_score(runs, F.col("line"), F.lit("")).alias("score"))


@query("""with p as (select p_partkey, lower(trim(p_name)) as norm from part),
k as (select p_partkey, norm, list_sort(list_distinct(string_split(norm, ' '))) as own from p)
select p_partkey, norm, len(own)::int as n_words, list_aggregate(own, 'string_agg', ' ') as word_set from k""")
def vocabulary_sets(spark, sf_dir):
    """Names as sets of words, by which vocabulary is matched in any order."""
    from galley.operators.sections import token_set

    norm = table(spark, sf_dir, "part").select("p_partkey", T.heading_text(F.col("p_name")).alias("norm"))
    return norm.withColumn("own", token_set(F.col("norm"))).select("p_partkey", "norm", F.size("own").alias("n_words"), F.array_join("own", " ").alias("word_set"))


# Fixes


@query("select p_partkey, p_name || case p_size % 3 when 0 then ': a' when 1 then '' else ': b' end as fixed from part")
def apply_strip_colon(spark, sf_dir):
    """A colon at the end removed; others stay, and so do texts that end in none."""
    from galley.operators.fixes import strip_colon

    tail = F.when(F.col("p_size") % 3 == 0, ": a:").when(F.col("p_size") % 3 == 1, ": ").otherwise(": b")
    return table(spark, sf_dir, "part").select("p_partkey", strip_colon(F.concat("p_name", tail)).alias("fixed"))


@query(f"select doc_id, ord, upper(replace(line, 'ß', 'SS')) as fixed from {_LINES}")
def apply_uppercase(spark, sf_dir):
    """Lines in capitals."""
    return lines(spark, sf_dir).select("doc_id", "ord", F.upper("line").alias("fixed"))


# Violations and reports: three rules over documents


_STATUS = "case when toxic = 1 then 'fixed' when toxic = 0 then 'open' when n_chars % 3 = 0 then 'check_failed' else 'conflict' end"
_SEVERITY = "case when n_chars > 3000 then 'high' when n_chars > 1000 then 'medium' else 'low' end"
_VIOLATIONS = f"(select doc_id, source, {_STATUS} as status, {_SEVERITY} as severity from {_LABELLED})"


def _violations(spark, sf_dir) -> DataFrame:
    toxic, size = F.col("toxic"), F.col("n_chars")
    status = F.when(toxic.isNotNull(), F.element_at(F.array(F.lit("open"), F.lit("fixed")), toxic.cast("int") + 1)).otherwise(F.when(size % 3 == 0, "check_failed").otherwise("conflict"))
    worse = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    return labelled(spark, sf_dir).select("doc_id", F.col("source").alias("document_id"), status.alias("status"), F.element_at(worse, 1 + (size > 1000).cast("int") + (size > 3000).cast("int")).alias("severity"))


_REVIEW = ", ".join(f"'{s}'" for s in TO_REVIEW)


@query(f"""select source as document_id, count(*)::bigint as total, count(*) filter (where status = 'fixed')::bigint as auto_fixed, count(*) filter (where status in ({_REVIEW}))::bigint as needs_review,
nullif(count(*) filter (where status = 'check_failed'), 0)::bigint as check_failed from {_VIOLATIONS} group by source""")
def violation_summary(spark, sf_dir):
    """Counts of violations by document."""
    from galley.operators.reports import summary

    return summary(_violations(spark, sf_dir))


@query(f"select source as document_id, max(case when status in ({_REVIEW}) and severity = 'high' then 2 when status in ({_REVIEW}) then 1 else 0 end)::int as exit_code from {_VIOLATIONS} group by source")
def exit_code(spark, sf_dir):
    """Exit codes by document."""
    from galley.operators.reports import exit_code as code

    return code(_violations(spark, sf_dir))


@query(f"""select source as document_id, case max(case when status in ({_REVIEW}) then case severity when 'high' then 3 when 'medium' then 2 else 1 end end) when 3 then 'high' when 2 then 'medium' when 1 then 'low' end as max_open_severity
from {_VIOLATIONS} group by source""")
def max_open_severity(spark, sf_dir):
    """The worst severity still open."""
    from galley.operators.reports import max_open_severity as worst

    return worst(_violations(spark, sf_dir))


@query(r"select url, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]*?)(\.[^./]*)?$', 1) || '.report.json' as report from pages")
def output_names(spark, sf_dir):
    """Names of outputs from paths."""
    from galley.operators.reports import output_names as names

    pages = table(spark, sf_dir, "pages").select("url", F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)).alias("path"))
    return pages.select("url", names(F.col("path"))["report"].alias("report"))


