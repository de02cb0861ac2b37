"""Sections of documents: headings, front matter, and the labels that body paragraphs inherit, as window functions.

All windows partition by document_id, so one exchange serves them all.
"""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from galley.functions import text as T
from galley.functions.batches import few
from galley.functions.once import once
from galley.plans.ruleset import FRONT_MATTER, Ruleset

#: Score from which a paragraph is a heading, what a vocabulary hit adds, least ratio of a fuzzy one.
HEADING, VOCABULARY, FUZZY = 3, 3, 0.85
#: Headings in the body below which only the front matter is trusted; least score of an affiliation.
LEAST_HEADINGS, AFFILIATION = 4, 2


@F.arrow_udf(StringType())
def folded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NFKC and full case folding, which no built-in function offers."""
    for some in few(texts):
        yield pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in some.to_pylist()], pa.string())


def structural_score(runs: Column, text: Column, style: Column) -> Column:
    """How much a paragraph looks like a heading: style, bold, capitals, few words, no full stop."""
    bold = (F.size(runs) > 0) & F.forall(runs, lambda r: F.coalesce(r["bold"], F.lit(False)))
    parts = [
        (T.matches(style, r"^heading\s*\d*$", True), 3),
        (F.coalesce(bold, F.lit(False)), 2),
        (T.is_upper_literal(text), 2),
        (~F.rlike(text, F.lit(f"^[{T.WS}]*+(?:[^{T.WS}]++[{T.WS}]++){{8}}[^{T.WS}]")), 1),  # at most eight words
        (~F.rlike(text, F.lit(f"\\.[{T.WS}]*+\\z")), 1),
    ]
    return sum((F.when(test, n).otherwise(0) for test, n in parts), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(text, " "), lambda x: x != "")))


#: Spellings whose closest entry a task remembers.
REMEMBERED = 10_000


@once
def vocabulary(synonyms: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(hit by the vocabulary itself, hit by the closest spelling) of headings (norm, structural, known).

    The vocabulary is a literal of the plan: rulesets have tens of entries. No shuffle: a task compares each spelling once.
    """
    exact = _looked_up(F.col("norm"), [(s, sec) for sec, s in synonyms], 1.0)
    sets = _looked_up(F.array_join(token_set(F.col("norm")), " "), [(" ".join(sorted(set(s.split()))), sec) for sec, s in synonyms], 0.95)

    def closest(n: str) -> tuple[str | None, float | None]:
        best = (None, FUZZY - 1e-12)
        matcher = difflib.SequenceMatcher(None, n, "")
        for sec, s in synonyms:
            matcher.set_seq2(s)
            if matcher.real_quick_ratio() > best[1] and matcher.ratio() > best[1] and matcher.ratio() >= FUZZY:
                best = sec, matcher.ratio()
        return best if best[0] else (None, None)

    @F.pandas_udf("section string, confidence double")
    def fuzzy(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str | None, tuple] = {None: (None, None)}
        for norm in batches:
            if len(known) > REMEMBERED:
                known = {None: (None, None)}
            norm = norm.astype(object).where(norm.notna(), None)
            known.update((n, closest(n)) for n in set(norm) - known.keys())
            yield pd.DataFrame([known[n] for n in norm], columns=["section", "confidence"])

    left = F.when(F.col("known").isNull() & (F.col("structural") >= 3) & (F.col("norm") != ""), F.col("norm"))
    return F.coalesce(exact, sets), fuzzy(left)


def vocabulary_match(headings: DataFrame, synonyms: list[tuple[str, str]]) -> DataFrame:
    """Headings (norm, structural, ...) with the section that the vocabulary gives them (hit) and hit_confidence: an exact
    hit, then one of the same words in any order, then for those that look like headings the closest spelling. synonyms:
    (section, text) in order.
    """
    known, fuzzy = vocabulary(tuple(synonyms))
    near = headings.withColumn("known", known).withColumn("near", fuzzy)
    hit = F.coalesce(F.col("known"), F.when(F.col("near.section").isNotNull(), F.col("near")))
    return near.withColumns({"hit": hit["section"], "hit_confidence": hit["confidence"]}).drop("known", "near")


def _looked_up(key: Column, entries: list[tuple[str, str]], confidence: float) -> Column:
    """The section of the first entry with a key, in a map that is a literal of the plan."""
    first = dict(reversed(entries))
    if not first:
        return F.lit(None).cast("struct<section:string,confidence:double>")
    section = F.create_map(*(F.lit(x) for kv in first.items() for x in kv))[key]
    return F.when(section.isNotNull(), F.struct(section.alias("section"), F.lit(confidence).alias("confidence")))


@once
def _looks() -> tuple[Column, Column]:
    """(structural score, text to compare) of paragraphs."""
    return structural_score(F.col("runs"), F.col("text"), F.col("style_name")), T.heading_text(folded("text"))


def headings(paragraphs: DataFrame, synonyms: list[tuple[str, str]]) -> DataFrame:
    """Paragraphs with norm, structural and heading columns (hit section, confidence, is_heading)."""
    structural, norm = _looks()
    scored = paragraphs.withColumns({"structural": structural, "norm": norm})
    found = vocabulary_match(scored, synonyms)
    score = F.col("structural") + F.when(F.col("hit").isNotNull(), VOCABULARY).otherwise(0)
    return found.withColumn("is_heading", T.non_blank(F.col("text")) & (score >= HEADING))


def author_score(runs: Column, text: Column) -> Column:
    few = T.word_count(text).between(1, 20)
    return (
        F.when(F.exists(runs, lambda r: F.coalesce(r["superscript"], F.lit(False))), 2).otherwise(0)
        + F.when(few, 1).otherwise(0)
        + F.when(F.contains(text, F.lit(",")) | F.contains(F.lower(text), F.lit(" and ")), 1).otherwise(0)
    )


def affiliation_score(runs: Column, text: Column) -> Column:
    lead = F.get(runs, F.lit(0))
    marked = F.coalesce(lead["superscript"] & T.matches(T.strip(lead["text"]), r"^\d+$"), F.lit(False))
    return F.when(T.matches(text, r"orcid|e-?mail|@", True), 3).otherwise(0) + F.when(marked, 2).otherwise(0)


def segment(paragraphs: DataFrame, ruleset: Ruleset, hold: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> tuple[DataFrame, DataFrame]:
    """(paragraphs with section, section_confidence and section_source; segmentation of each document). The segmentation is an
    aggregate of the labelled paragraphs: hold() may write these first, so that they are worked out once."""
    synonyms = [(s, _plain(w)) for s, words in ruleset.section_synonyms.items() for w in words]
    marked = headings(paragraphs, synonyms)
    named, marks = _labels()
    for name, column in named.items():
        marked = marked.withColumn(name, column)
    out = hold(marked.select(*paragraphs.columns, *marks, "counted"))
    return out.drop("counted"), summary(out, ruleset)


@once
def _labels() -> tuple[dict[str, Column], list[Column]]:
    """(columns to add in turn to headings, the three columns of labels): front matter by place and looks, then the body, where
    paragraphs inherit the last heading's section."""
    own = Window.partitionBy("document_id")
    named: dict[str, Column] = {}
    body_heading = F.col("is_heading") & F.col("hit").isNotNull() & ~F.col("hit").isin(*FRONT_MATTER) & F.col("in_table").isNull()
    named["body_start"] = F.coalesce(F.min(F.when(body_heading, F.col("ord"))).over(own), F.max("ord").over(own) + 1)
    front = (F.col("ord") < F.col("body_start")) & T.non_blank(F.col("text"))
    named["title_ord"] = F.min(F.when(front, F.col("ord"))).over(own)
    abstract = front & (F.col("ord") > F.col("title_ord")) & F.col("is_heading") & (F.col("hit") == "abstract")
    named["abstract_ord"] = F.min(F.when(abstract, F.col("ord"))).over(own)

    def label(section: str, confidence: Column | float, source: str) -> Column:
        value = F.lit(confidence) if isinstance(confidence, float) else confidence
        return F.struct(F.lit(section).alias("section"), value.cast("double").alias("confidence"), F.lit(source).alias("source"))

    def other(default: Column) -> Column:
        return (
            F.when(T.is_keywords_line(F.col("text")), label("abstract", 0.9, "positional"))
            .when(affiliation_score(F.col("runs"), F.col("text")) >= AFFILIATION, label("affiliation", 0.9, "positional"))
            .otherwise(default)
        )

    by = F.lit(0.5) + F.lit(0.1) * F.least(author_score(F.col("runs"), F.col("text")), F.lit(4))
    in_front = (
        F.when(F.col("ord") == F.col("title_ord"), label("title", 0.7, "positional"))
        .when(F.col("ord") == F.col("abstract_ord"), label("abstract", F.col("hit_confidence"), "heading"))
        .when(F.col("abstract_ord").isNull() | (F.col("ord") < F.col("abstract_ord")), other(label("author", by, "positional")))
        .otherwise(other(label("abstract", 0.6, "positional")))
    )
    head = (F.col("ord") >= F.col("body_start")) & F.col("is_heading") & F.col("hit").isNotNull() & F.col("in_table").isNull()
    so_far = F.last(F.when(head, F.col("hit")), ignorenulls=True).over(own.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    in_body = F.when(head, F.struct(F.col("hit").alias("section"), F.col("hit_confidence").cast("double").alias("confidence"), F.lit("heading").alias("source"))).otherwise(
        F.struct(so_far.alias("section"), F.when(F.col("in_table").isNotNull(), 0.4).otherwise(0.5).cast("double").alias("confidence"), F.lit("inherited").alias("source"))
    )
    named["label"] = F.when(front, in_front).when(F.col("ord") >= F.col("body_start"), in_body)
    named["counted"] = F.when(head, 1).otherwise(0)
    return named, [F.col("label.section").alias("section"), F.coalesce("label.confidence", F.lit(0.0)).alias("section_confidence"), F.coalesce("label.source", F.lit("unknown")).alias("section_source")]


def summary(labelled: DataFrame, ruleset: Ruleset) -> DataFrame:
    """(document_id, detected, missing, body_heading_count, front_matter_only, degraded_reason, first_id)."""
    required = F.array(*map(F.lit, ruleset.required_sections)) if ruleset.required_sections else F.array().cast("array<string>")
    first = F.min_by("id", "ord") if {"id", "ord"} <= set(labelled.columns) else F.lit(None).cast("string")
    out = labelled.groupBy("document_id").agg(F.array_sort(F.collect_set("section")).alias("detected"), F.sum("counted").alias("body_heading_count"), first.alias("first_id"))
    out = out.withColumn("missing", F.array_sort(F.array_except(required, F.col("detected"))))
    few = F.col("body_heading_count") < LEAST_HEADINGS
    reason = F.when(few, F.concat(F.lit("only "), F.col("body_heading_count").cast("string"), F.lit(" body headings found"))).otherwise(F.lit(""))
    return out.select("document_id", "detected", "missing", "body_heading_count", few.alias("front_matter_only"), reason.alias("degraded_reason"), "first_id")


def override(labelled: DataFrame, segmentation: DataFrame, overrides: DataFrame, ruleset: Ruleset) -> tuple[DataFrame, DataFrame]:
    """Labels that a reader has set (document_id, id, section) win; unknown ids are ignored. Detected and missing sections
    follow, the count of headings and what hangs on it don't."""
    given = overrides.select("document_id", "id", F.col("section").alias("given")).dropDuplicates(["document_id", "id"])
    joined = labelled.join(given, ["document_id", "id"], "left")
    new = F.col("given").isNotNull()
    out = joined.select(*(
        {"section": F.coalesce("given", "section"), "section_confidence": F.when(new, 1.0).otherwise(F.col("section_confidence")),
         "section_source": F.when(new, "override").otherwise(F.col("section_source"))}.get(c, F.col(c)).alias(c) for c in labelled.columns
    ))
    again = summary(out.withColumn("counted", F.lit(0)), ruleset).select("document_id", "detected", "missing")
    return out, again.join(segmentation.drop("detected", "missing"), "document_id")


def _plain(word: str) -> str:
    """A synonym as headings are compared."""
    return " ".join(unicodedata.normalize("NFKC", word).casefold().split()).rstrip(":").strip()
