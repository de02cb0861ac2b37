"""Rules that a model answers: prompts, answers by cache key, and what follows from them.

The model is any function over pandas batches of prompts, such as model.client() gives; where there is none, unchecked() says so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType
from pydantic import BaseModel, ConfigDict, ValidationError

from galley.functions import text as T
from galley.functions.batches import few
from galley.operators.answers import Answers, Client, answered
from galley.operators.sections import folded
from galley.plans.compiler import selected
from galley.errors import RulesetError
from galley.plans.ruleset import Ruleset, SemanticRule

#: Reasons for a check that failed.
FAILURES = ("api_key_invalid", "api_key_missing", "quota_exceeded", "service_error", "timeout", "offline", "bad_response", "section_text_unavailable", "semantic_check_not_implemented", "unknown")


class Verdict(BaseModel):
    """An answer."""

    model_config = ConfigDict(extra="ignore", strict=True)
    violation: bool
    explanation: str = ""
    location_hint: str = ""
    suggested_fix: str = ""
    confidence: float = 0.0


def parse_verdict(answer: str | None) -> Verdict | None:
    """An answer from strict JSON, or None."""
    try:
        return Verdict.model_validate(json.loads(answer))
    except (TypeError, ValueError, ValidationError):
        return None


def section_texts(labelled: DataFrame, own: Column) -> DataFrame:
    """(document_id, text, anchor) of the paragraphs for which a test holds, as one text each."""
    rows = labelled.where(own).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "id"))).alias("rows"))
    return rows.select("document_id", F.array_join(F.transform("rows", lambda r: r["text"]), " ").alias("text"), F.col("rows")[0]["id"].alias("anchor"))


def section_order(labelled: DataFrame) -> DataFrame:
    """(document_id, text, anchor): sections in order of appearance, runs of one section once, joined by arrows."""
    own = labelled.where("in_table is null and section is not null")
    turn = own.withColumn("was", F.lag("section").over(Window.partitionBy("document_id").orderBy("ord"))).where("not (section <=> was)")
    rows = turn.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "section", "id"))).alias("rows"))
    return rows.select("document_id", F.array_join(F.transform("rows", lambda r: r["section"]), " -> ").alias("text"), F.col("rows")[0]["id"].alias("anchor"))


def keywords_line(labelled: DataFrame, own: Column) -> DataFrame:
    """(document_id, text, anchor): the first line of keywords among the paragraphs for which a test holds."""
    lines = labelled.where(own & T.is_keywords_line(F.col("text")))
    return lines.groupBy("document_id").agg(F.min_by(F.struct("text", "id"), "ord").alias("r")).select("document_id", "r.text", F.col("r.id").alias("anchor"))


def extract(labelled: DataFrame, rule: SemanticRule) -> DataFrame:
    """The text that a rule asks about: of the paragraphs that its selector gives, or the order of sections."""
    if "section_order" in rule.prompt_vars:
        return section_order(labelled)
    if "keywords_text" in rule.prompt_vars:
        return keywords_line(labelled, selected(rule))
    return section_texts(labelled, selected(rule))


def cache_key(rule: SemanticRule, ruleset: Ruleset, model: str, text: Column) -> Column:
    """SHA-256 of all that an answer depends on; texts count alike up to white space and case."""
    plain = F.regexp_replace(T.strip(folded(text)), f"[{T.WS}]+", " ")
    return F.sha2(F.concat_ws("|", F.lit(ruleset.ruleset_version), F.lit(rule.rule_id), F.lit(rule.prompt_template), F.lit(model), F.lit("0.0"), plain), 256)


def prompts(labelled: DataFrame, ruleset: Ruleset, model: str) -> DataFrame:
    """(document_id, rule_id, rule_seq, anchor, text, prompt, cache_key) of all rules and documents; text is null where there is none."""
    documents = labelled.select("document_id").distinct()
    fields = "document_id string, rule_id string, rule_seq int, anchor string, text string, prompt string, cache_key string"
    out = None
    for seq, rule in enumerate(ruleset.with_presence_rules().ordered()):
        if isinstance(rule, SemanticRule):
            if rule.prompt_template is None:
                raise RulesetError(f"rule {rule.rule_id}: load() reads prompt files, parse() doesn't")
            rows = documents.join(extract(labelled, rule), "document_id", "left").withColumn("text", F.when(T.non_blank(F.col("text")), F.col("text")))
            prompt = T.render(rule.prompt_template, list(rule.prompt_vars), F.col("text"))
            rows = rows.select("document_id", F.lit(rule.rule_id).alias("rule_id"), F.lit(seq).alias("rule_seq"), "anchor", "text", prompt.alias("prompt"), cache_key(rule, ruleset, model, F.col("text")).alias("cache_key"))
            out = rows if out is None else out.unionByName(rows)
    return labelled.sparkSession.createDataFrame([], fields) if out is None else out


def ask(asked: DataFrame, client: Client, kept: Answers | None = None, run: str = "once") -> DataFrame:
    """(cache_key, answer, failure) of distinct prompts, over as many tasks as the cluster runs at once. Where answers are kept,
    those known aren't asked again, and new ones are written under the run's id."""
    prompts = asked.where("text is not null").select("cache_key", "prompt")
    tasks = max(1, asked.sparkSession.sparkContext.defaultParallelism)
    if kept is not None:
        return kept.ask(prompts, client, run, tasks)
    new = prompts.dropDuplicates(["cache_key"]).repartition(tasks)
    return answered(new, client).select("cache_key", "answer", "failure")


def unchecked(documents: DataFrame, ruleset: Ruleset, reason: str = "semantic_check_not_implemented") -> DataFrame:
    """A check that failed for the reason given, for each document and semantic rule: nothing is read or asked."""
    rules = [(seq, r) for seq, r in enumerate(ruleset.with_presence_rules().ordered()) if isinstance(r, SemanticRule)]
    rows = [{"rule_id": r.rule_id, "rule_seq": seq, "severity": r.severity, "message": r.message} for seq, r in rules]
    each = F.from_json(F.lit(json.dumps(rows)), "array<struct<rule_id:string,rule_seq:int,severity:string,message:string>>")
    none = F.lit(None).cast("string")
    return documents.select("document_id").distinct().select("document_id", F.inline(each)).select(
        "document_id", "rule_id", "rule_seq", "severity", none.alias("section"), none.alias("anchor_paragraph_id"), F.lit("check_failed").alias("status"),
        F.lit(reason).alias("failure_reason"), "message", none.alias("explanation"), none.alias("suggested_fix"))


@F.arrow_udf(StructType().add("violation", BooleanType()).add("explanation", StringType()).add("suggested_fix", StringType()))
def _read(answers: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for some in few(answers):
        rows = [(v.violation, v.explanation, v.suggested_fix) if v else (None, None, None) for v in map(parse_verdict, some.to_pylist())]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.bool_(), pa.string(), pa.string()), strict=True)]
        yield pa.StructArray.from_arrays(columns, ["violation", "explanation", "suggested_fix"])


def violations(asked: DataFrame, answers: DataFrame, ruleset: Ruleset) -> DataFrame:
    """A row for each answer that finds a violation (needs_review) and for each check that failed. Spark would read a deterministic
    answer for the filter and again for what is shown, each time by a Python worker of its own."""
    joined = asked.join(answers, "cache_key", "left").withColumn("v", _read.asNondeterministic()("answer"))
    reason = F.when(F.col("text").isNull(), "section_text_unavailable").when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("v.violation").isNull(), "bad_response")
    rules = {r.rule_id: {"severity": r.severity, "message": r.message, "section": r.applies_to_section[0] if r.applies_to_section else None} for r in ruleset.rules if isinstance(r, SemanticRule)}
    told = F.from_json(F.lit(json.dumps(rules)), "map<string,struct<severity:string,message:string,section:string>>")[F.col("rule_id")]
    out = joined.withColumn("failure_reason", reason).where("failure_reason is not null or v.violation").withColumn("rule", told).where("rule is not null")
    status = F.when(F.col("failure_reason").isNotNull(), "check_failed").otherwise("needs_review")
    return out.select("document_id", "rule_id", "rule_seq", "rule.severity", "rule.section", F.col("anchor").alias("anchor_paragraph_id"), status.alias("status"),
                      F.coalesce("failure_reason", F.lit("")).alias("failure_reason"), "rule.message", "v.explanation", "v.suggested_fix")
