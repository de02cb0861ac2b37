"""From paragraphs and blocks to violations, fixes and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.operators import captions, fixes, reports, sections, semantic
from galley.operators.answers import Answers
from galley.plans.compiler import validate
from galley.plans.ruleset import Ruleset


def cut(frame: DataFrame) -> DataFrame:
    """A frame that later steps read several times, written to the shared folder of checkpoints so that its lineage ends;
    kept in memory where the session names no such folder."""
    return frame.checkpoint() if frame.sparkSession.sparkContext.getCheckpointDir() else frame.cache()


@dataclass
class Validated:
    """Labelled paragraphs, segmentation, items and violations of documents, and the sections chosen by a reader."""

    paragraphs: DataFrame
    segmentation: DataFrame
    items: dict[str, DataFrame]
    violations: DataFrame
    overrides: DataFrame | None = None


def check(paragraphs: DataFrame, blocks: DataFrame, ruleset: Ruleset, overrides: DataFrame | None = None, stage: Callable[[str], None] = lambda name: None) -> Validated:
    """Segment, find captions and evaluate the deterministic rules; stage is told what begins."""
    stage("segmenting")
    labelled, segmentation = sections.segment(paragraphs, ruleset, cut)
    if overrides is not None:
        labelled, segmentation = sections.override(labelled, segmentation, overrides, ruleset)
        labelled = cut(labelled)
    segmentation = cut(segmentation)
    stage("validating")
    items = {"tables": cut(captions.tables(blocks, labelled)), "figures": cut(captions.figures(blocks, labelled))}
    return Validated(labelled, segmentation, items, cut(validate(labelled, items, segmentation, ruleset)), overrides)


def ask(state: Validated, ruleset: Ruleset, client: semantic.Client | None = None, model: str = "none", kept: Answers | None = None, run: str = "once", reason: str = "semantic_check_not_implemented") -> Validated:
    """Add the violations of semantic rules. Without a client each is a check that failed for the reason given."""
    if client is None:
        found = semantic.unchecked(state.segmentation, ruleset, reason)
    else:
        asked = cut(semantic.prompts(state.paragraphs, ruleset, model))
        found = semantic.violations(asked, semantic.ask(asked, client, kept, run), ruleset)
    return replace(state, violations=state.violations.unionByName(found, allowMissingColumns=True))


def fix(state: Validated, ruleset: Ruleset, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paragraphs after the fixes, violations with outcomes, operations applied)."""
    rules = fixes.rule_table(state.violations.sparkSession, ruleset)
    ops, marked = map(cut, fixes.plan(state.violations, rules, strict))
    bare = state.paragraphs.drop("section", "section_confidence", "section_source")
    after, applied = map(cut, fixes.apply(bare, ops))
    return after, fixes.outcomes(marked, applied), applied


def report(state: Validated, violations: DataFrame, ruleset: Ruleset, stamp: str, notes: Sequence[str] = ()) -> DataFrame:
    """Reports as JSON."""
    return reports.reports(violations, state.segmentation, ruleset, stamp, notes, state.overrides).select("document_id", F.col("report"))
