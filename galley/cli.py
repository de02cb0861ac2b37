"""Command line: validate Word files and write corrected files and reports."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley import logs
from galley.errors import GalleyError
from galley.operators import fixes, model, reports
from galley.operators.answers import Answers
from galley.operators.progress import Progress, Told
from galley.plans import journal, manuscripts, ruleset
from galley.sources import files, ooxml, revisions, word, writeback


@dataclass(frozen=True)
class Service:
    """A language model behind a service; answers may be kept in a folder that all executors reach."""

    url: str | None = None
    key: str | None = None
    model: str = "default"
    answers: str | None = None


def judged(state: manuscripts.Validated, rules: ruleset.Ruleset, semantic: bool, service: Service, run: str) -> manuscripts.Validated:
    """Semantic rules: by the service, or failed because they are switched off or have no key."""
    if not semantic:
        return manuscripts.ask(state, rules)
    if not service.url or not service.key:
        return manuscripts.ask(state, rules, reason="api_key_missing")
    kept = Answers(state.segmentation.sparkSession, service.answers) if service.answers else None
    return manuscripts.ask(state, rules, model.client(partial(model.HttpTransport, service.url, service.key, service.model)), service.model, kept, run)


#: Stages of a run and the share of it that is done when each begins.
STAGES = {"reading": 0.0, "parsing": 0.1, "segmenting": 0.2, "validating": 0.3, "asking": 0.4, "planning fixes": 0.5, "writing": 0.6}


def validate(spark: SparkSession, source: str, out: str, rules: ruleset.Ruleset, semantic: bool, fix: bool, service: Service = Service(), told: Told | None = None) -> int:
    """Check all files at a path and write the five outputs of each; returns the exit code: 0 nothing open, 1 something, 2 of
    high severity, 3 if a file could not be read. Such files are listed in errors.json, all others are checked. All outputs are
    one write, seen when it is complete. told hears of stages and of what is done of them."""
    word.register(spark)
    with Progress(spark, told, STAGES) as progress:
        return _validated(spark, source, out, rules, semantic, fix, service, progress)


def _validated(spark: SparkSession, source: str, out: str, rules: ruleset.Ruleset, semantic: bool, fix: bool, service: Service, progress: Progress) -> int:
    progress.stage("reading")
    docs = manuscripts.cut(ooxml.documents(spark, source).dropDuplicates(["document_id"]))
    progress.stage("parsing")
    paragraphs, blocks, errors = map(manuscripts.cut, ooxml.read(docs))
    listed = F.concat(F.lit('{"errors":['), F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("path", "error")))), ","), F.lit("]}"))
    unreadable = not errors.isEmpty()
    outputs = []
    if unreadable:
        outputs.append(errors.agg(listed.cast("binary").alias("content")).select(F.lit("errors.json").alias("name"), "content"))
        docs = docs.join(errors.select("document_id"), "document_id", "left_anti")
    if docs.isEmpty():
        _write(outputs, out)
        return 3
    state = manuscripts.check(paragraphs, blocks, rules, stage=progress.stage)
    stamp = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    progress.stage("asking")
    state = judged(state, rules, semantic, service, stamp.replace(":", ""))
    progress.stage("planning fixes")
    after, outcome, applied = manuscripts.fix(state, rules) if fix else (paragraphs, state.violations, None)
    progress.stage("writing")
    names = files.unique_names(docs.select("document_id", reports.stem(F.col("path")).alias("name")))

    def add(kind: str, frame: DataFrame, content: str = "content") -> None:
        named = frame.join(names, "document_id").select(F.concat("name", F.lit(reports.OUTPUTS[kind])).alias("name"), F.col(content).cast("binary").alias("content"))
        outputs.append(named)

    add("report", manuscripts.report(state, outcome, rules, stamp), "report")
    if applied is not None:
        changed = manuscripts.cut(writeback.changes(paragraphs, after))
        add("audit", fixes.audit_files(fixes.audit(applied, stamp)), "audit")
        add("corrected", writeback.patched(docs, changed))
        add("redline", revisions.redlined(docs, changed, stamp))
    add("annotated", revisions.annotated(docs, reports.comments(outcome), stamp))
    _write(outputs, out)
    worst = reports.exit_code(outcome).agg(F.max("exit_code")).first()[0]
    return 3 if unreadable else int(worst or 0)


def _write(outputs: list[DataFrame], folder: str) -> None:
    if outputs:
        reduce(DataFrame.unionByName, outputs).write.format("word").mode("append").save(folder)


def shown(stage: str, fraction: float) -> None:
    print(f"{fraction:4.0%} {stage}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="galley")
    commands = parser.add_subparsers(dest="command")
    v = commands.add_parser("validate")
    v.add_argument("source")
    v.add_argument("-o", "--output", required=True)
    v.add_argument("--no-semantic", action="store_true")
    v.add_argument("--no-fix", action="store_true")
    v.add_argument("--ruleset")
    v.add_argument("--model-url", help="service that answers prompts; its key is read from GALLEY_API_KEY")
    v.add_argument("--model", default="default")
    v.add_argument("--answers", help="shared folder of answers kept between runs")
    v.add_argument("--progress", action="store_true", help="tell stages and the share that is done on standard error")
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_usage(sys.stderr)
        return 2
    key = os.environ.get("GALLEY_API_KEY")
    logs.secrets.register(key)
    logs.configure(logging.WARNING)
    try:
        rules = ruleset.load(args.ruleset) if args.ruleset else journal.bundled()
        spark = SparkSession.builder.appName("galley").getOrCreate()
        service = Service(args.model_url, key, args.model, args.answers)
        return validate(spark, args.source, args.output, rules, not args.no_semantic, not args.no_fix, service, shown if args.progress else None)
    except GalleyError as e:
        print(logs.secrets.clean(str(e)), file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
