import io
import logging
import os
import time

import pytest
from manuscript import Manuscript
from test_ooxml import as_docx

from galley import cli, errors, logs
from galley.operators.progress import Progress, ahead
from galley.plans.journal import journal
from galley.sources import ooxml

KEY = "AIza" + "x" * 35


def test_errors_have_one_root():
    kinds = [errors.DocumentError, errors.UnsupportedDocumentError, errors.RulesetError, errors.SettingsError]
    assert all(issubclass(k, errors.GalleyError) for k in kinds) and issubclass(errors.UnsupportedDocumentError, errors.DocumentError)
    for bad in (b"", b"no zip", as_docx(Manuscript())[:200]):
        with pytest.raises(errors.UnsupportedDocumentError):
            ooxml.parse(bad)
        assert ooxml.row_of("p", bad)[1] == "p" and ooxml.row_of("p", bad)[3:] == ([], [])


def test_records_lose_secrets():
    out = io.StringIO()
    handler = logging.StreamHandler(out)
    filter_ = logs.SecretFilter()
    handler.addFilter(filter_)
    log = logging.getLogger("test-records")
    log.propagate = False
    log.addHandler(handler)
    for value in ("hunter2hunter2", "hunter2hunter2-long", "short", None):
        filter_.register(value)
    log.warning("a %s b %d %s", KEY, 7, ValueError("hunter2hunter2-long"))
    log.warning("c %(k)s short", {"k": "hunter2hunter2"})
    log.warning(f"d {KEY}")
    try:
        raise RuntimeError(f"key {KEY}")
    except RuntimeError:
        log.exception("e")
    log.removeHandler(handler)
    lines = out.getvalue()
    assert lines.startswith("a <redacted> b 7 <redacted>\nc <redacted> short\nd <redacted>\ne\nTraceback") and KEY not in lines and "hunter2" not in lines


def test_configured_once():
    root, before = logging.getLogger(), list(logging.getLogger().handlers)
    level = root.level
    try:
        one = logs.configure()
        assert logs.configure() is one and len(root.handlers) == len(before) + 1
    finally:
        root.removeHandler(one)
        root.setLevel(level)


def test_fractions():
    assert (ahead(0.2, 0.6, 0, 0), ahead(0.2, 0.6, 1, 4), ahead(0.2, 0.6, 9, 4)) == (0.2, pytest.approx(0.3), 0.6)


def test_progress_counts_tasks(spark):
    heard = []

    def told(stage, fraction):
        heard.append((stage, fraction))
        raise ValueError("a listener that fails")

    def slow(batches):
        for b in batches:
            time.sleep(0.4)
            yield b

    with Progress(spark, told, {"first": 0.0, "second": 0.5}, every=0.05) as progress:
        progress.stage("first")
        progress.stage("second")
        spark.range(8, numPartitions=8).mapInPandas(slow, "id long").count()
    fractions = [f for _, f in heard]
    assert heard[:2] == [("first", 0.0), ("second", 0.5)] and heard[-1] == ("done", 1.0) and fractions == sorted(fractions)
    assert any(0.5 < f < 1.0 for f in fractions) and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_failed_runs_are_not_done(spark):
    heard = []
    with pytest.raises(KeyError), Progress(spark, lambda *x: heard.append(x), {"first": 0.0}) as progress:
        progress.stage("first")
        raise KeyError
    assert heard == [("first", 0.0)]
    with Progress(spark, None, {"first": 0.0}) as quiet:
        quiet.stage("first")


def test_command_line_tells_stages_and_writes_once(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    m = Manuscript()
    (tmp_path / "in" / "a.docx").write_bytes(as_docx(m))
    m.run("title")["font_name"] = "Arial"
    (tmp_path / "in" / "b.docx").write_bytes(as_docx(m))
    heard = []
    code = cli.validate(spark, str(tmp_path / "in"), str(tmp_path / "out"), journal(), False, True, told=lambda *x: heard.append(x))
    kinds = ("annotated.docx", "audit.json", "corrected.docx", "redline.docx", "report.json")
    assert code in {0, 1, 2} and sorted(os.listdir(tmp_path / "out")) == sorted([f"a.{k}" for k in kinds if k != "audit.json"] + [f"b.{k}" for k in kinds])
    begun = list(dict.fromkeys(s for s, _ in heard))
    assert begun == [*cli.STAGES, "done"] and [f for _, f in heard] == sorted(f for _, f in heard)
