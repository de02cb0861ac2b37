import os

import pytest
from manuscript import Manuscript
from test_ooxml import as_docx, docx
from test_packages import FIXED, row

from galley.sources import ooxml, packages, word


@pytest.fixture(scope="module")
def source(spark):
    word.register(spark)
    return spark


def names(folder):
    return sorted(os.listdir(folder))


def save(frame, folder, mode="append"):
    frame.write.format("word").mode(mode).save(str(folder))


def test_files_as_rows(source, tmp_path):
    a, broken = docx("<w:p><w:r><w:t>a</w:t></w:r></w:p>"), b"no zip"
    for name, data in {"a.docx": a, "b.docx": as_docx(Manuscript()), "same.docx": a, "bad.docx": broken, "other.txt": a, ".hidden.docx": a}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.docx").write_bytes(a)
    rows = source.read.format("word").load(str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: r for r in rows.collect()}
    assert set(found) == {"a.docx", "b.docx", "same.docx", "bad.docx"} and found["bad.docx"].error.startswith("BadZipFile")
    assert [p.text for p in found["a.docx"].paragraphs] == ["a"] and found["a.docx"].document_id == found["same.docx"].document_id
    deep = source.read.format("word").option("recursive", "true").option("pattern", "[ac].docx").option("partitionBytes", 1).load(str(tmp_path))
    assert deep.count() == 2 and deep.rdd.getNumPartitions() == 2
    paragraphs, blocks, errors = ooxml.tables(rows)
    want, _, _ = ooxml.read(ooxml.documents(source, str(tmp_path)))
    assert sorted(map(str, paragraphs.collect())) == sorted(map(str, want.collect())) and errors.count() == 1 and blocks.count() > 1


def test_empty_folder(source, tmp_path):
    assert source.read.format("word").load(str(tmp_path)).count() == 0


def test_files_are_grouped_by_bytes():
    assert word.split([("a", 3), ("b", 3), ("c", 9), ("d", 1), ("e", 5)], 6) == [["a", "b"], ["c"], ["d", "e"]]
    assert word.split([], 6) == []


def test_append_and_overwrite(source, tmp_path):
    out = tmp_path / "out"
    frame = lambda *rows: source.createDataFrame(list(rows), "name string, content binary, more int").repartition(3)
    save(frame(("a.docx", b"1", 0), ("b.docx", b"2", 0), ("empty", None, 0)), out)
    save(frame(("a.docx", b"3", 0)), out)
    assert names(out) == ["a.docx", "b.docx", "empty"] and (out / "a.docx").read_bytes() == b"3" and (out / "empty").read_bytes() == b""
    save(frame(("c.docx", packages.package([row("c")], FIXED), 0)), out, "overwrite")
    assert names(out) == ["c.docx"] and source.read.format("word").load(str(out)).first().paragraphs[0].text == "c"
    save(frame(("z", b"", 0)).limit(0), out)
    assert names(out) == ["c.docx"]


@pytest.mark.parametrize("bad", [[("x", b"1"), ("x", b"2")], [("x", b"1"), ("../y", b"2")], [("x", b"1"), (None, b"2")]])
def test_failures_leave_nothing(source, tmp_path, bad):
    out = tmp_path / "out"
    out.mkdir()
    (out / "kept").write_bytes(b"k")
    with pytest.raises(Exception, match="files of one name|not a name of a file"):
        save(source.createDataFrame([*bad, ("w", b"3")], "name string, content binary").repartition(4), out, "overwrite")
    assert names(out) == ["kept"]


def test_other_columns_are_refused(source, tmp_path):
    with pytest.raises(Exception, match="name and content"):
        save(source.createDataFrame([("x",)], "name string"), tmp_path / "out")


def test_rows_without_runs(source, tmp_path):
    (tmp_path / "a.docx").write_bytes(packages.package([row("a", "b")], FIXED))
    bare = source.read.format("word").option("runs", "false").load(str(tmp_path)).first()
    assert bare.paragraphs[0].text == "ab" and bare.paragraphs[0].runs is None and bare.error is None
