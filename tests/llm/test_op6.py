import random
import re

import numpy as np
import pyarrow as pa
import pytest

from galley.llm import op6_licenses as op


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_is_the_longest_within_a_wide_band():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 9))], np.uint64) for _ in range(2))
        matched, first, last = op.align(a, b, 0, band=12)
        assert matched == lcs(a.tolist(), b.tolist())
        if matched:
            assert a[first] in b and a[last] in b and last - first + 1 >= matched


def test_winnow_marks_every_window():
    values = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    got = op.winnow(values, 4)
    for i in range(297):
        own = values[i : i + 4]
        assert any(i <= p < i + 4 and values[p] == own.min() for p in got)


def test_finds_whole_edited_and_none(spark, awkward, nothing):
    mit = re.sub(r"\s+", " ", op.TEMPLATES["MIT"])
    w = mit.split()
    edited = " ".join([*w[:30], "indeed", *w[31:60], *w[63:]])
    texts = [f"É intro\n{mit} tail", f"x {edited}", "Licensed under the Apache License, Version 2.0.", " ".join(w[:20]), None, "", "the license of " * 2000, f"{mit} and {mit}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as license", "1 as start")
    rows = op.licenses(docs, ["doc_id"]).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.license) for r in rows] == [(0, "MIT"), (1, "MIT"), (2, "Apache-2.0 statement"), (7, "MIT"), (7, "MIT")]
    assert texts[0][rows[0].start : rows[0].end] == mit[:-1] and rows[0].coverage == 1.0
    assert 0.9 < rows[1].coverage < 1.0 and texts[1][rows[1].start : rows[1].end] == edited[:-1]
    assert op.licenses(awkward, ["doc_id"]).collect() == [] and op.licenses(nothing, ["doc_id"]).collect() == []


def found(texts, templates=op.TEMPLATES):
    """(text, license, span) without Spark, each text a document."""
    out = []
    for batch in op.scanner({k: re.sub(r"\s+", " ", v) for k, v in templates.items()}, ["text"])(iter([pa.RecordBatch.from_pydict({"text": texts})])):
        out += [(r["text"], r["license"], r["text"][r["start"] : r["end"]]) for r in batch.to_pylist()]
    return out


@pytest.mark.parametrize("text", ["Released under the BSD License", "This work is licensed under the GNU General Public License, version 2", "Licensed under CC BY-ND 4.0", "Licensed under CC BY-SA 4.0", "Licensed under CC BY-NC-SA 4.0",
                                  "This work is licensed under a Creative Commons Attribution 3.0 International License", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Released under the MIT-0 License",
                                  "Licensed under the Apache License, Version 1.1", "This work is licensed under the GNU Lesser General Public License, version 3"])
def test_other_licenses_are_not_named(text):
    assert found([text]) == []


def test_versions_and_families_are_told_apart():
    for name in op.TEMPLATES:
        whole = re.sub(r"\s+", " ", op.TEMPLATES[name])
        assert [x[1] for x in found([f"some words {whole} more words"])] == [name]


def test_inserted_runs_are_chained():
    w = re.sub(r"\s+", " ", op.TEMPLATES["MIT"]).split()
    run = [f"extra{i}" for i in range(12)]
    text = " ".join(["intro", *w[:50], *run, *w[50:110], *run, *w[110:], "tail"])
    ((_, name, span),) = found([text])
    assert name == "MIT" and span == text[len("intro ") : -len(". tail")]
    # the two ends of one license far apart are none
    assert found([" ".join([*w[:60], *(["other"] * 400), *w[60:110]])]) == []


def plain(text, templates):
    """Findings by aligning every template with every window of a text, without index, band or chains."""
    words, out = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)], []
    for name, t in templates.items():
        own = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        for i in range(len(words)):
            if words[i][0] == own[0]:
                got = [x[0] for x in words[i : i + len(own)]]
                if got == own:
                    out.append((name, words[i][1], words[i + len(own) - 1][2]))
    # the longest of those that overlap
    return sorted((n, text[a:b]) for n, a, b in out if not any(a < d and c < b and d - c > b - a for _, c, d in out))


def test_whole_texts_equal_plain_search():
    rng = random.Random(9)
    names = list(op.TEMPLATES)
    whole = {k: re.sub(r"\s+", " ", v) for k, v in op.TEMPLATES.items()}
    texts = [" ".join(x for _ in range(rng.randint(0, 3)) for x in (" ".join(f"w{rng.randrange(99)}" for _ in range(30)), whole[rng.choice(names)])) for _ in range(40)]
    for t in texts:
        assert sorted((n, s) for _, n, s in found([t])) == plain(t, whole)


def test_many_templates(spark):
    rng = random.Random(3)
    bank = {f"L{i}": " ".join(f"w{rng.randrange(5000)}" for _ in range(900)) for i in range(300)}
    docs = spark.createDataFrame([(i, f"a b {bank[f'L{i}']} c") for i in range(0, 300, 37)], "doc_id long, text string")
    rows = op.licenses(docs, ["doc_id"], bank).collect()
    assert sorted((r.doc_id, r.license, r.coverage) for r in rows) == [(i, f"L{i}", 1.0) for i in range(0, 300, 37)]


def test_short_templates(spark):
    docs = spark.createDataFrame([(1, "under CC0 only"), (2, "CC 0")], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.end) for r in op.licenses(docs, ["doc_id"], {"a": "CC0"}).collect()] == [(1, 6, 9)]


def test_table_equals_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((r.doc_id, r.license, r.start) for r in op.licenses(docs, ["doc_id"]).collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        for name in op.TEMPLATES:
            if name.endswith("statement"):
                want += [(r.doc_id, name, m.start()) for m in re.finditer(re.escape(op.TEMPLATES[name]), r.text)]
    assert got == sorted(want) and got
