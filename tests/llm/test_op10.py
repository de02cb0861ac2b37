import hashlib
import random
from collections import Counter

import pytest

from galley.llm import op10_suffix as op


def brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    n = op.LENGTH
    seen = Counter(t[i : i + n] for _, t in texts for i in range(len(t) - n + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def repeats(spark):
    rng = random.Random(3)
    word = lambda n: " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(n))
    passages = [word(n) for n in (60, 70, 75, 80, 200, 700)]
    texts = [None, "", "short", "z" * 399, "z" * 400, "ab" * 500, passages[4], passages[4], passages[5] * 2]
    for p in passages:
        for _ in range(9):
            texts.append(word(rng.randint(0, 60)) + p + word(rng.randint(0, 60)))
            cut = rng.randint(0, len(p) // 2)
            texts.append(word(20) + p[cut : cut + rng.randint(380, 480)] + word(20))
    w = passages[5].split()
    for _ in range(8):
        near = list(w)
        for _ in range(6):
            near[rng.randrange(len(near))] = "edit"
        texts.append(" ".join(near))
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6]), (None, passages[3]), (None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("group", [op.GROUP, 2])
def test_equals_brute_force(repeats, group):
    rows, docs = repeats
    out = op.without_repeats(docs, group).drop("spans", "repeats")
    assert Counter(map(tuple, out.collect())) == brute(rows)


def test_equals_brute_force_on_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = op.without_repeats(docs).drop("spans", "repeats")
    assert Counter(map(tuple, out.collect())) == brute([tuple(r) for r in docs.collect()])


def test_long_texts_are_cut_into_pieces(repeats, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rows, _ = repeats
    texts = ["".join(t or "" for _, t in rows)]
    whole = next(op._pieces(pa.array(texts)))
    want = op.anchors(whole[3], whole[4])
    monkeypatch.setattr(op, "PIECE", 5000)
    monkeypatch.setattr(op.tb, "SLICE_BYTES", 5000)
    windows = lambda p, f, l, base: {(int(a) + base, i) for a, x, y in zip(p, f, l) for i in range(int(x) + base, int(y) + base + 1)}  # noqa: E731, E741
    got = set()
    for _, _, before, data, offsets in op._pieces(pa.array(texts)):
        got |= windows(*op.anchors(data, offsets)[1:], before)
    assert got == windows(*want[1:], 0)
    assert np.array_equal(np.sort(want[2]), want[2])


def test_awkward(awkward, nothing):
    out = op.without_repeats(awkward).drop("spans", "repeats")
    assert Counter(map(tuple, out.collect())) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert op.without_repeats(nothing).collect() == []


def test_equals_brute_force_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = op.without_repeats(docs).drop("spans", "repeats")
    assert Counter(map(tuple, out.collect())) == brute([tuple(r) for r in docs.collect()])


def shares_words(rows):
    """Documents that have 51 consecutive words of another one."""
    seen = {}
    lists = [(d, (t or "").encode().split()) for d, t in rows]
    for k, (_, w) in enumerate(lists):
        for i in range(len(w) - op.WORDS + 1):
            seen.setdefault(tuple(w[i : i + op.WORDS]), set()).add(k)
    return {lists[k][0] for ks in seen.values() if len(ks) > 1 for k in ks}


def test_passages_of_words_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5))) for _ in range(n))
    passages = [word(n) for n in (40, 50, 51, 52, 60, 75)]
    rows = [(i, word(30) + " " + passages[i % 6] + "\n" + word(40)) for i in range(24)] + [(100, " ".join(["x"] * 300)), (101, word(200)), (102, None), (103, " ".join(["y"] * 60) + " " + word(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = op.without_repeats(docs).select("doc_id", "n_removed", "repeats").collect()
    gone = {r.doc_id for r in found if r.n_removed}
    assert {r.doc_id for r in found if r.repeats} == gone | shares_words(rows) and len(found) == len(rows)
    assert {2, 3, 4} <= shares_words(rows) - gone and not {0, 1} & shares_words(rows)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([[1, 2], [0, 0], [word(500), word(90)]], ["id", "version", "text"])
    want = [b.to_pylist() for b in op._find_words(iter([batch]))]
    monkeypatch.setattr(op, "WORD_PIECE", 70)
    windows = lambda out: {(r["anchor"], r["id"], k) for b in out for r in b for k in range(r["first"], r["last"] + 1)}
    assert windows(want) == windows(b.to_pylist() for b in op._find_words(iter([batch])))


def test_very_long_text(spark):
    rng = random.Random(9)
    text = " ".join(str(rng.random()) for _ in range(130_000))
    rows = [(1, text), (2, "x " + text[-500:])]
    out = op.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans", "repeats")
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in out.collect()} == {(1, len(text), 500, 1), (2, 502, 500, 1)}
