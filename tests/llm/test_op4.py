import re
from collections import defaultdict

import numpy as np
import pytest

from galley.llm import op4_lsh_forest as op


def sets_of(rows):
    out = {}
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows):
    sets, held, root = sets_of(rows), defaultdict(set), {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for doc, s in sets.items():
        find(doc)
        shared = defaultdict(int)
        for x in s:
            for other in held[x]:
                shared[other] += 1
            held[x].add(doc)
        for other, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[other]) - n):
                a, b = sorted((find(doc), find(other)))
                root[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("block", [op.BLOCK_BYTES, 2000])
def test_equals_brute_force(spark, awkward, block):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    out = op.near_duplicates(awkward, block)
    assert out.count() == len(rows)
    assert result(out) == brute(rows)


def test_equals_brute_force_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(op.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table_and_missing_id(spark, nothing):
    assert op.near_duplicates(nothing).collect() == []
    out = op.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string"))
    assert {tuple(r) for r in out.collect()} == {(None, 2, None, True), (1, 2, 1, True)}


def test_large_region_links_all_members():
    n = 3 * op.REGION
    import pyarrow as pa

    def batches():
        for k in range(0, n, 50):
            m = min(50, n - k)
            yield pa.RecordBatch.from_arrays([pa.array([7] * m), pa.array(range(k, k + m)), pa.array([0] * m), pa.array([0] * m)], ["region", "doc_id", "bits1", "bits2"])

    seen = {0}
    links = [(a, b) for x in op._read_regions(batches()) for a, b, r in zip(*(x.column(c).to_pylist() for c in "a b region".split())) if r is None]
    for a, b in sorted(links):
        if a in seen:
            seen.add(b)
    assert seen == set(range(n))


def test_confirmed_prunes_by_size_only():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 60, 100, dtype=np.uint64))
    sets = [base, base[:75], base[:74], base[25:]]
    assert op.confirmed([1, 2, 3, 4], sets, None)
    assert sorted(map(sorted, op.confirmed([1, 2, 3], sets[:3], None))) == [[1, 2], [2, 3]]


def test_sketches_of_trees_differ_and_cut_regions_are_linked_whole():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 32, op._N, dtype=np.uint32).tobytes() for _ in range(2)]
    (out,) = op._plant(iter([pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array([1, 2])], ["signature", "doc_id"])]))
    bits = np.stack([out.column(c).to_numpy() for c in ("bits1", "bits2")], 1)
    assert len({tuple(x) for x in bits[::2].tolist()}) == op.TREES
    # regions 1 and 3 may go on in other parts; far sketches hide links in region 2 only
    part = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2, 3, 3, 3]), pa.array(range(7)), pa.array([0, -1] * 3 + [0]), pa.array([0, -1] * 3 + [0])], ["region", "doc_id", "bits1", "bits2"])
    links = {(a, b) for x in op._read_regions(iter([part])) for a, b, r in zip(*(x.column(c).to_pylist() for c in "a b region".split())) if r is None}
    assert links == {(0, 1), (4, 5), (5, 6)}


def test_long_words_are_told_apart(spark):
    block = 65_536
    rows = [(1, "a" * block + "b" * block), (2, "b" * block + "a" * block), (3, "a" * block + "b" * block), (4, "w " * 1_200_000)]
    out = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in out] == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4)]
