import hashlib
import re
from collections import defaultdict

import pytest

from galley.llm import op2_spotsigs as op


def spots(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    stop = set(op.ANCHORS)
    content = [i for i, w in enumerate(words) if w not in stop]
    out = set()
    for k, i in enumerate(content):
        if i and words[i - 1] in stop:
            chain = [f"{words[i - 1]}_{words[i]}", *(words[j] for j in content[k + 1 : k + op.CHAIN])]
            out.add(hashlib.md5(" ".join(chain).encode()).hexdigest()[: op.DIGITS])
    return sorted(out) or ([hashlib.md5(" ".join(words).encode()).hexdigest()[: op.DIGITS]] if words else [])


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    out = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = spots(t), spots(edited), spots(after)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), jaccard(a, b), jaccard(a, c)))
    return sorted(out, key=str)


SOME = [(None, "The last of the null rows"), (1, "A tale of the two old cities, and the"), (10_000, "the and of"), (10_001, "Die Größe der Straße ist 😀 von Bedeutung"), (10_001, "Another text under the same id")]


@pytest.mark.parametrize("parts", [1, 3, 60])
def test_equals_brute_force(spark, awkward, parts):
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + SOME
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    out = op.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as own", "3 as low"))
    got = sorted(map(tuple, out.collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == brute(rows)


def test_small_tables(spark, nothing):
    assert op.fingerprints(nothing).collect() == []
    (row,) = op.fingerprints(spark.createDataFrame([(5, "The quick brown fox")], "doc_id long, text string")).collect()
    assert row.near_next == 1.0 and tuple(row) == brute([(5, "The quick brown fox")])[0]


def test_alike_equals_brute_force(spark, nothing):
    import random

    rng = random.Random(6)
    base = [[rng.choice(["the", "of", "a", "and", *(f"w{i}" for i in range(60))]) for _ in range(80)] for _ in range(5)]
    rows = []
    for b in base:
        for k in range(12):
            w = list(b)
            for _ in range(k // 2):
                w[rng.randrange(80)] = f"e{rng.randrange(100)}"
            rows.append((len(rows) * 7 % 61, " ".join(w)))
    rows += [(100, rows[0][1]), (101, None), (102, "")]
    sets = {d: spots(t) for d, t in rows}
    root = {d: d for d in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    partners = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= op.ALIKE:
                x, y = sorted((find(a), find(b)))
                root[y] = x
                if sets[a] != sets[b]:
                    partners[a].add("".join(sets[b]))
                    partners[b].add("".join(sets[a]))
    got = {r.doc_id: (r.class_id, r.n_links) for r in op.alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (find(d), len(partners[d])) for d in sets}
    assert op.alike(nothing).collect() == []


def test_plan_is_native(spark, awkward):
    plan = op.fingerprints(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hashpartitioning(bucket") == 1
