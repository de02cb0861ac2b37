import math
import random
import re
from collections import Counter

import numpy as np

from galley.llm import op13_search as op


def brute(docs, items, most=20):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, words(t)) for d, t in docs]
    n_docs, n_words = sum(1 for _, w in own if w), sum(len(w) for _, w in own)
    df = Counter(t for _, w in own for t in set(w))
    asked = {}
    for name, text in sorted({(i, t) for i, t in items if i is not None}, key=str):
        asked.setdefault(name, []).extend(words(text))
    out = []
    for name, terms in asked.items():
        scores = []
        for d, w in own:
            if d is not None and w:
                m, tf = 100 - 25 + 25 * len(w) * n_docs // n_words, Counter(w)
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms if tf[t])
                if s > 0:
                    scores.append((-s, d))
        out += [(name, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:most])]
    return sorted(out)


def corpus(awkward):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(400)] + ["Été", "naïve", "a_b"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 30, 60])))) for i in range(12)]
    items += [(90, None), (91, ""), (92, "zzz"), (5, items[5][1]), (5, "w1 w1 w2"), (None, "w3")]
    docs = [(r.doc_id, r.text) for r in awkward.collect()] + [(1000 + i, " ".join(rng.choice(pool[:50]) for _ in range(60))) for i in range(80)]
    docs += [(2000 + i, docs[-1][1]) for i in range(30)] + [(None, docs[-1][1]), (2000, docs[-1][1])]
    return docs, items


def test_equals_brute_force(spark, awkward, nothing, monkeypatch):
    docs, items = corpus(awkward)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as score", "3 as item_id").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "2 as doc_id")
    want = brute(docs, items)
    assert sorted(map(tuple, op.ranked(d, b).collect())) == want
    assert sorted(map(tuple, op.ranked(d, b, most_items=5, most_bytes=300).collect())) == want
    assert op.ranked(nothing, b).collect() == []
    assert op.ranked(d, b.limit(0)).collect() == []


def test_shards_and_their_order_change_nothing(awkward):
    docs, items = corpus(awkward)
    docs = [(d, t) for d, t in docs if d is not None]
    import pyarrow as pa

    numbers = {t: i for i, t in enumerate(sorted({t for _, x in items for t in op.terms_of(x)}))}
    (rows,) = op.tallier(numbers)(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs]), "text": pa.array([t for _, t in docs])})]))
    rows = rows.filter(pa.compute.greater(pa.compute.list_value_length(rows["terms"]), 0))
    parts = [rows.slice(i, 9) for i in range(0, rows.num_rows, 9)]
    query = (np.array(sorted(numbers.values())[:40]), np.arange(40) % 7 + 1)
    found = []
    for most in (1, 500, 10**6):
        best = (np.empty(0, np.int64), np.empty(0, np.int64))
        for shard in op.shards(iter(parts), 100, 9000, len(numbers), most):
            best = shard.search(query, best)
        found.append([x.tolist() for x in best])
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 20


def test_blocks_have_the_least_bound_error():
    rng = np.random.default_rng(1)
    lists = [rng.integers(1, 50, n) for n in (0, 1, 7, 12, 5, 0)]
    offsets = np.r_[0, np.cumsum([len(x) for x in lists])]
    got = op.block_starts(np.concatenate(lists), offsets, 4, 20).tolist()

    def cost(x, cuts):
        ends = [*cuts[1:], len(x)]
        return sum((b - a) * max(x[a:b]) - sum(x[a:b]) + 20 for a, b in zip(cuts, ends, strict=True))

    def best(x, at=0):
        if at == len(x):
            return 0
        return min((k * max(x[at : at + k]) - sum(x[at : at + k]) + 20 + best(x, at + k)) for k in range(1, min(4, len(x) - at) + 1))

    for x, a, b in zip(lists, offsets[:-1], offsets[1:], strict=True):
        cuts = [c - a for c in got if a <= c < b]
        if len(x):
            assert cuts[0] == 0 and max(np.diff([*cuts, len(x)])) <= 4 and cost(x.tolist(), cuts) == best(x.tolist())


def test_blocks_are_skipped():
    """A few documents that hold a rare term many times: the rest can't reach the best ones and isn't read."""
    rng = np.random.default_rng(2)
    docs = 20_000
    terms = np.r_[np.zeros(docs, np.int32), np.ones(100, np.int32)]
    who = np.r_[np.arange(docs), np.arange(500, 600)]
    order = np.lexsort((terms, who))
    sizes = np.bincount(who, minlength=docs)
    shard = op.Shard(np.arange(docs), np.full(docs, 100), sizes, terms[order], np.r_[rng.integers(1, 3, docs), np.full(100, 30)][order], 2)
    scores, ids = shard.search((np.array([0, 1]), np.array([1, 9000])), (np.empty(0, np.int64),) * 2)
    assert set(ids) <= set(range(500, 600)) and len(ids) == 20 and shard.read * 20 < shard.asked
