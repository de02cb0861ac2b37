import numpy as np
import pytest

from galley.llm import op12_neighbours as op

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, most=20, every=20):
    """Every fixed rule of the contract, one pair at a time."""
    best = {}
    for q, x in rows:
        if q % every == 0:
            for v, y in rows:
                if v != q:
                    s = 0.0
                    for a, b in zip(x, y, strict=True):
                        s += float(a) * float(b)
                    best[q, v] = max(s, best.get((q, v), -np.inf))
    out = []
    for q in sorted({q for q, _ in best}):
        own = sorted((-s, v) for (p, v), s in best.items() if p == q)[:most]
        out += [(q, k + 1, v, -s) for k, (s, v) in enumerate(own)]
    return out


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)).astype(np.float32) * rng.uniform(0.5, 2, (n, 1)).astype(np.float32)


def test_equals_brute_force_where_all_leaves_are_taken(spark):
    x = vectors(300, 6).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(1000 + i, x[7]) for i in range(90)] + [(-20, x[7]), (40, x[41]), (1000, x[7]), (301, x[301 % 300])]
    odd = [(500, None), (520, []), (None, x[3]), (540, [0.0] * 6), (560, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (580, [float("nan")] * 6), (600, [float("inf"), *x[0][1:]]), (620, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 as score", "2 as rank", "3 as query_id", "4 as key", "5 as ids").repartition(3)
    want = brute(rows)
    for settings in ({}, {"leaf": 16, "sample": 300, "cell": 10}, {"leaf": 16, "sample": 300, "probes": 2}):
        got = op.neighbours(frame, recall=1.0, checked=300, **settings)
        assert sorted(map(tuple, got.collect())) == want
    assert op.neighbours(frame.limit(0)).collect() == []
    assert op.neighbours(frame.where("vec_id % 20 <> 0")).collect() == []
    assert op.neighbours(frame.where("vec_id = 20")).collect() == []


def test_fewer_candidates_than_asked_for(spark):
    rows = [(i, v) for i, v in enumerate(vectors(5, 3).tolist())]
    assert sorted(map(tuple, op.neighbours(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


@pytest.mark.parametrize("kind", ["spread", "clusters"])
def test_recall_and_less_than_all_work(spark, kind):
    x = vectors(4000, 24, 5)
    if kind == "clusters":
        x = (x[np.arange(4000) % 80] + 0.05 * vectors(4000, 24, 6)).astype(np.float32)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SCHEMA)
    got = {}
    for q, _, v, s in op.neighbours(frame, leaf=64, sample=4000).collect():
        got.setdefault(q, set()).add(v)
        assert s == op.exact(x[q : q + 1].astype(float), x[v : v + 1].astype(float))[0]
    full = x.astype(float) @ x.astype(float).T
    hits = 0
    for q in range(0, 4000, 20):
        full[q, q] = -np.inf
        hits += len(got[q] & set(np.argsort(-full[q])[:20].tolist()))
    assert hits >= 0.9 * 200 * 20
    forest = op.fitted(x.astype(float), float(np.linalg.norm(x.astype(float), axis=1).max()), 4000, leaf=64)
    assert forest.depth == 6
    leaves = forest.leaves(x.astype(float))
    sizes = np.bincount(leaves.ravel(), minlength=4 << 6)
    assert sizes.max() < 400 and len(forest.search(forest.margins(x[:1].astype(float))[0], sizes, 500)) < 20


def test_leaves_come_by_their_margin():
    x = vectors(500, 8, 2).astype(float)
    forest = op.fitted(x, float(np.linalg.norm(x, axis=1).max()), 500, trees=3, leaf=32)
    sizes = np.bincount(forest.leaves(x).ravel(), minlength=3 << forest.depth)
    margins = forest.margins(x[:1])[0]

    def far(leaf):
        tree, node, worst = leaf >> forest.depth, 1, 0.0
        for k in range(forest.depth - 1, -1, -1):
            right = (leaf >> k) & 1
            worst = max(worst, 0.0 if right == (margins[tree, node] > 0) else abs(margins[tree, node]))
            node = 2 * node + right
        return worst

    short = forest.cut(2)
    assert (short.leaves(x) == forest.leaves(x) >> 2).all() and short.depth == forest.depth - 2
    order = forest.search(margins, sizes, np.inf)
    assert sorted(order) == np.flatnonzero(sizes).tolist()
    assert [far(x) for x in order] == sorted(far(x) for x in order)
