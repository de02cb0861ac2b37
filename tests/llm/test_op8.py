import hashlib
import random
import re

import pytest

from galley.llm import op8_benchmark as op


def brute(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = []
    for name, t in items:
        w = words(t)
        wins += [(name, w[i : i + 13]) for i in range(max(1, len(w) - 12))] if w else []
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for name, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    names |= {str(name)} if name is not None else set()
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_equals_brute_force(spark, awkward, nothing):
    rng = random.Random(5)
    pool = ["Été", "naïve", "x1", "be", "to", "of"] + [f"t{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(n))) for i, n in enumerate([3, 1, 12, 13, 14, 30, 60])]
    items += [(90, None), (91, ""), (92, " .,! "), (93, items[5][1]), (None, items[6][1]), (5, items[5][1])]
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    for k, (_, t) in enumerate(items):
        docs.append((1000 + k, f"Intro-{t or ''}, {(t or '').upper()}!  tail {' '.join(rng.choice(pool) for _ in range(300))}"))
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as n_hit")
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words")
    assert sorted(tuple(r) for r in op.decontaminated(d, b, ["doc_id"]).drop("spans").collect()) == brute(docs, items)
    assert op.decontaminated(nothing, b, ["doc_id"]).collect() == []
    assert op.decontaminated(d, b.limit(0), ["doc_id"]).where("n_hit > 0").count() == 0


def test_spans_point_into_the_original():
    item = " ".join(f"q{i}" for i in range(13))
    text = f"É, {item.replace(' ', ' -- ').upper()}!"
    (out,) = op.scanner([(1, item)], 13, [])(iter([__import__("pyarrow").RecordBatch.from_arrays([[text]], ["text"])]))
    a, b = map(int, out.column("spans")[0].as_py().split(":"))
    assert text[a:b] == text[3:-1]


def test_large_benchmark_is_refused(spark):
    with pytest.raises(ValueError, match="bytes"):
        op.items_of(spark.createDataFrame([(1, "abc")], "item_id long, text string"), 2)


def test_shares_and_passes_equal_one_automaton(spark, awkward):
    rng = random.Random(6)
    pool = ["Été", "naïve"] + [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(n))) for i, n in enumerate([3, 13, 30, 300, 60, 1, 90])] + [(None, "null id " * 9), (3, "again"), (70, None)]
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    docs += [(1000 + k, f"{t} and, {items[3][1].upper()} tail {items[4][1][20:]}") for k, (_, t) in enumerate(items)]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, op.decontaminated(d, b, ["doc_id"]).collect()))
    assert [r[:-1] for r in want] == brute(docs, items)
    for most, at_once in ((400, 10**6), (400, 900), (100, 100), (1, 1)):
        groups = list(op.passes_of(b, op.WINDOW, most, at_once))
        assert sum(map(len, groups)) > 1 and (len(groups) > 1) == (at_once < 10**6)
        if most > 1:
            for keep in (["doc_id"], ["doc_id", "text"]):
                got = op.decontaminated(d, b, keep, most=most, at_once=at_once)
                assert got.columns[: len(keep)] == keep
                assert sorted(map(tuple, got.drop("text").collect())) == want


def test_pieces_have_all_windows():
    text = " ".join(f"w{i}" for i in range(200))
    for most in (1, 80, 300):
        parts = list(op.pieces(text, 13, most))
        assert len(parts) > 1 and set().union(*(op.windows(t) for t, _ in parts)) == op.windows(text)
        assert all(len(t) <= max(most, 13 * 5) for t, _ in parts)
