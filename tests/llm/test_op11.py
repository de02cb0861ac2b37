import random
import re
from collections import Counter

import numpy as np

from galley.llm import op11_phrases as op


def brute(rows, least, most):
    pieces = {}
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        pieces.setdefault(lang or "und", []).extend([w for w in re.split("[ \t]", p) if w] for p in re.split("[.,;:!?\n-\r]", low))
    out = []
    for lang, own in pieces.items():
        f = Counter(tuple(w[i : i + k]) for w in own for k in range(1, 6) for i in range(len(w) - k + 1))
        n = sum(map(len, own))
        found = [p for p in f if len(p) > 1 and f[p] >= least]
        inside = {q for p in found for k in range(2, len(p)) for i in range(len(p) - k + 1) if f[q := p[i : i + k]] <= f[p]}
        scored = []
        for p in found:
            if p not in inside:
                s, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:most])]
    return sorted(out)


def texts():
    rng = random.Random(4)
    pool = ["the", "of", "Été", "naïve", "new\x01", "a", "b", "c", "größe"] + [f"r{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = [rng.choice(pool[:9] if rng.random() < 0.6 else pool) for _ in range(rng.randrange(60))]
        rows.append((i, rng.choice(["en", "de", None]), "".join(w + rng.choice([" ", "  ", "\t", " ", ", ", ".\n", "\x0b"]) for w in words)))
    rows += [(500 + i, "en", "New York CITY hall the of the of the of") for i in range(40)]
    return rows + [(900, "en", None), (901, "xx", ""), (902, "yy", " . "), (903, "zz", "once only")]


def test_equals_brute_force(spark, awkward, nothing):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "1 as word", "2 as n", "3 as row", "4 as key").repartition(3)
    own = [(lang, t) for _, lang, t in rows]
    for least, most in ((5, 50), (30, 2000)):
        assert sorted(map(tuple, op.phrases(docs, least, most).collect())) == brute(own, least, most)
    want = brute(own, 5, 2000)
    assert len(want) > 100
    # many ranges; and a dictionary that isn't sent
    assert sorted(map(tuple, op.phrases(docs, 5, range_keys=200).collect())) == want
    assert sorted(map(tuple, op.phrases(docs, 5, range_keys=500, most_words=3).collect())) == want
    assert sorted(map(tuple, op.phrases(awkward, 5).collect())) == brute([(r.lang, r.text) for r in awkward.collect()], 5, 2000)
    assert op.phrases(nothing).collect() == []
    assert op.phrases(docs, 10**6).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 5 * 10**12
    found = spark.createDataFrame([(2, bytearray(b"\x01\x02"), big)], "size int, key binary, a long")
    words = spark.createDataFrame([("en", "x", 2 * big, 1), ("en", "y", 3 * big, 2)], "lang string, word string, f long, id long")
    (row,) = op.ranked(found, words, spark.createDataFrame([("en", 10**17)], "lang string, n long"), 1, 9).collect()
    assert row.score == 1000 * big * 10**17 // (6 * big * big) and row.phrase == "x y"


def test_radix_order_and_run_lengths():
    rng = np.random.default_rng(0)
    for length in (1, 2, 5, 10, 15):
        keys = rng.integers(0, 3, (500, length)).astype(np.uint8)
        names = sorted(k.tobytes() for k in keys)
        assert [k.tobytes() for k in keys[op.radix_order(keys)]] == names
        got, n = op.run_lengths(keys)
        assert dict(zip([k.tobytes() for k in got], n.tolist(), strict=True)) == Counter(names)


def test_numbers_and_keys():
    words = {b"a": 1, b"b": 2, b"c": 300}
    numbers = np.array(op.numbered(b"A b  c\tx a, b", words))
    assert numbers.tolist() == [1, 2, 300, 0, 1, 0, 2]
    assert [k.tobytes().hex() for k in op.keys_of(numbers, 2, 3)] == ["00010002012c", "0002012c0000"]
