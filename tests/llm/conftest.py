import random

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, blanks, a long text, copies, near copies, a repeated row and columns with clashing names."""
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(pool) for _ in range(120)) for _ in range(6)]
    texts = [None, "", " \n\t ", "one", "one two three", "One TWO three", "Größe naïve été   wide", "x" * 5000]
    for b in base:
        w = b.split()
        texts += [b, b, b.upper(), " ".join(w[:-2] + ["tail", "end"]), " ".join(w[5:]), " ".join([*w[:40], "new", *w[40:90], "other", *w[90:]])]
    texts.append(" ".join(rng.choice(pool) for _ in range(30_000)))
    rows = [(i * 3 + 1, t, "en", f"s{i % 2}", len(t or ""), -1, -1) for i, t in enumerate(texts)]
    rows.append(rows[9])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int, score int")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
