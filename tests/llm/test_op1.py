import random
import zlib

import numpy as np
import pytest

from galley.llm import op1_quality as op


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    pool = ["the", "river", "was", "old", "and", "Small", "boats", "came", "by", "Night", "of", "stone"]
    rows = []
    for i in range(400):
        w = [rng.choice(pool) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(w) if i % 4 else " ".join(x.upper() + "!!$" for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows[:300]] + [(3, None, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in op.QualityModel.fitted(docs, labels).scored(docs, ["doc_id"]).withColumn("held_out", op.held_out()).collect()}
    assert len(got) == 400 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert np.mean([r.predicted == int(d % 4 > 0) for d, r in got.items() if r.held_out or d >= 300]) > 0.97


def test_vectors_do_not_depend_on_partitions(corpus):
    docs, _ = corpus
    assert np.array_equal(op.word_vectors(docs.coalesce(1)), op.word_vectors(docs.repartition(7)))


def test_awkward(corpus, awkward, nothing):
    _, labels = corpus
    model = op.QualityModel.fitted(awkward, labels.limit(0))
    rows = model.scored(awkward, ["doc_id"]).collect()
    assert len(rows) == awkward.count() and {r.score for r in rows} == {0.5}
    model = op.QualityModel.fitted(corpus[0], labels)
    blank = {r.score for r in model.scored(awkward, ["doc_id"]).collect() if r.doc_id in (1, 4, 7)}
    assert len(blank) == 1
    assert model.scored(nothing, ["doc_id"]).collect() == []


def test_temperature_is_fitted():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    s = op.fit(x, y).score(x)
    for low, high in ((0, 0.3), (0.3, 0.7), (0.7, 1)):
        own = (s >= low) & (s < high)
        assert abs(s[own].mean() - y[own].mean()) < 0.12
