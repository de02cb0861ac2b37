import random

import numpy as np
import pyarrow as pa
import pytest

from galley.llm import op7_toxicity as op


def raw(*texts):
    ((_, _, data, at),) = op.tb.slices(pa.array(texts, pa.large_string()), 1 << 40)
    return data, at


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    sound = ["ba", "re", "lo", "ti", "nu", "shé", "mor", "ka", "den", "pli"]
    word = lambda: "".join(rng.choice(sound) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(600):
        sentences = [[word() for _ in range(rng.randint(4, 12))] for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                s = rng.choice(sentences)
                s.insert(rng.randrange(len(s)), rng.choice(["idiot", "worthless", "xquack" + word()]))
        rows.append((i, ". ".join(map(" ".join, sentences)) + ".", int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def model(corpus):
    own = [r for r in corpus if r[0] % 5]
    return op.fit([r[1] for r in own], np.array([r[2] for r in own]))


def test_held_out_accuracy(corpus, model):
    held = [r for r in corpus if r[0] % 5 == 0]
    right = (model.score(*raw(*(r[1] for r in held))) >= 0.5) == np.array([r[2] > 0 for r in held])
    assert right.mean() > 0.95


@pytest.mark.parametrize("insult", ["idiot", "id-iot", "i d i o t", "(IDIOT)", "worth.less", "wxorthless", "xquackbanu"])
def test_gaps_and_insertions(model, insult):
    plain, bad = model.score(*raw("bare loti nu kaden.", f"bare {insult} loti nu. kaden."))
    assert bad >= 0.5 > plain


def test_kernel_is_the_inner_product_of_subsequences():
    from itertools import combinations

    def features(s):
        out = {}
        for c in combinations(range(len(s)), 3):
            if c[2] - c[0] < op.SPAN:
                key = bytes(s[i] for i in c)
                out[key] = out.get(key, 0) + op.DECAY ** (c[2] - c[0] - 2)
        return out

    words = [b"\2idiot\3", b"\2moron\3", b"\2id-iot\3"]
    k = op.Kernel(words[:2])
    ends = np.cumsum([len(w) for w in words])
    got = k.values(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    f = [features(w) for w in words]
    dot = lambda a, b: sum(v * b.get(x, 0) for x, v in a.items())
    want = [[min(dot(a, b) / dot(b, b), 1) ** op.POWER for b in f[:2]] for a in f]
    assert np.allclose(got, want, atol=1e-3)


def test_sentences_and_units():
    u = op.units(*raw("One two. i d i o t\nEnd", "", " .. ", "a b"))
    assert [u.flat[a:b].tobytes() for a, b in zip(u.starts, u.ends)] == [b"\2one\3", b"\2two\3", b"\2idiot\3", b"\2end\3"]
    assert u.text_of.tolist() == [0, 0, 0, 3, 1, 2] and u.sentence.tolist() == [0, 0, 1, 2]


def test_rows(spark, corpus, model, awkward, nothing):
    out = {r.doc_id: r.score for r in model.scored(awkward, ["doc_id"]).collect()}
    assert len({out[d] for d in (1, 4, 7)}) == 1 and all(0 <= s <= 1 for s in out.values())
    assert model.scored(nothing, ["doc_id"]).collect() == []
    docs = spark.createDataFrame([r[:2] for r in corpus], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in corpus] + [(1, 0, None)], "doc_id long, quality int, toxic int")
    fitted = op.ToxicityModel.fitted(docs, labels)
    assert fitted.kernel is not None
    again = op.ToxicityModel.fitted(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(fitted.score(*raw(corpus[0][1])), again.score(*raw(corpus[0][1])))
    assert op.ToxicityModel.fitted(docs, labels.limit(0)).score(*raw("x")).tolist() == [0.5]


def test_measures_of_worst_sentences():
    rng = np.random.default_rng(5)
    text_of = np.r_[rng.permutation(np.repeat(np.arange(6), [1, 2, 3, 4, 9, 1]))]
    margin = np.round(rng.normal(size=len(text_of)) * 3, 1)
    got = op._measures(margin, text_of, 6, -1.5)
    for t in range(6):
        own = sorted(margin[text_of == t].tolist(), reverse=True)
        worst = (own + [-1.5] * op.WORST)[: op.WORST]
        assert got[t].tolist() == [*np.clip(worst, -op.FAR, op.FAR), np.log(len(own)), 1]


def test_query_learns_nothing_from_the_held_out(spark, corpus, tmp_path):
    from zlib import crc32

    held = {r[0] for r in corpus if crc32(str(r[0]).encode()) % 5 == 0}
    spark.createDataFrame([r[:2] for r in corpus], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([r[:2] for r in corpus], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    for name, flip in (("a", 0), ("b", 1)):
        rows = [(i, 1, toxic ^ (flip if i in held else 0)) for i, _, toxic in corpus]
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = {name: {r.doc_id: r for r in op.op7_toxicity(spark, f"{tmp_path}/{name}").collect()} for name in "ab"}
    assert out["a"] == out["b"] and {i for i, r in out["a"].items() if r.held_out} == held
    assert all(r.predicted == int(r.score >= 0.5) for r in out["a"].values())
    assert np.mean([out["a"][i].predicted == toxic for i, _, toxic in corpus if i in held]) > 0.95


def test_only_shared_features_are_summed(monkeypatch):
    marks, words = [b"\2idiot\3", b"\2moron\3"], [b"\2id-iot\3", b"\2moro\3", b"\2\3", b"\2xyz\3", b"\2idiot\3"]
    k, ends = op.Kernel(marks), np.cumsum([len(w) for w in words])
    args = np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends
    whole = k.values(*args)
    assert len(k.worth) < 2 * (k.row >= 0).sum() and (whole[2:4] == 0).all() and whole[4, 0] > 0.999
    monkeypatch.setattr(op, "UNITS", 2)
    assert (k.values(*args) == whole).all() and k.values(args[0][:0], args[1][:0], args[2][:0]).shape == (0, 2)
