import hashlib

import pyarrow as pa

from galley.llm import op9_bpe as op


def library(texts):
    t = op.Codec().tokenizer
    ids = [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [(len(x), sha(b"".join(i.to_bytes(4, "little") for i in x)), sha(t.decode(x, skip_special_tokens=False).encode())) for x in ids]


ODD = ["a<|endoftext|>b don't", "<|startoftext|>", "ΑΣ ΟΔΟΣ İstanbul é ́x y", "ﬁ ½ ①x ٣4 \x1c\x85q", "x\x00y\x0b\x0cZ", "日本語 テスト 😀👍🏽", "'s 're WE'LL it's", "z" * 3000]


def test_equals_library(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + list(enumerate(ODD, 5000))
    out = op.encoded(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), ["doc_id"]).collect()
    assert [tuple(r)[:4] for r in out] == [(d, *x) for (d, _), x in zip(rows, library([t for _, t in rows]), strict=True)]
    assert [len(r.token_ids) for r in out] == [r.n_tokens for r in out]
    assert op.encoded(nothing, ["doc_id"]).collect() == []


def test_equals_library_on_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r.text for r in rows]
    out = [x for b in op.coder([], False, None)(iter([pa.RecordBatch.from_arrays([texts], ["text"])])) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert out == library(texts)


def test_long_words_and_texts_equal_library():
    block = 65_536
    texts = ["a" * block + "b" * block, "b" * block + "a" * block, "word " * 900_000 + "end", "x" * 300 + " " + "x" * 301]
    out = [x for b in op.coder([], False, None)(iter([pa.RecordBatch.from_arrays([texts], ["text"])])) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert out == library(texts)


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(op.tb, "hashes", lambda data, starts, ends: (ends - starts).astype("uint64"))
    texts = ["one two six ten", "six three"]
    out = [x for b in op.coder([], False, None)(iter([pa.RecordBatch.from_arrays([texts], ["text"])])) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert out == library(texts)
