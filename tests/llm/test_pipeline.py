import corpus_pipeline as cp
import test_op4
import test_op5
import test_op8
import test_op9

from galley.llm.op1_quality import QualityModel

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, []
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, docs.collect(), out.collect()))
        assert out.columns == names or k == len(cp.STAGES) - 1
        docs = out
    by = {name: ({r.doc_id: r for r in before}, {r.doc_id: r for r in after}) for name, before, after in seen}

    before, after = by["quality"]
    table = spark.createDataFrame(list(before.values()))
    scores = QualityModel.fitted(table, spark.read.parquet(f"{SF}/labels.parquet")).scored(table, ["doc_id"]).collect()
    assert set(after) == {r.doc_id for r in scores if r.score >= 0.3} and 0 < len(after) < len(before)
    before, after = by["near_dedup"]
    groups = test_op4.brute([(r.doc_id, r.text) for r in before.values()])
    assert set(after) == {d for d, (_, _, kept) in groups.items() if kept} and all(after[d] == before[d] for d in after)
    before, after = by["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = test_op8.brute([(r.doc_id, r.text) for r in before.values()], items)
    assert set(after) == {r[0] for r in judged if not r[-1]}
    before, after = by["secrets"]
    assert set(after) == set(before)
    for d, r in after.items():
        assert not test_op5.brute(r.text) and r.n_chars == len(r.text)
        assert (r == before[d]) == (not test_op5.brute(before[d].text))
    before, after = by["tokens"]
    want = test_op9.library([r.text for r in before.values()])
    assert [(after[d].n_tokens, after[d].ids_sha256, after[d].decoded_sha256) for d in before] == want
    assert {r.doc_id for r in cp.run(spark, SF).collect()} == set(after)


def test_awkward_documents_pass_every_stage(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
    kept = [r.doc_id for r in cp.near_dedup(spark, awkward, SF).collect()]
    assert len(kept) < awkward.count() and {1, 4, 7} <= set(kept)


def test_copies_with_repeated_or_null_ids_leave_one(spark):
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(5, text[0], "x"), (5, text[0], "x"), (5, text[1], "y"), (None, text[2], "z"), (None, text[2], "z"), (None, text[1], "w"), (2, text[0], "v"), (None, None, "u"), (None, None, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = cp.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[2], rows[3], rows[6], rows[7], rows[8]], key=str)
