from pyspark.sql import functions as F

from galley.operators import trees
from galley.plans import schemas
from galley.plans.tables import shaped


def test_paragraphs_are_not_shuffled_as_json(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "document_id string, ord int, text string")
    labelled = rows.repartition(3, "document_id").select(*shaped(schemas.PARAGRAPHS, document_id=F.col("document_id"), ord=F.col("ord"), id=F.col("text"), text=F.col("text")), *shaped(schemas.LABELS))
    none = spark.createDataFrame([], schemas.ITEMS)
    figures = spark.createDataFrame([("c", 1)], "d string, n int").select(*shaped(schemas.ITEMS, document_id=F.col("d"), ord=F.col("n"), id=F.lit("f01")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = trees.documents(labelled, none, figures)
        got = {r.document_id: r.tree for r in out.collect()}
        plan = out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(got) == {"a", "b", "c"} and got["a"].index('"text":"x"') < got["a"].index('"text":"y"')
    assert got["b"].endswith('],"tables":[],"figures":[]}') and got["c"].startswith('{"paragraphs":[],"tables":[],"figures":[{"id":"f01"')
    assert "Union" not in plan
