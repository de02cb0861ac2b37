import json

import pandas as pd

from galley.operators import semantic
from galley.operators.answers import answered
from galley.operators.sections import folded
from galley.plans import ruleset

RULES = ruleset.parse(json.dumps({"ruleset_id": "q", "ruleset_version": "1", "rules": [
    {"rule_id": "r", "check_type": "semantic", "selector": {"node_type": "section_text", "scope": "first"}, "applies_to_section": ["abstract"], "prompt_template": "{x}", "prompt_vars": ["x"], "message": "Ask."}]}))


def test_answers_are_read_once_and_by_one_python_worker_a_task(spark):
    asked = spark.createDataFrame([("d", "r", 0, "p1", "t", "k"), ("e", "r", 0, "p1", "t", "gone"), ("f", "other", 0, "p1", "t", "k")], "document_id string, rule_id string, rule_seq int, anchor string, text string, cache_key string")
    answers = spark.range(1).selectExpr("'k' as cache_key", """'{"violation": true, "explanation": "so", "suggested_fix": "x"}' as answer""", "cast(null as string) as failure")
    found = semantic.violations(asked, answers, RULES)
    rows = sorted((r.document_id, r.severity, r.section, r.status, r.failure_reason, r.message, r.explanation, r.suggested_fix) for r in found.collect())
    assert rows == [("d", RULES.by_id("r").severity, "abstract", "needs_review", "", "Ask.", "so", "x"), ("e", RULES.by_id("r").severity, "abstract", "check_failed", "bad_response", "Ask.", None, None)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("ExistingRDD") == asked._jdf.queryExecution().sparkPlan().toString().count("ExistingRDD")


def test_clients_get_a_few_prompts_at_a_time(spark):
    def client(batches):
        for b in batches:
            yield pd.DataFrame({"cache_key": b["cache_key"], "answer": str(int(b["prompt"].str.len().sum())), "failure": None, "attempts": len(b)})

    prompts = spark.range(0, 5, 1, 1).selectExpr("cast(id as string) as cache_key", "repeat('x', if(id < 3, 3000000, 2)) as prompt")
    out = sorted(tuple(r) for r in answered(prompts, client).collect())
    assert out == [("0", "3000000", None, 1), ("1", "3000000", None, 1), *((k, "3000004", None, 3) for k in "234")]


def test_folded_texts_keep_their_rows(spark):
    texts = spark.range(0, 7, 1, 1).selectExpr("id", "case id when 5 then null when 6 then 'Straße ﬁ' else repeat(concat('Ä', id), 1000000) end as text")
    out = {r.id: r.text for r in texts.select("id", folded("text").alias("text")).collect()}
    assert out[5] is None and out[6] == "strasse fi" and all(out[i] == f"ä{i}" * 1000000 for i in range(5))
