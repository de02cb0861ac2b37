"""Queries of the model client and of kept answers, over the turns of conversations. The service is played by a function of the
prompt that answers, or fails for some attempts or for good, as its length says; SQL knows the same schedule."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.operators import model
from galley.operators.answers import Answers
from galley.plans.tables import query, table
from galley.sources import shared

#: What becomes of prompts by their length modulo ten: how often they fail before they answer, and as what.
SCHEDULE = {1: (1, TimeoutError()), 2: (9, model.ServiceError(429)), 3: (2, model.ServiceError(503)), 4: (9, model.ServiceError(500)), 5: (9, model.ServiceError(400, "", "API_KEY_INVALID")),
            6: (9, ConnectionError()), 7: (9, model.ServiceError(404)), 8: (0, None)}


class Scheduled:
    """A transport that keeps to the schedule. Lengths that end in 8 answer in prose, which is no verdict."""

    def __init__(self):
        self.tried, self.lock = Counter(), threading.Lock()

    def __call__(self, prompt: str, timeout: float) -> str:
        times, error = SCHEDULE.get(len(prompt) % 10, (0, None))
        with self.lock:
            self.tried[prompt] += 1
            turn = self.tried[prompt]
        if turn <= times:
            raise error
        return "I think so." if len(prompt) % 10 == 8 else f'{{"violation": true, "explanation": "{len(prompt)} long"}}'


#: Attempts follow at once: what is shown is how they end.
_AT_ONCE = model.Policy(attempts=3, pause=0.0)
_ENDS = """case length(text) % 10 when 1 then null when 2 then 'quota_exceeded' when 4 then 'service_error' when 5 then 'api_key_invalid' when 6 then 'offline' when 7 then 'service_error' when 8 then 'bad_response' end"""


def _prompts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("role", F.sha2("text", 256).alias("cache_key"), F.col("text").alias("prompt"))


@query(f"""select sha256(text) as cache_key, {_ENDS} as failure, (case when length(text) % 10 in (2, 3, 4, 6) then 3 when length(text) % 10 = 1 then 2 else 1 end)::int as attempts,
case when {_ENDS} is null then length(text) || ' long' end as explanation from (select distinct text from conversations where text is not null)""")
def model_outcomes(spark, sf_dir):
    """How each distinct prompt ends: its answer or the class of its failure, and after how many attempts."""
    prompts = _prompts(spark, sf_dir).where("prompt is not null").dropDuplicates(["cache_key"])
    out = model.outcomes(prompts, Scheduled, _AT_ONCE)
    return out.select("cache_key", "failure", "attempts", F.get_json_object("answer", "$.explanation").alias("explanation"))


@query(f"""with texts as (select distinct text, role from conversations where text is not null), ends as (select distinct text, {_ENDS} is null as told from texts),
first as (select distinct text from texts where role = 'user')
select 'a' as run, sha256(text) as cache_key, told from first join ends using (text) union all
select 'b', sha256(text), told from ends where not (told and text in (select text from first)) union all
select 'c', sha256(text), told from ends where not told""")
def answers_kept(spark, sf_dir):
    """What three runs ask: the turns of users, all turns, all again. Answers of earlier runs aren't asked for, failures are."""
    kept = Answers(spark, shared.new_folder(spark, "answers"))
    prompts = _prompts(spark, sf_dir).where("prompt is not null")
    client = model.client(Scheduled, _AT_ONCE)
    tasks = spark.sparkContext.defaultParallelism
    for run, own in (("a", prompts.where("role = 'user'")), ("b", prompts), ("c", prompts)):
        kept.ask(own, client, run, tasks)
    rows = None
    for run in kept.runs():
        own = kept.read(run).select(F.lit(run).alias("run"), "cache_key", F.col("failure").isNull().alias("told"))
        rows = own if rows is None else rows.unionByName(own)
    return rows
