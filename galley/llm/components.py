"""Connected components of an edge table that stays in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b); the component is its smallest node.

    Alternates star operations: each node hands its larger, then its smaller, neighbours to the smallest one it knows.
    The edges end as stars around the smallest nodes. A round is two aggregates with partial sums and two joins that
    adaptive execution can split, so a node with very many edges needs no task of its own. Each round's table is
    written to the shared folder, and the one before is deleted.
    """
    now, path = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    path = scratch.path()
    sums = None
    for _ in range(most):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(least, "a")
        small = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", "low")).distinct()
        last, now = path, scratch.table(small)
        path = scratch.path()
        scratch.drop(last)
        was, sums = sums, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.sum(F.hash("b", "a").cast("long"))).first()
        if was == sums:
            break
    else:
        raise RuntimeError(f"no end after {most} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
