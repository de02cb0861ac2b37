"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all trees, exact reranking.

1. Rows with the same vector are one entry with its MOST + 1 smallest ids: no other can be among the MOST nearest, so a vector
   that a third of all rows share costs one entry, and nothing is lost.
2. TREES trees are fitted on a sample of about SAMPLE entries. A node splits at the median along the difference of two random
   entries (the widest spread of TRIES pairs). Vectors get one more component, sqrt(longest^2 - length^2), and queries a 0,
   which makes the largest inner product the nearest direction.
3. Every entry goes down every tree to a leaf. A query goes through one heap of the nodes of all trees, by the largest margin
   it would have to cross, and takes leaves until they hold the budget of entries. The budget is measured: for CHECKED random queries the
   true neighbours are found by a scan of all entries, and the budget is the least that finds RECALL of them. Where that
   takes over PROBES leaves a query, the trees are cut to fewer levels and the budget is measured again: vectors without structure
   need a share of all entries however the leaves are cut, and few large leaves send fewer rows between tasks than many small ones.
4. Entries and queries meet by leaf. A leaf of more than CELL entries or queries is a grid of cells, so that a dense region
   is work for many tasks and is still searched whole. In a cell, a matrix product finds the best up to rounding, and these
   are scored again, component after component in double precision. Windows merge the cells' best.

What is sent to the workers is the forest and its leaf sizes (bounded by SAMPLE) and the vectors of CHECKED queries.

Defined cases: an empty table gives an empty result. Vectors that are null, zero, or hold null or non-finite components,
rows without vec_id, and vectors of another length than the most frequent one (ties: the shorter) take no part. Repeated rows count once; a
vec_id with several vectors has the best score of any two. Equal scores go to the smaller vec_id. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.scratch import Scratch

#: Neighbours of a query, and the divisor of query ids.
MOST, EVERY = 20, 20
#: Trees, entries in a leaf, entries that the trees are fitted on, the fewest of them in a leaf, pairs tried for a split.
TREES, LEAF, SAMPLE, FIT_LEAF, TRIES = 4, 256, 32_768, 8, 4
#: Queries that the budget is measured on, and the share of their true neighbours it has to find.
CHECKED, RECALL = 128, 0.96
#: Leaves that a query takes, about.
PROBES = 32
#: Entries or queries of a cell, and queries multiplied at once.
CELL, STRIPE = 32_768, 64


@dataclass
class Forest:
    """Complete binary trees: node i has the children 2i and 2i + 1, leaves are numbered through all trees."""

    depth: int
    normals: np.ndarray  # trees x nodes x (components + 1), of length 1; node 0 is unused
    cuts: np.ndarray  # trees x nodes
    longest: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Entries with the component that makes all equally long."""
        rest = np.maximum(self.longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0)
        return np.c_[vectors, np.sqrt(rest)]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each entry in each tree."""
        lifted, out = self.lifted(vectors), []
        for tree, (normals, cuts) in enumerate(zip(self.normals, self.cuts, strict=True)):
            node = np.ones(len(vectors), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (np.einsum("ij,ij->i", lifted, normals[node]) > cuts[node])
            out.append(node - (1 << self.depth) + (tree << self.depth))
        return np.stack(out, axis=1)

    def margins(self, queries: np.ndarray) -> np.ndarray:
        """queries x trees x nodes: by how much each lies beyond each cut."""
        return np.tensordot(queries, self.normals[:, :, :-1], ([1], [2])) - self.cuts

    def cut(self, levels: int) -> Forest:
        """The same trees with fewer levels: leaf i becomes part of leaf i >> levels."""
        nodes = 1 << (self.depth - levels)
        return Forest(self.depth - levels, self.normals[:, :nodes], self.cuts[:, :nodes], self.longest)

    def search(self, margins: np.ndarray, sizes: np.ndarray, budget: float) -> list[int]:
        """The leaves that one query visits, until they hold the budget of entries."""
        queue = [(0.0, tree, 1) for tree in range(len(self.cuts))]
        found, held = [], 0
        while queue and held < budget:
            far, tree, node = heapq.heappop(queue)
            while node < 1 << self.depth:
                margin = float(margins[tree, node])
                near = 2 * node + (margin > 0)
                heapq.heappush(queue, (max(far, abs(margin)), tree, near ^ 1))
                node = near
            leaf = node - (1 << self.depth) + (tree << self.depth)
            if sizes[leaf]:
                found.append(leaf)
                held += int(sizes[leaf])
        return found


def fitted(sample: np.ndarray, longest: float, entries: int, trees: int = TREES, leaf: int = LEAF, seed: int = 12) -> Forest:
    """A forest for so many entries from a sample of them."""
    depth = max(0, min(math.ceil(math.log2(max(entries, 1) / leaf)), int(math.log2(max(len(sample), 1) / FIT_LEAF))))
    dim = sample.shape[1] + 1
    forest = Forest(depth, np.zeros((trees, 1 << depth, dim)), np.zeros((trees, 1 << depth)), longest)
    lifted, rng = forest.lifted(sample), np.random.default_rng(seed)
    for tree in range(trees):
        groups = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            own = groups.pop(node)
            spread = -1.0
            for _ in range(TRIES):
                normal = np.subtract(*lifted[rng.choice(own, 2)]) if len(own) > 1 else rng.normal(size=dim)
                length = np.linalg.norm(normal)
                normal = normal / length if length > 0 else np.eye(dim)[0]
                along = lifted[own] @ normal
                if len(along) == 0 or along.std() > spread:
                    spread = along.std() if len(along) else 0.0
                    cut = float(np.median(along)) if len(along) else 0.0
                    forest.normals[tree, node], forest.cuts[tree, node], beyond = normal, cut, along > cut
            groups[2 * node], groups[2 * node + 1] = own[~beyond], own[beyond]
    return forest


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The inner product of each row of both, summed in the order of components."""
    out = np.zeros(len(left))
    for k in range(left.shape[1]):
        out += left[:, k] * right[:, k]
    return out


def best_of(queries: np.ndarray, entries: np.ndarray, ids: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's best ids; entry i has sizes[i] ids, in the order of entries."""
    ends = np.cumsum(sizes)
    lengths = np.sqrt(np.einsum("ij,ij->i", entries, entries))
    out = []
    for at in range(0, len(queries), STRIPE):
        own = queries[at : at + STRIPE]
        near = own @ entries.T
        rank = min(most, len(entries))
        least = np.partition(near, len(entries) - rank, axis=1)[:, len(entries) - rank]
        # twice what two ways of summing can differ by
        slack = 4 * own.shape[1] * np.finfo(float).eps * np.sqrt(np.einsum("ij,ij->i", own, own)) * lengths.max()
        row, col = np.nonzero(near >= (least - slack)[:, None])
        score = exact(own[row], entries[col])
        row, score, many = np.repeat(row, sizes[col]), np.repeat(score, sizes[col]), sizes[col]
        name = ids[np.arange(int(many.sum())) + np.repeat(ends[col] - many - (np.cumsum(many) - many), many)]
        order = np.lexsort((name, -score, row))
        row, name, score = row[order], name[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < most
        out.append((row[kept] + at, name[kept], score[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    fine = F.expr("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.select("vec_id", "embedding").where(F.coalesce(fine, F.lit(False)))
    lengths = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("embedding") == (lengths.size if lengths else 0))


def entries_of(rows: DataFrame, most: int) -> DataFrame:
    """(key, embedding, ids): one row for each different vector, with its smallest ids."""
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.distinct().withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("key"), "embedding", "ids")


def scanner(queries: np.ndarray, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: entries to the best keys of each query, for measuring recall."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, key, score = best_of(queries, matrix(batch.column("embedding")), batch.column("key").to_numpy(), np.ones(batch.num_rows, np.int64), most)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key, pa.int64()), pa.array(score, pa.float64())], ["row", "key", "score"])

    return scan


@dataclass
class Truth:
    """Some queries and their true neighbours."""

    queries: np.ndarray
    owners: list[int]
    vectors: np.ndarray

    def budget(self, forest: Forest, sizes: np.ndarray, recall: float) -> float:
        """The least budget that finds the share `recall` of the neighbours."""
        margins, needed, held = forest.margins(self.queries), [], {}
        for row, own in zip(self.owners, forest.leaves(self.vectors).tolist(), strict=True):
            if row not in held:
                order = forest.search(margins[row], sizes, math.inf)
                held[row] = dict(zip(order, np.cumsum(sizes[order]).tolist(), strict=True))
            needed.append(min(held[row][leaf] for leaf in own))
        return float(np.quantile(needed, recall, method="higher"))


def truth(entries: DataFrame, asked: DataFrame, most: int, checked: int) -> Truth:
    """The true neighbours of `checked` queries, from a scan of all entries."""
    some = asked.orderBy(F.xxhash64("key"), "key").limit(checked).select("key", "embedding").collect()
    queries = np.array([r.embedding for r in some], float)
    near = entries.mapInArrow(scanner(queries, most + 1), "row long, key long, score double")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "key"))
    true = near.withColumn("place", place).where(F.col("place") <= most + 1)
    true = [r for r in true.join(entries.select("key", "embedding"), "key").collect() if r.key != some[r.row].key]
    return Truth(queries, [r.row for r in true], np.array([r.embedding for r in true], float).reshape(len(true), queries.shape[1]))


def leaf_sizes(forest: Forest, frame: DataFrame, column: str) -> np.ndarray:
    """How many rows name each leaf; the frame has arrays of leaves."""
    sizes = np.zeros(len(forest.cuts) << forest.depth, np.int64)
    for leaf, n in frame.select(F.explode(column).alias("leaf")).groupBy("leaf").count().collect():
        sizes[leaf] = n
    return sizes


def neighbours(vectors: DataFrame, most: int = MOST, every: int = EVERY, recall: float = RECALL, leaf: int = LEAF, sample: int = SAMPLE, cell: int = CELL, checked: int = CHECKED, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest found for the rows of (vec_id, embedding, ...) whose id is divisible by `every`."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = valid(vectors)
    entries = scratch.table(entries_of(rows, most + 1))
    queries = scratch.table(rows.where(F.col("vec_id") % every == 0).distinct().join(entries.select("key", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), "key"))
    asked = entries.join(queries.select("key").distinct(), "key", "left_semi").select("key", "embedding")
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, longest = entries.agg(F.count("*"), F.max(F.sqrt(length))).first()
    if not count or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, sample / count)
    some = entries.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("embedding").toArrow()
    forest = fitted(matrix(some["embedding"].combine_chunks()), longest, count, leaf=leaf)

    trees = forest

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaves", pa.array(list(trees.leaves(matrix(b.column("embedding")))), pa.list_(pa.int32())))

    kind = entries.schema["embedding"].dataType.simpleString()
    routed = entries.mapInArrow(route, f"key long, embedding {kind}, ids array<long>, leaves array<int>")
    sizes = leaf_sizes(forest, routed, "leaves")
    true, budget, levels = truth(entries, asked, most, checked), 1.0, 0
    if true.owners:
        budget = true.budget(forest, sizes, recall)
        levels = min(forest.depth, max(0, math.ceil(math.log2(budget * (1 << forest.depth) / count / probes))))
        if levels:
            forest, sizes = forest.cut(levels), sizes.reshape(-1, 1 << levels).sum(axis=1)
            routed = routed.withColumn("leaves", F.transform("leaves", lambda x: F.shiftright(x, levels)))
            budget = true.budget(forest, sizes, recall)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = [forest.search(m, sizes, budget) for at in range(0, b.num_rows, STRIPE) for m in forest.margins(matrix(b.column("embedding").slice(at, STRIPE)))]
                yield b.append_column("leaves", pa.array(found, pa.list_(pa.int32())))

    probes = scratch.table(asked.mapInArrow(probe, f"key long, embedding {kind}, leaves array<int>"))
    visits = leaf_sizes(forest, probes, "leaves")
    # one row a leaf, at most trees x sample / FIT_LEAF
    grid = F.broadcast(spark.createDataFrame([(i, max(1, -(-int(m) // cell)), max(1, -(-int(q) // cell))) for i, (m, q) in enumerate(zip(sizes, visits, strict=True)) if m and q], "leaf int, high int, wide int"))
    mine = routed.withColumn("leaf", F.explode("leaves")).drop("leaves").join(grid, "leaf")
    mine = mine.withColumn("y", F.pmod(F.xxhash64("key"), "high")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).select("leaf", F.col("y").cast("int").alias("y"), "x", "embedding", "ids")
    theirs = probes.withColumn("leaf", F.explode("leaves")).drop("leaves").join(grid, "leaf")
    theirs = theirs.withColumn("x", F.pmod(F.xxhash64("key"), "wide")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("high") - 1))).select("leaf", "y", F.col("x").cast("int").alias("x"), "key", "embedding")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            ids = left["ids"].combine_chunks()
            row, name, score = best_of(matrix(right["embedding"].combine_chunks()), matrix(left["embedding"].combine_chunks()), ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64), most + 1)
            key = right["key"].to_numpy()[row]
        else:
            key, name, score = [], [], []
        return pa.table({"key": pa.array(key, pa.int64()), "vec_id": pa.array(name, pa.int64()), "score": pa.array(score, pa.float64())})

    cells = ("leaf", "y", "x")
    met = mine.groupBy(*cells).cogroup(theirs.groupBy(*cells)).applyInArrow(meet, "key long, vec_id long, score double")
    best = top(met, "key", most + 1)
    out = queries.join(best.drop("rank"), "key").where(F.col("vec_id") != F.col("query_id"))
    return top(out, "query_id", most)


def top(found: DataFrame, owner: str, most: int) -> DataFrame:
    """(owner, rank, vec_id, score): the best of each owner, every id once."""
    once = found.groupBy(owner, "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select(owner, "rank", "vec_id", "score")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_neighbours": op12_neighbours}
#: The search is approximate: tests measure its recall against brute force.
ORACLES: dict[str, str] = {}
