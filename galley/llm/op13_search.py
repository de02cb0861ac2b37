"""Ranked lexical search: variable-block-max WAND over shards of documents.

1. Workers count the words of whole documents and keep those that the items ask for: one row (doc_id, n, terms, counts) a
   document, written as a table. N, L and each term's document frequency are aggregates of it.
2. A task reads these rows in shards of SHARD_POSTINGS postings, wherever rows happen to lie, without a shuffle: each shard is
   an inverted index of its own, its documents in the order of their commonest term and length, so that like impacts lie side
   by side. A posting's part of a score that doesn't depend on the item is its impact. Dynamic
   programming cuts each posting list into blocks: of all ways with at most BLOCK postings a block it takes that with the
   least sum of bound errors (the block's largest impact less each impact) plus PENALTY for each block.
3. An item's bound of a document is the sum, over its terms whose block spans the document, of weight times the block's
   largest impact: WAND's pivot test, made for all places between block ends at once. Documents are scored in rounds, those
   with the highest bounds first; what stays under the item's 20th score so far is skipped, and blocks that span no document
   of the round aren't read. Bounds are never under the score and equal ones aren't skipped, so the result is exact. A task
   carries its 20 best from shard to shard; the best of all tasks are merged by a window.

Items are sent to the workers in shares of MOST_ITEMS items and MOST_BYTES of their text (one longer item is a share of its own);
each share is a search of its own over all documents.

Defined cases: an empty table, or items without terms, give an empty result; a null text has no terms; texts are read
whole, however long. Each row of documents is a document, repeated ones too; a null doc_id counts in N, L and
frequencies but isn't ranked. Rows of items that share an item_id are one item with the terms of its distinct texts; a
null item_id is left out. Equal scores go by doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.scratch import Scratch

#: Documents reported for each item.
BEST = 20
#: Postings in a shard, postings in a block at most, and what a block costs against bound errors (impacts lie under 1,000,000).
SHARD_POSTINGS, BLOCK, PENALTY = 2_000_000, 64, 300_000
#: Items, and bytes of their text, that are sent to the workers at once.
MOST_ITEMS, MOST_BYTES = 10_000, 1_000_000
#: Documents scored in an item's first round; each further round takes 64 times as many.
ROUND = 32

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_ROWS = "doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "item int, doc_id long, score long"
#: An item's terms as (numbers, weights, repeats included).
Query = tuple[np.ndarray, np.ndarray]


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or "").encode().translate(_TABLE).split()


def tallier(numbers: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (doc_id, text) to _ROWS, with the terms asked for."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                own = [(numbers[w], c) for w, c in Counter(words).items() if w in numbers]
                n.append(len(words))
                terms.append([t for t, _ in own])
                counts.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])

    return tally


def weight(documents: int, df: int) -> int:
    """Of a term that df of all documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def ragged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of ranges [start, end), one range after the other."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def block_starts(impacts: np.ndarray, offsets: np.ndarray, longest: int = BLOCK, penalty: int = PENALTY) -> np.ndarray:
    """The first posting of each block of all lists [offsets[i], offsets[i + 1]), ascending.

    cheapest(i) = min over block lengths k of cheapest(i - k) + k * max(impact[i - k + 1 .. i]) + penalty: the sum of impacts
    that bound errors take off is the same for all ways. Place i of all lists that reach it is worked out together.
    """
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    first, sizes = offsets[:-1][order], sizes[order]
    if not len(order):
        return np.empty(0, np.int64)
    top = np.zeros((len(order), longest), np.int64)
    cost = np.full((len(order), longest), 1 << 60, np.int64)
    cost[:, 0] = 0
    lengths = np.arange(1, longest + 1)
    taken = np.empty(len(impacts), np.int32)
    reach = len(order) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right")
    for i, many in enumerate(reach.tolist()):
        own = impacts[first[:many] + i]
        top[:many, 1:] = top[:many, :-1]
        top[:many, 0] = 0
        np.maximum(top[:many], own[:, None], out=top[:many])
        way = top[:many] * lengths
        way += cost[:many]
        best = way.argmin(axis=1)
        taken[first[:many] + i] = best + 1
        cost[:many, 1:] = cost[:many, :-1]
        cost[:many, 0] = way[np.arange(many), best] + penalty
    at, out = first + sizes, []
    while len(at):
        at = at - taken[at - 1]
        out.append(at)
        more = at > first
        at, first = at[more], first[more]
    return np.sort(np.concatenate(out))


class Shard:
    """An inverted index with blocks over some documents."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, vocabulary: int):
        self.ids = ids
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(len(ids)), sizes)[order]
        tf = counts[order].astype(np.int64)
        self.impacts = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.docs])
        offsets = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.starts = block_starts(self.impacts, offsets)
        self.ends = np.r_[self.starts[1:], len(self.docs)] if len(self.starts) else self.starts
        self.top = np.maximum.reduceat(self.impacts, self.starts) if len(self.starts) else self.starts
        self.low, self.high = self.docs[self.starts], self.docs[self.ends - 1] + 1
        self.blocks = np.searchsorted(self.starts, offsets)
        #: Postings read and all postings of the terms asked for, over all searches.
        self.read = self.asked = 0

    def search(self, query: Query, best: tuple[np.ndarray, np.ndarray], most: int = BEST) -> tuple[np.ndarray, np.ndarray]:
        """The best (scores, ids), of those given and this shard's documents, highest first."""
        terms, weights = query
        own = ragged(self.blocks[terms], self.blocks[terms + 1])
        if not len(own):
            return best
        heavy = np.repeat(weights, self.blocks[terms + 1] - self.blocks[terms])
        step = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(step, self.low[own], heavy * self.top[own])
        np.subtract.at(step, self.high[own], heavy * self.top[own])
        bound = np.cumsum(step)[:-1]
        self.asked += int((self.ends[own] - self.starts[own]).sum())
        size, left = ROUND, np.flatnonzero(bound > 0)
        while True:
            left = left[bound[left] >= (best[0][-1] if len(best[0]) == most else 1)]
            if not len(left):
                return best
            now = left
            if len(left) > size:
                front = np.argpartition(-bound[left], size)[:size]
                now, left = left[front], np.delete(left, front)
            else:
                left = left[:0]
            best = merged(best, self.scores(now, own, heavy), self.ids[now], most)
            size *= 64

    def scores(self, now: np.ndarray, own: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """The exact scores of some documents, from the blocks that span any of them."""
        live = np.zeros(len(self.ids), bool)
        live[now] = True
        before = np.r_[0, np.cumsum(live)]
        spans = before[self.high[own]] > before[self.low[own]]
        own, heavy = own[spans], heavy[spans]
        at = ragged(self.starts[own], self.ends[own])
        self.read += len(at)
        heavy = np.repeat(heavy, self.ends[own] - self.starts[own])
        kept = live[self.docs[at]]
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.docs[at[kept]], heavy[kept] * self.impacts[at[kept]])
        return out[now]


def merged(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of two lists of (scores, ids): highest first, then smallest id; none without a score."""
    kept = scores > 0
    scores, ids = np.r_[best[0], scores[kept]], np.r_[best[1], ids[kept]]
    order = np.lexsort((ids, -scores))[:most]
    return scores[order], ids[order]


def shards(batches: Iterator[pa.RecordBatch], documents: int, words: int, vocabulary: int, most: int = SHARD_POSTINGS) -> Iterator[Shard]:
    """The rows of a task as shards; m = 100 - 25 + (25 * n * documents) div words."""

    def shard(held: list[pa.RecordBatch]) -> Shard:
        table = pa.Table.from_batches(held).combine_chunks()
        terms, counts = (table[c].combine_chunks() for c in ("terms", "counts"))
        n, sizes = table["n"].to_numpy(), terms.value_lengths().to_numpy().astype(np.int64)
        terms, counts, ends = terms.flatten().to_numpy(), counts.flatten().to_numpy(), np.cumsum(sizes)
        # the commonest term of each document, the smaller of equals; every document here has a term
        common = terms[np.lexsort((terms, -counts, np.repeat(np.arange(len(n)), sizes)))[ends - sizes]]
        order = np.lexsort((n, common))
        at = ragged((ends - sizes)[order], ends[order])
        return Shard(table["doc_id"].to_numpy()[order], 75 + 25 * n[order] * documents // words, sizes[order], terms[at], counts[at], vocabulary)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("terms").flatten())
        if size >= most:
            yield shard(held)
            held, size = [], 0
    if size:
        yield shard(held)


def searcher(queries: list[Query], documents: int, words: int, vocabulary: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: _ROWS to each item's best documents of a task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = [(none, none)] * len(queries)
        for shard in shards(batches, documents, words, vocabulary):
            best = [shard.search(q, b, most) for q, b in zip(queries, best, strict=True)]
        sizes = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()), pa.array(np.concatenate([i for _, i in best]), pa.int64()), pa.array(np.concatenate([s for s, _ in best]), pa.int64())], ["item", "doc_id", "score"])

    return search


def shares(items: DataFrame, most_items: int, most_bytes: int) -> Iterator[dict[object, Counter]]:
    """The items' terms, a share at a time: item_id to how often each term occurs."""
    share: dict[object, Counter] = {}
    size = 0
    rows = items.select("item_id", "text").where("item_id is not null").distinct().orderBy("item_id", "text")
    for name, text in rows.toLocalIterator():
        n = len((text or "").encode())
        if share and name not in share and (size + n > most_bytes or len(share) >= most_items):
            yield share
            share, size = {}, 0
        share.setdefault(name, Counter()).update(terms_of(text))
        size += n
    yield share


def ranked(docs: DataFrame, items: DataFrame, most: int = BEST, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents (doc_id, text, ...), the items (item_id, text, ...) in shares."""
    scratch = Scratch(docs.sparkSession)
    found = None
    for share in shares(items, most_items, most_bytes):
        own = searched(docs, share, items.schema["item_id"].dataType.simpleString(), most, scratch)
        found = own if found is None else scratch.table(found).union(own)
    return found


def searched(docs: DataFrame, share: dict[object, Counter], kind: str, most: int, scratch: Scratch) -> DataFrame:
    """The result for one share of items."""
    spark = docs.sparkSession
    names = list(share)
    numbers = {t: i for i, t in enumerate(sorted({t for c in share.values() for t in c}))}
    rows = scratch.table(docs.select("doc_id", "text").mapInArrow(tallier(numbers), _ROWS))
    documents, words = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(map(tuple, rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))
    weights = [weight(documents, df.get(i, 0)) for i in range(len(numbers))]
    queries = [(np.array([numbers[t] for t in c], np.int64), np.array([n * weights[numbers[t]] for t, n in c.items()], np.int64)) for c in share.values()]
    named = F.col("doc_id").isNotNull() & (F.size("terms") > 0)
    best = rows.where(named).mapInArrow(searcher(queries, documents, words, len(numbers), most), _FOUND)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= most)
    # as many rows as a share has items
    known = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
    return best.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each test item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL = r"""
with word as (select row_number() over () as d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
stats as (select count(*)::bigint as nn, sum(len(w))::bigint as ll from word where len(w) > 0),
term as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from (select distinct item_id, text from benchmark where item_id is not null)),
ask as (select item_id, t, count(*)::bigint as q from term group by item_id, t),
post as (select d, doc_id, n, t, count(*)::bigint as tf from (select d, doc_id, len(w)::bigint as n, unnest(w) as t from word) group by d, doc_id, n, t),
df as (select t, count(*)::bigint as df from post group by t),
part as (select item_id, d, doc_id, q * floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))) as s
  from ask join df using (t) join post using (t), stats where doc_id is not null),
total as (select item_id, d, doc_id, sum(s)::bigint as score from part group by item_id, d, doc_id having sum(s) > 0)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from total qualify rank <= 20"""

QUERIES = {"op13_search": op13_search}
ORACLES = {"op13_search": _SQL}
