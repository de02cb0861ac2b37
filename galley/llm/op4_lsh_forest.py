"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

1. Each text's set of distinct five-word shingles gets a MinHash signature. Documents with equal sets become one
   representative, whatever their number.
2. The forest holds each representative once per tree, under a key made of DEPTH signature values of that tree and a
   continuation of further values. One range sort puts all trees in order, so equal keys are neighbours. A
   region that shares DEPTH values and is small is compared by sketch; a larger one is taken together in that deeper
   order. Either way a region gives a spanning set of candidate links, fewer than it has members, never all its pairs.
3. Connected candidates form a neighbourhood. Whole sets meet there, each in one task if they fit BLOCK_BYTES, else
   block by block for every pair of blocks; links are those that the sets themselves confirm. No link is lost that way
   within a neighbourhood, and none is assumed.
4. Confirmed links give components, whose smallest doc_id is kept.

Misses: two sets with a Jaccard likeness of 0.75 share no tree with probability (1 - 0.75^4)^32, about 5 in a million. A tree
that they share may hide them in a small region, but sketches take other bits in each tree, and that all shared trees hide
them adds 0.6 in a million (with ideal hashes). Regions that may go on in another part are linked whole.

The prefix depth is fixed at DEPTH: deeper regions would lose pairs that the figure above counts, and large regions need no
splitting as they are linked whole. The continuation only orders the rows of a region; no common prefixes are measured.

Defined cases: an empty table gives an empty one, and texts are read whole, however
long; null, empty or blank text: an empty set, linked with nothing. Null doc_id: the row has no component and
is kept. Rows that repeat a doc_id are one node. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import textbytes as tb
from galley.llm.components import components
from galley.llm.scratch import Scratch

#: Words in a shingle, and the least likeness of a link in hundredths.
SHINGLE, LIKENESS = 5, 75
TREES, DEPTH = 32, 4
#: Regions up to this size are compared pair by pair in sketches; sketches that differ in more bits than FAR don't link.
REGION, FAR = 64, 32
#: Bytes of shingle sets that meet in one task.
BLOCK_BYTES = 24 << 20

_N = TREES * DEPTH
_random = np.random.default_rng(20240607)
_MULTIPLY = _random.integers(1, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, _N, dtype=np.uint64)
_PLACE = _random.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = tb.table_of(set(range(256)) - {0x20, *range(0x09, 0x0E)})
_FOLD = tb.folding()


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in turn, set size of each text)."""
    data = _FOLD[data]
    starts, ends, at = tb.words(data, offsets, _WORD)
    word = tb.hashes(data, starts, ends)
    n = np.diff(at)
    full = np.maximum(n - SHINGLE + 1, 0)
    if len(word) >= SHINGLE:
        last = len(word) - SHINGLE + 1
        shingle = sum(word[j : j + last] * _PLACE[j] for j in range(SHINGLE))
        first = np.repeat(at[:-1] - (np.cumsum(full) - full), full)
        shingle = tb.mix(shingle[np.arange(len(first)) + first])
    else:
        shingle = word[:0]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = np.array([(word[at[i] : at[i + 1]] * _PLACE[: n[i]]).sum(dtype=np.uint64) for i in short], np.uint64)
        whole += _PLACE[-1] * n[short].astype(np.uint64)
        ends_of = np.cumsum(full)
        shingle = np.insert(shingle, ends_of[short], tb.mix(whole))
        full[short] = 1
    return tb.unique_rows(shingle, full)


def signatures(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of MinHash values (uint32) for each set; sets are not empty."""
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), _N), np.uint32)
    for j in range(_N):
        out[:, j] = np.minimum.reduceat((values * _MULTIPLY[j] + _ADD[j]) >> np.uint64(32), first)
    return out


def _sum_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in tb.slices(batch.column("text")):
            values, sizes = shingle_sets(data, offsets)
            full = np.flatnonzero(sizes)
            rows = np.full(len(sizes), None, object)
            if len(full):
                for k, row in zip(full.tolist(), signatures(values, sizes[full]), strict=True):
                    rows[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(sizes), pa.array(_sum_by(values, sizes).view(np.int64)), pa.array(_sum_by(tb.mix(values), sizes).view(np.int64)), pa.array(rows, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "signature"])


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per representative and tree."""
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            n = len(part)
            s = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(n, _N).astype(np.uint64)
            mixed, bits = tb.mix(s), []
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)
            region, deeper = [], []
            for t in range(TREES):
                bits.append(np.packbits((mixed >> np.uint64(t) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64).reshape(n, 2))  # other bits in each tree
                own = [s[:, (t * DEPTH + j) % _N] for j in range(2 * DEPTH)]
                region.append(tb.mix(sum(v * np.uint64(p) for v, p in zip(own[:DEPTH], _PLACE, strict=False)) + np.uint64(t)))
                deeper.append(sum((v >> np.uint64(16)) << np.uint64(48 - 16 * j) for j, v in enumerate(own[DEPTH:])))
            bits = np.concatenate(bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(region).view(np.int64)), pa.array(np.concatenate(deeper).view(np.int64)), pa.array(np.tile(doc, TREES)), pa.array(bits[:, 0]), pa.array(bits[:, 1])], ["region", "deeper", "doc_id", "bits1", "bits2"])


def _span(doc: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """Links that span what sketches hold together in a small region."""
    near = np.bitwise_count(bits[:, None, :] ^ bits[None, :, :]).sum(2, dtype=np.int64) <= FAR
    left, links = set(range(len(doc))), []
    while left:
        front = [left.pop()]
        while front:
            i = front.pop()
            new = [j for j in np.flatnonzero(near[i]).tolist() if j in left]
            left.difference_update(new)
            front += new
            links += [(int(doc[i]), int(doc[j])) for j in new]
    return links


def _read_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within regions of a sorted part, and the rows at both ends, whose regions may go on in other parts."""
    held: tuple | None = None
    ends: list[tuple[int, int]] = []

    def out(a, b, region):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(region, pa.int64())], ["a", "b", "region"])

    def whole(region, doc, bits, edge):
        """Links of regions; one with the edge's key may go on in another part and is linked whole, whatever its size."""
        first = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        size = np.diff(np.r_[first, len(region)])
        two = first[size == 2]
        two = two[region[two] != edge]
        near = two[np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1, dtype=np.int64) <= FAR]
        links = list(zip(doc[near].tolist(), doc[near + 1].tolist(), strict=True))
        cut = first[(size == 2) & (region[first] == edge)]
        links += zip(doc[cut].tolist(), doc[cut + 1].tolist(), strict=True)
        for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n <= REGION and region[f] != edge:
                links += _span(doc[f : f + n], bits[f : f + n])
            else:  # neighbours in the deeper order
                links += zip(doc[f : f + n - 1].tolist(), doc[f + 1 : f + n].tolist(), strict=True)
        return links

    for batch in batches:
        if not len(batch):
            continue
        region, doc, b1, b2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "doc_id", "bits1", "bits2"))
        bits = np.stack([b1, b2], 1).view(np.uint64)
        if not ends:
            ends.append((int(doc[0]), int(region[0])))
        if held is not None:
            region, doc, bits = np.r_[held[0], region], np.r_[held[1], doc], np.concatenate([held[2], bits])
        cut = int(np.searchsorted(region, region[-1], "left"))
        links = whole(region[:cut], doc[:cut], bits[:cut], ends[0][1]) if cut else []
        held = region[cut:], doc[cut:], bits[cut:]
        if len(held[0]) > 4 * REGION:  # a large region: link what is here and hold its last rows
            links += zip(held[1][: -REGION - 1].tolist(), held[1][1:-REGION].tolist(), strict=True)
            held = tuple(x[-REGION - 1 :] for x in held)
        links = [x for x in links if x[0] != x[1]]
        if links:
            yield out(*zip(*links, strict=True), [None] * len(links))
    if held is not None:
        links = whole(*held, int(held[0][-1]))
        ends.append((int(held[1][-1]), int(held[0][-1])))
        if links:
            yield out(*zip(*links, strict=True), [None] * len(links))
        yield out([x[0] for x in ends], [None] * len(ends), [x[1] for x in ends])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shingle sets beside what is known of their neighbourhoods."""
    for batch in batches:
        for i, j, data, offsets in tb.slices(batch.column("text")):
            values, sizes = shingle_sets(data, offsets)
            at = np.r_[0, np.cumsum(sizes)]
            part = batch.slice(i, j - i)
            sets = pa.array([values[at[k] : at[k + 1]].tobytes() for k in range(len(sizes))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "hood", "blocks")), sets], ["doc_id", "hood", "blocks", "shingles"])


def confirmed(ids: list[int], sets: list[np.ndarray], side: list[bool] | None) -> list[tuple[int, int]]:
    """Links that span what the likeness of whole sets connects; with sides, of pairs across them only."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    names, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    at = np.r_[0, np.cumsum(size)]
    seen = np.zeros(len(names), bool)
    root = np.arange(len(order))
    across = np.array([side[i] for i in order]) if side else None
    links = []
    for i in range(len(order) - 1):
        most = int(np.searchsorted(size, size[i] * 100 // LIKENESS, "right"))  # larger sets can't be alike
        others = np.arange(i + 1, max(most, i + 1))
        others = others[root[others] != root[i]]
        if across is not None:
            others = others[across[others] != across[i]]
        if not len(others):
            continue
        own = flat[at[i] : at[i + 1]]
        seen[own] = True
        shared = np.empty(len(others), np.int64)
        for k in range(0, len(others), 256):
            some = others[k : k + 256]
            n = size[some]
            first = np.cumsum(n) - n
            shared[k : k + 256] = np.add.reduceat(seen[flat[np.arange(n.sum()) + np.repeat(at[some] - first, n)]].astype(np.int64), first)
        seen[own] = False
        for j in others[100 * shared >= LIKENESS * (size[i] + size[others] - shared)].tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                links.append((ids[order[i]], ids[order[j]]))
    return links


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each meeting of blocks; the rows of a meeting follow one another."""
    key, ids, sets, blocks = None, [], [], []

    def flush():
        links = confirmed(ids, sets, [b == key[1] for b in blocks] if key[1] != key[2] else None) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("hood", "one", "other", "doc_id", "block", "shingles")), strict=True)
        for *now, doc, block, raw in rows:
            if now != key:
                if key is not None:
                    yield flush()
                key, ids, sets, blocks = now, [], [], []
            ids.append(doc)
            blocks.append(block)
            sets.append(np.frombuffer(raw, np.uint64))
    if key is not None:
        yield flush()


def near_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.table(docs.mapInArrow(_sign, "doc_id long, n_shingles long, k1 long, k2 long, signature binary"))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    copies = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    apart = full.select("doc_id", "k1", "k2", "signature").join(copies, ["doc_id", "k1", "k2"], "left_semi")
    apart = scratch.table(apart.select("doc_id", "signature"))
    planted_at = scratch.path()

    forest = apart.mapInArrow(_plant, "region long, deeper long, doc_id long, bits1 long, bits2 long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forest = forest.repartitionByRange(parts, "region", "deeper", "doc_id").sortWithinPartitions("region", "deeper", "doc_id")
    found = scratch.table(forest.mapInArrow(_read_regions, "a long, b long, region long"))
    found_at = scratch.path()
    ends = found.where("region is not null")  # two rows a part
    candidates = found.where("region is null").select("a", "b").union(_pairs(ends))
    hoods = scratch.table(components(candidates, scratch).withColumnsRenamed({"node": "doc_id", "component": "hood"}))
    scratch.drop(found_at)
    scratch.drop(planted_at)

    sized = hoods.join(full.select("doc_id", "n_shingles"), "doc_id")
    weight = sized.groupBy("hood").agg(F.ceil(F.sum("n_shingles") * 8 / block_bytes).cast("int").alias("blocks"))
    member = hoods.join(weight, "hood")
    sets = docs.where("doc_id is not null").join(member, "doc_id").select("doc_id", "hood", "blocks", "text")
    sets = sets.mapInArrow(_sets, "doc_id long, hood long, blocks int, shingles binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    sets = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("hood", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "doc_id", "block", "shingles")
    meetings = sets.repartition(F.col("hood"), F.col("one"), F.col("other")).sortWithinPartitions("hood", "one", "other", "doc_id")
    links = scratch.table(meetings.mapInArrow(_confirm, "a long, b long"))
    joined = components(links, scratch)

    named = full.select("doc_id", "k1", "k2").join(copies.withColumnRenamed("doc_id", "first"), ["k1", "k2"])
    named = named.join(joined.withColumnRenamed("node", "first"), "first", "left")
    named = named.groupBy("doc_id").agg(F.min(F.coalesce("component", "first")).alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _pairs(ends: DataFrame) -> DataFrame:
    """Links of the rows at the ends of parts that share a region."""
    least = ends.groupBy("region").agg(F.min("a").alias("b"))
    return ends.select("region", "a").join(least, "region").where("a <> b").select("a", "b")


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_lsh_forest": op4_lsh_forest}
ORACLES: dict[str, str] = {}
