"""Exact substring deduplication by maximal repeats in common-prefix interval trees.

A string of LENGTH bytes that starts in two places is found where both places meet:

1. Every window of LENGTH bytes has one anchor, the place of its least GRAM-byte hash (the leftmost of equal ones). The
   choice depends on the window's bytes alone, so equal windows have equal anchors at equal distances. An anchor stands
   for a run of windows; its context is the text that these cover, under 2 * LENGTH bytes.
2. Contexts whose anchor hash occurs once in the corpus can't hold a repeat. The others are grouped by anchor hash, after
   equal contexts were counted and made one.
3. In a group the right parts of the contexts are sorted into a suffix array with its common prefixes. A stack scan walks
   the tree of its intervals from the leaves. Where intervals join at depth r, members from different children differ to
   the right; each member of the smaller looks up its neighbours in the larger in the order of the reversed left parts,
   which gives the longest common left extension l. A pair (l, r) with l + r >= LENGTH is a maximal repeat, and all of its
   occurrences are marked. A neighbour search in the smaller child suffices: any other member of the larger shares at
   least as much with its own side's neighbour.
4. A group of more than GROUP different contexts isn't gathered in a task: its windows are counted one by one instead,
   by a hash of 128 bits with partial sums.

Hashes of 128 bits stand for equal contexts; repeats within a group are compared byte by byte.

Passages of WORDS words and more can be shorter than LENGTH bytes, and then no byte of theirs goes. Documents that lose nothing
but share such a passage with another document are marked (repeats) by the same anchors over words: runs of windows of
WORDS words, those anchors kept that two documents have and one of them that loses nothing, then the windows themselves,
counted by a hash of 128 bits with partial sums.

Defined cases: an empty table gives an empty one, and texts are read whole, however
long; a null text is empty; nothing under LENGTH bytes can repeat. Rows that are equal in doc_id and text count as
two documents, so both are removed if long enough; for passages of words they are one. A null doc_id is a document like any other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import textbytes as tb
from galley.llm.scratch import Scratch

#: Bytes of a string that counts as repeated, and of an anchor.
LENGTH, GRAM = 400, 64
#: Words of a passage that marks a document although it is short in bytes, and of its anchor.
WORDS, WORD_GRAM = 51, 8
#: Words worked on at once; a longer text is cut into overlapping pieces.
WORD_PIECE = 1 << 20
#: Different contexts of an anchor that one task gathers.
GROUP = 20_000
#: Bytes of text hashed at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 21

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)
_tables: dict[str, np.ndarray] = {}
_WORD = tb.table_of(set(range(256)) - {0x20, *range(0x09, 0x0E)})


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        out = np.full(max(n, 1 << 12), base, np.uint64)
        out[0] = 1
        _tables[name] = np.cumprod(out, dtype=np.uint64)
    return _tables[name][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each place on."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=sums[1:])
    n = len(data) - gram + 1
    return (sums[gram:] - sums[:n]) * _power("down", _INVERSE, n) * _SPREAD


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of so many."""
    n = len(values)
    grid = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of anchors in a run of texts; places are bytes from the start of all."""
    size = np.diff(offsets)
    count = np.maximum(size - length + 1, 0)
    if not count.any():
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    grams = gram_hashes(data, gram)
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (_least(keyed, length - gram + 1) & _PLACE).astype(np.int64)
    window = np.arange(int(count.sum())) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)
    place = place[window]
    turn = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[turn[1:], len(place)] - 1
    return grams[place[turn]], place[turn], window[turn], window[last]


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes before, bytes, offsets); texts over PIECE bytes alone and cut."""
    for i, j, data, offsets in tb.slices(column, PIECE):
        if len(data) <= PIECE:
            yield i, j, 0, data, offsets
        else:
            for a in range(0, len(data) - LENGTH + 1, PIECE):
                part = data[a : a + PIECE + LENGTH - 1]
                yield i, j, a, part, np.array([0, len(part)])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "id", "version", "place", "first", "last"]
    for batch in batches:
        for i, _, before, data, offsets in _pieces(batch.column("text")):
            grams, place, first, last = anchors(data, offsets)
            if len(place):
                row = np.searchsorted(offsets, place, "right") - 1
                base = offsets[row] - before
                own = [batch.column(c).take(pa.array(row + i)) for c in ("id", "version")]
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), *own, *(pa.array((x - base).astype(np.int64)) for x in (place, first, last))], names)


def _word_pieces(at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first word, word after the last, words before each text) of a slice's words."""
    if at[-1] <= WORD_PIECE:
        yield 0, int(at[-1]), at
    else:
        for i in range(len(at) - 1):
            for a in range(int(at[i]), max(int(at[i]) + 1, int(at[i + 1]) - WORDS + 1), WORD_PIECE):
                b = min(int(at[i + 1]), a + WORD_PIECE + WORDS - 1)
                yield a, b, np.r_[np.zeros(i + 1, np.int64), np.full(len(at) - 1 - i, b - a)]


def _find_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of passages of words; (first, last) are windows by the number of their first word in the text."""
    names = ["anchor", "id", "version", "first", "last"]
    for batch in batches:
        for i, _, data, offsets in tb.slices(batch.column("text")):
            starts, ends, at = tb.words(data, offsets, _WORD)
            word = tb.hashes(data, starts, ends)
            for a, b, own in _word_pieces(at):
                grams, place, first, last = anchors(word[a:b], own, WORDS, WORD_GRAM)
                if not len(place):
                    continue
                row = np.searchsorted(own, place, "right") - 1
                base = at[row] - a
                turn = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])])  # repeated words make runs with one anchor
                ahead = np.r_[turn[1:], len(row)] - 1
                columns = [batch.column(c).take(pa.array(row[turn] + i)) for c in ("id", "version")]
                runs = [(first - base)[turn], (last - base)[ahead]]
                yield pa.RecordBatch.from_arrays([pa.array(tb.mix(grams[turn]).view(np.int64)), *columns, *(pa.array(x.astype(np.int32)) for x in runs)], names)


def _word_windows(raw: bytes, runs: list[dict]) -> list[dict]:
    """Hashes of a text's windows of words in the runs given."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = tb.words(data, np.array([0, len(data)]), _WORD)
    word = tb.hashes(data, starts, ends)
    one, two = gram_hashes(word, WORDS), gram_hashes(tb.mix(word + np.uint64(7)), WORDS)
    at = np.unique(np.concatenate([np.arange(x["first"], x["last"] + 1) for x in runs]))
    return [{"w1": a, "w2": b} for a, b in set(zip(one[at].view(np.int64).tolist(), two[at].view(np.int64).tolist(), strict=True))]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of repeated anchors; the bytes only where a task meets them first."""
    seen: set[bytes] = set()
    names = ["anchor", "c1", "c2", "skip", "size", "id", "version", "first", "context"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for key, version, text, own in zip(*(batch.column(c) for c in ("id", "version", "text", "own")), strict=True):
            raw = text.as_py().encode()
            for x in own.as_py():
                context, skip = raw[x["first"] : x["last"] + LENGTH], x["place"] - x["first"]
                digest = hashlib.blake2b(b"%d:%d:%b" % (x["anchor"], skip, context), digest_size=16).digest()
                new = digest not in seen
                if new:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(digest)
                c1, c2 = np.frombuffer(digest, np.int64).tolist()
                for held, value in zip(out, (x["anchor"], c1, c2, skip, len(context), key.as_py(), version.as_py(), x["first"], context if new else None), strict=True):
                    held.append(value)
        types = [pa.int64()] * 8 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)


def _common(x: bytes, y: bytes) -> int:
    """Bytes of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low = 0  # x[:low] == y[:low], x[:n] != y[:n]
    while n - low > 1:
        mid = (low + n) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            n = mid
    return low


def maximal_repeats(contexts: list[bytes], skips: list[int], length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(member, other member, bytes to the left, to the right of the anchor) of maximal repeats in a group, which cover
    every string of so many bytes that two members share around the anchor."""
    right = [c[s:] for c, s in zip(contexts, skips, strict=True)]
    left = [c[:s][::-1] for c, s in zip(contexts, skips, strict=True)]
    by_left = sorted(range(len(contexts)), key=left.__getitem__)
    rank = [0] * len(contexts)
    for k, i in enumerate(by_left):
        rank[i] = k

    def join(a: list[int], b: list[int], depth: int, out: list) -> list[int]:
        """Members (as ranks by left part, sorted) of two children of an interval."""
        if len(a) < len(b):
            a, b = b, a
        for k in b:
            at = bisect_left(a, k)
            for other in a[max(at - 1, 0) : at + 1]:
                i, j = by_left[k], by_left[other]
                shared = _common(left[i], left[j])
                if shared + depth >= length:
                    out.append((i, j, shared, depth))
        for k in b:
            insort(a, k)
        return a

    order = sorted(range(len(contexts)), key=right.__getitem__)
    stack: list[tuple[int, list[int]]] = []
    for at, i in enumerate(order):
        depth = _common(right[i], right[order[at + 1]]) if at + 1 < len(order) else -1
        node, found = [rank[i]], []
        while stack and stack[-1][0] > depth:
            deeper, members = stack.pop()
            node = join(members, node, deeper, found)
        if stack and stack[-1][0] == depth:
            node = join(stack.pop()[1], node, depth, found)
        stack.append((depth, node))
        yield from found


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of contexts; the rows of an anchor follow one another."""
    names = ["anchor", "c1", "c2", "begin", "end"]
    anchor, group, out = None, [], []

    def close():
        if len(group) > 1:
            spans: list[list[tuple[int, int]]] = [[] for _ in group]
            skips = [g[2] for g in group]
            for i, j, before, after in maximal_repeats([g[3] for g in group], skips):
                for k in (i, j):
                    spans[k].append((skips[k] - before, skips[k] + after))
            out.extend((anchor, g[0], g[1], a, b) for g, own in zip(group, spans, strict=True) for a, b in _covered(own))

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], names)

    for batch in batches:
        for now, *rest in zip(*(batch.column(c).to_pylist() for c in ("anchor", "c1", "c2", "skip", "context")), strict=True):
            if now != anchor:
                close()
                anchor, group = now, []
            if not group or rest[:2] != group[-1][:2]:  # other tasks may have met the same context
                group.append(rest)
        if len(out) > 10_000:
            yield rows()
            out = []
    close()
    yield rows()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the contexts of large groups."""
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            data = [np.frombuffer(x, np.uint8) for x in part.column("context").to_pylist()]
            count = np.array([len(x) - LENGTH + 1 for x in data])
            one = [gram_hashes(x, LENGTH) for x in data]
            two = [gram_hashes(tb.mix(x.astype(np.uint64) + np.uint64(7)), LENGTH) for x in data]
            place = np.repeat(np.arange(len(data)), count)
            begin = np.concatenate([np.arange(n) for n in count])
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(place)) for c in ("anchor", "c1", "c2")), pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)), pa.array(begin)], ["anchor", "c1", "c2", "w1", "w2", "begin"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "version", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "windows"]
    window = pa.list_(pa.struct([("w1", pa.int64()), ("w2", pa.int64())]))
    for batch in batches:
        size, gone, n, sha, where, windows = [], [], [], [], [], []
        for text, own, runs in zip(batch.column("text"), batch.column("spans"), batch.column("runs"), strict=True):
            raw = text.as_py().encode()
            spans = _covered([(x["begin"], x["end"]) for x in own.as_py() or ()])
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            left = b"".join(kept)
            words = runs.as_py()
            row = len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), ",".join(f"{a}:{b}" for a, b in spans), _word_windows(raw, words) if words else None
            for held, value in zip((size, gone, n, sha, where, windows), row, strict=True):
                held.append(value)
        whole = [pa.array(x, pa.int64()) for x in (size, gone, n)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *whole, pa.array(sha, pa.string()), pa.array(where, pa.string()), pa.array(windows, window)], names)


def _by_windows(contexts: DataFrame, key: list[str]) -> DataFrame:
    """Repeated spans of contexts of large groups: windows that occur in two contexts."""
    windows = contexts.dropDuplicates(key).select(*key, "context").mapInArrow(_windows, "anchor long, c1 long, c2 long, w1 long, w2 long, begin long")
    same = ["anchor", "w1", "w2"]
    twice = windows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*same)
    return windows.join(twice, same, "left_semi").select(*key, "begin", (F.col("begin") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """(id, version, begin, end): bytes of documents (id, version, text) in repeated strings; spans may overlap."""
    found = scratch.table(docs.mapInArrow(_find, "anchor long, id long, version long, place long, first long, last long"))
    found_at = scratch.path()
    again = scratch.table(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))  # so that the join's sides are plain and a hot anchor is split
    own = found.join(again, "anchor", "left_semi").groupBy("id", "version").agg(F.collect_set(F.struct("anchor", "place", "first", "last")).alias("own"))
    fields = "anchor long, c1 long, c2 long, skip long, size long, id long, version long, first long, context binary"
    met = scratch.table(docs.join(own, ["id", "version"]).select("id", "version", "text", "own").mapInArrow(_contexts, fields))
    scratch.drop(found_at)

    key = ["anchor", "c1", "c2"]
    counted = met.groupBy(*key).agg(F.count("*").alias("n"))
    breadth = counted.groupBy("anchor").agg(F.count("*").alias("breadth")).where(F.col("breadth") > group).select("anchor")
    single = met.where("context is not null").select(*key, "skip", "context")
    wide = scratch.table(breadth)
    small = single if wide.isEmpty() else single.join(wide, "anchor", "left_anti")
    small = small.repartition(F.col("anchor")).sortWithinPartitions(*key)
    spans = small.mapInArrow(_scan, "anchor long, c1 long, c2 long, begin long, end long")
    if not wide.isEmpty():
        spans = spans.union(_by_windows(single.join(wide, "anchor", "left_semi"), key))
    spans = scratch.table(spans)

    whole = met.join(counted.where("n > 1").select(*key), key, "left_semi").select("id", "version", F.col("first").alias("begin"), (F.col("first") + F.col("size")).alias("end"))
    parts = met.join(spans, key).select("id", "version", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end"))
    return whole.union(parts)


def word_runs(docs: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, version, runs): runs of windows of words of documents (id, version, text) whose anchor another document has, if
    one of those documents has no span."""
    key = ["id", "version"]
    found = scratch.table(docs.mapInArrow(_find_words, "anchor long, id long, version long, first int, last int"))
    found_at = scratch.path()
    both = found.groupBy("anchor").agg(F.min(F.struct(*key)).alias("one"), F.max(F.struct(*key)).alias("other")).where("one <> other").select("anchor")
    met = scratch.table(found.join(scratch.table(both), "anchor", "left_semi"))
    scratch.drop(found_at)
    live = met.join(spans.select(*key).distinct(), key, "left_anti").select("anchor").distinct()
    return met.join(live, "anchor", "left_semi").groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def without_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats, spans) of documents (doc_id, text)."""
    scratch, key = Scratch(docs.sparkSession), ["id", "version"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("version"), "text")
    bare = docs.select(*key, "text")
    spans = repeated_spans(bare, scratch, group).groupBy(*key).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    spans = scratch.table(spans)
    joined = docs.join(spans, key, "left").join(word_runs(bare, spans, scratch), key, "left").select("doc_id", *key, "text", "spans", "runs")
    fields = "id long, version long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, windows array<struct<w1:long,w2:long>>"
    cut = scratch.table(joined.mapInArrow(_cut, fields))
    windows = cut.where("windows is not null").select(*key, F.inline("windows"))
    same = windows.groupBy("w1", "w2").agg(F.min(F.struct(*key)).alias("one"), F.max(F.struct(*key)).alias("other")).where("one <> other").select("w1", "w2")
    passages = windows.join(same, ["w1", "w2"], "left_semi").select(*key).distinct().withColumn("passage", F.lit(True))
    out = cut.drop("windows").join(passages, key, "left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", ((F.col("n_removed") > 0) | F.coalesce("passage", F.lit(False))).alias("repeats"), "spans")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings leave of every document."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


QUERIES = {"op10_suffix": op10_suffix}
ORACLES: dict[str, str] = {}
