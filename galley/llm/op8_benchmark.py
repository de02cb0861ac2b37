"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Items (questions and answers alike) and documents are normalised by one byte table: A-Z lower-cased, every ASCII byte
that is not a letter or digit a separator, bytes beyond ASCII parts of words. The words of a text, joined by single
spaces, are scanned once. A window's occurrence ends at a known byte, which gives the words it covers; word n of the
normalised text is word n of the original, whose code point offsets the operator reports as spans.

The items are sent to every worker, which builds the automaton. A benchmark over MAX_BENCHMARK_BYTES is scanned in shares of
that size, long items cut between windows: a worker holds a buffer of documents and builds one share's automaton after the
other. A pass over the documents takes the shares of MAX_PASS_BYTES; between passes rows are written with the words hit and
the items found so far. The driver holds one pass's items. Documents are never gathered; a row is read and judged alone.

Defined cases: an empty table gives an empty one, and texts are read whole, however
long; a null or empty text has no words; an item without words matches nothing; a null item_id is left out of
the list of items but its windows count as hits. Repeated items and rows count once each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.scratch import Scratch

#: Words in a window.
WINDOW = 13
#: Hit words, in hundredths of a document's words, from which it is contaminated.
SHARE = 5
#: Text bytes of test items; each takes about 400 bytes of a worker's memory.
MAX_BENCHMARK_BYTES = 1_000_000
#: Text bytes of test items that one pass over the documents takes, in shares.
MAX_PASS_BYTES = 32_000_000
#: Text bytes of documents that a worker holds while it builds one share's automaton after the other.
BUFFER_BYTES = 64_000_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
#: Between passes: marks of the words hit, as bits, and the items found.
STATE = "_marks binary, _names array<string>"


def normalised(text: str | None) -> bytes:
    """The words of a text, with one space before, between and after them."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return b" %s " % b" ".join(words) if words else b""


def windows(text: str | None, width: int = WINDOW) -> set[bytes]:
    """All windows of an item, a space at both ends."""
    words = normalised(text).split()
    return {b" %s " % b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


class Scanner:
    """Finds the windows of test items in texts."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WINDOW):
        self.names = sorted({str(k) for k, _ in items if k is not None})
        place = {k: i for i, k in enumerate(self.names)}
        found: dict[bytes, set[int]] = {}
        for k, text in items:
            for w in windows(text, width):
                found.setdefault(w, set()).update(() if k is None else (place[str(k)],))
        self.automaton = ahocorasick.Automaton()
        for w, own in found.items():
            self.automaton.add_word(w.decode("latin-1"), (len(w), tuple(own)))
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[list[tuple[int, int]], set[int]]:
        """(byte ranges of occurrences, without the spaces at their ends; items) in a normalised text."""
        ranges, items = [], set()
        if self.any:
            for end, (n, own) in self.automaton.iter(text.decode("latin-1")):
                ranges.append((end - n + 2, end))
                items.update(own)
        return ranges, items


def hit_words(text: bytes, ranges: list[tuple[int, int]]) -> np.ndarray:
    """A mark for each word of a normalised text that lies in a range."""
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    mark = np.zeros(len(gaps), np.int64)
    at = np.array(ranges)
    np.add.at(mark, np.searchsorted(gaps, at[:, 0]) - 1, 1)
    np.add.at(mark, np.searchsorted(gaps, at[:, 1]), -1)
    return np.cumsum(mark)[:-1] > 0


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point ranges in the original text of runs of hit words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(raw.tobytes().translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
    points = np.cumsum(np.r_[0, (raw & 0xC0) != 0x80])
    starts, ends = points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]
    run = np.diff(np.r_[0, hit.astype(np.int8), 0])
    return list(zip(starts[np.flatnonzero(run == 1)].tolist(), ends[np.flatnonzero(run == -1) - 1].tolist(), strict=True))


def buffered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups, each closed when it has over so many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def add_hits(automaton: Scanner, texts: list[bytes], marks: list[np.ndarray | None], names: list[set[str]]) -> None:
    """Add what an automaton finds in normalised texts to the marks of their words and to the names of items."""
    for i, text in enumerate(texts):
        ranges, own = automaton.scan(text)
        if ranges:
            hit = hit_words(text, ranges)
            marks[i] = hit if marks[i] is None else marks[i] | hit
            names[i].update(automaton.names[j] for j in own)


def scanner(items: list[tuple[object, str | None]], width: int, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that adds COLUMNS to the columns kept."""
    return share_scanner([items], width, keep)


def share_scanner(shares: list[list[tuple[object, str | None]]], width: int, keep: list[str], first: bool = True, last: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass for mapInArrow: reads STATE unless it is the first, and adds COLUMNS if it is the last, or else text and STATE."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Scanner(shares[0], width) if len(shares) == 1 else None
        for held in buffered(batches, 0 if only else BUFFER_BYTES):
            texts = [normalised(v.as_py()) for b in held for v in b.column("text")]
            if first:
                marks, names = [None] * len(texts), [set() for _ in texts]
            else:
                bits = [v.as_py() for b in held for v in b.column("_marks")]
                marks = [np.unpackbits(np.frombuffer(x, np.uint8), count=t.count(b" ") - 1).astype(bool) if x else None for x, t in zip(bits, texts, strict=True)]
                names = [set(v.as_py()) for b in held for v in b.column("_names")]
            for share in shares:
                add_hits(only or Scanner(share, width), texts, marks, names)
            at = 0
            for batch in held:
                own = slice(at, at + batch.num_rows)
                at = own.stop
                yield (judged if last else state)(batch, keep, texts[own], marks[own], names[own])

    return scan


def state(batch: pa.RecordBatch, keep: list[str], texts: list[bytes], marks: list[np.ndarray | None], names: list[set[str]]) -> pa.RecordBatch:
    """The columns kept, the text and STATE."""
    bits = [b"" if m is None else np.packbits(m).tobytes() for m in marks]
    columns = list(dict.fromkeys([*keep, "text"]))
    arrays = [pa.array(bits, pa.binary()), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *arrays], [*columns, "_marks", "_names"])


def judged(batch: pa.RecordBatch, keep: list[str], texts: list[bytes], marks: list[np.ndarray | None], names: list[set[str]]) -> pa.RecordBatch:
    """The columns kept and COLUMNS."""
    nothing = hashlib.sha256(b"").hexdigest()
    n_words, n_hit, n_items, sha, bad, spans = [], [], [], [], [], []
    for value, text, mark, found in zip(batch.column("text"), texts, marks, names, strict=True):
        n = text.count(b" ") - 1 if text else 0
        own = sorted(found)
        hit, where = 0, ""
        if mark is not None:
            hit = int(mark.sum())
            where = ",".join(f"{a}:{b}" for a, b in original_spans(value.as_py(), mark))
        n_words.append(n)
        n_hit.append(hit)
        n_items.append(len(own))
        sha.append(hashlib.sha256(",".join(own).encode()).hexdigest() if own else nothing)
        bad.append(hit > 0 and 100 * hit >= SHARE * n)
        spans.append(where)
    arrays = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_()), pa.array(spans, pa.string())]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], [*keep, *(c.split()[0] for c in COLUMNS.split(", "))])


def size_of(benchmark: DataFrame) -> int:
    """Text bytes of all test items."""
    return benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def items_of(benchmark: DataFrame, most: int = MAX_BENCHMARK_BYTES) -> list[tuple[object, str | None]]:
    """All test items of one automaton, after a check of their size."""
    total = size_of(benchmark)
    if total > most:
        raise ValueError(f"the benchmark has {total} bytes, over {most}: scan it in shares")
    return [tuple(r) for r in benchmark.select("item_id", "text").distinct().collect()]


def pieces(text: str | None, width: int, most: int) -> Iterator[tuple[str | None, int]]:
    """(text, bytes) of parts of an item that have its windows between them, each of so many bytes at most or of one window."""
    size = len((text or "").encode("utf-8", "surrogatepass"))
    words = normalised(text).split() if size > most else []
    if len(words) <= width:
        yield text, size
        return
    start = end = size = 0
    while end < len(words):
        if size + len(words[end]) + 1 > most and end - start >= width:
            yield b" ".join(words[start:end]).decode("utf-8", "surrogatepass"), size
            start = end - width + 1
            size = sum(len(w) + 1 for w in words[start:end])
        size += len(words[end]) + 1
        end += 1
    yield b" ".join(words[start:]).decode("utf-8", "surrogatepass"), size


def passes_of(benchmark: DataFrame, width: int, most: int, at_once: int) -> Iterator[list[list[tuple[object, str | None]]]]:
    """The test items as passes of shares; a benchmark of one share is one pass."""
    if size_of(benchmark) <= most:
        yield [items_of(benchmark, most)]
        return
    shares, share, total, size = [], [], 0, 0
    for name, text in benchmark.select("item_id", "text").distinct().toLocalIterator():
        for part, n in pieces(text, width, most):
            if share and size + n > most:
                shares.append(share)
                share, size = [], 0
                if total + n > at_once:
                    yield shares
                    shares, total = [], 0
            share.append((name, part))
            size += n
            total += n
    yield [*shares, share]


def decontaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], width: int = WINDOW, most: int = MAX_BENCHMARK_BYTES, at_once: int = MAX_PASS_BYTES) -> DataFrame:
    """The kept columns of documents (text, ...), with COLUMNS; no shuffle. All passes but the last are run here."""
    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    partial = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    scratch, path, first = Scratch(docs.sparkSession), None, True
    passes = passes_of(benchmark, width, most, at_once)
    shares = next(passes)
    for following in passes:
        frame = scratch.table(frame.mapInArrow(share_scanner(shares, width, keep, first, last=False), f"{partial}, {STATE}"))
        if path:
            scratch.drop(path)
        path, shares, first = scratch.path(), following, False
    return frame.mapInArrow(share_scanner(shares, width, keep, first), f"{schema}, {COLUMNS}")


def op8_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that windows of test items cover."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])


_SQL = r"""
with item as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, list_slice(w, i, i + 12) as win from item, lateral (select unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i) where len(w) > 0),
doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
widths as (select distinct len(win) as n from win),
place as (select doc_id, n, i, list_slice(w, i, i + n - 1) as win from doc, widths, lateral (select unnest(range(1, len(w) - n + 2)) as i) where len(w) >= n),
occ as (select p.doc_id, p.i, p.n, x.item_id from place p join win x on p.win = x.win),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from occ) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from occ group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hit using (doc_id) left join items using (doc_id)"""


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns."""
    return op8_benchmark(spark, sf_dir).drop("spans")


QUERIES = {"op8_benchmark": op8_query}
ORACLES = {"op8_benchmark": _SQL}
