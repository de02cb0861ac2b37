"""Phrase collocation mining: id n-grams as fixed-width binary keys, range-partitioned, radix-sorted and run-length counted.

1. Words are counted by language. Those under LEAST occurrences can be in no phrase that has so many; all others form the
   dictionary and get dense numbers in the order of (language, word), so a number says its language too.
2. Texts become numbers. Where a piece ends or a rare word stands is a break (0). Each place that has a number and another
   behind it gives one key: the numbers of the next LONGEST words up to the next break, then zeros, WIDTH bytes each, where
   the dictionary's size sets WIDTH. A key counts for all its beginnings, so one key a place serves phrases of all lengths.
3. A task sorts its keys by 16-bit digits, least first (numpy's stable sort of 16-bit numbers is a radix sort), merges equal
   ones and cuts the sorted run at the range bounds, which are quantiles of the keys of a sample of documents (the bounds
   decide where keys are counted, never what). A run goes to its range as one compressed block.
4. A range sorts its runs together; the lengths of equal beginnings are the counts. A beginning at the edge of a range may
   go on in the next, so edges are kept whatever their count, and counts are summed once more by key.

Equal keys meet as at most one row from each task's buffer, so neither a frequent pair nor a frequent passage nor a language that holds most rows
needs a task of its own. The dictionary is sent to the workers up to DICTIONARY_WORDS and DICTIONARY_BYTES; beyond that
documents are dealt to chunks by a hash, each chunk meets only its own distinct words by a join, and the rest is the same.
RANGE_KEYS bounds what a task sorts. Scores are exact: products are decimals of 38 digits.

Defined cases: an empty table gives an empty one; a null text is empty, a null lang is `und`; texts are read whole, however
long; repeated rows count again; equal scores go by count, then by phrase in byte order. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.scratch import Scratch

#: Occurrences from which a phrase is a candidate, words of the longest phrase, phrases reported of each language.
LEAST, LONGEST, MOST = 100, 5, 2000
#: The largest dictionary that is sent to the workers.
DICTIONARY_WORDS, DICTIONARY_BYTES = 1_000_000, 32_000_000
#: Keys that a task sorts at once before and after the shuffle.
BUFFER_KEYS, RANGE_KEYS = 1_000_000, 2_000_000
#: Words in the sample for range bounds, for each range and at least in all.
SAMPLE_PER_RANGE, SAMPLE_LEAST = 400, 50_000
#: Different words that a task holds while it counts, and bytes of text in a chunk of the way beyond the dictionary's bound.
COUNTED_WORDS, CHUNK_BYTES = 500_000, 4_000_000

_SPACE, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(32 if b in _SPACE + _BREAK else _LOWER[b] for b in range(256))
_PIECES = bytes(32 if b in _SPACE else 10 if b in _BREAK else _LOWER[b] for b in range(256))

Dictionary = dict[str, dict[bytes, int]]


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, text as bytes) of each row."""
    for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
        yield lang.as_py(), (text.as_py() or "").encode()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f): partial counts of words."""
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            words = [w.decode() for w in own]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "f"])
        held.clear()

    for batch in batches:
        for lang, text in rows_of(batch):
            held.setdefault(lang, Counter()).update(text.translate(_WORDS).split(b" "))
            held[lang].pop(b"", None)
            if sum(map(len, held.values())) > COUNTED_WORDS:
                yield from flush()
    yield from flush()


def numbered(text: bytes, words: dict[bytes, int]) -> list[int]:
    """The numbers of a text's words, 0 for breaks and words without a number."""
    return [words.get(w, 0) for w in text.translate(_PIECES).replace(b"\n", b" \n ").split(b" ") if w]


def keys_of(numbers: np.ndarray, width: int, longest: int = LONGEST) -> np.ndarray:
    """The key of each place that begins two words or more, as rows of bytes."""
    at = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0)) if len(numbers) > 1 else np.empty(0, np.int64)
    padded = np.concatenate([numbers, np.zeros(longest, numbers.dtype)])
    out = np.empty((len(at), longest, width), np.uint8)
    open_ = np.ones(len(at), bool)
    for k in range(longest):
        own = padded[at + k]
        open_ &= own > 0
        out[:, k] = np.where(open_, own, 0).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return out.reshape(len(at), longest * width)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of bytes, by 16-bit digits from the last to the first."""
    n, length = keys.shape
    order = np.arange(n)
    for end in range(length, 0, -2):
        digit = keys[:, end - 1].astype(np.uint16)
        if end > 1:
            digit |= keys[:, end - 2].astype(np.uint16) << 8
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, how often each occurs)."""
    order = radix_order(keys)
    keys = keys[order]
    counts = np.ones(len(keys), np.int64) if counts is None else counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    return keys[first], np.add.reduceat(counts, first)


def strings(keys: np.ndarray) -> np.ndarray:
    """Rows of bytes as fixed-length byte strings, which compare in the same order."""
    return np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel() if len(keys) else np.empty(0, "S1")


_RUNS = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def cut_runs(keys: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """The keys of a buffer as sorted runs, one for each range, in compressed blocks."""
    keys, counts = run_lengths(keys)
    at = np.r_[0, np.searchsorted(strings(keys), bounds, "left") if len(bounds) else [], len(keys)].astype(np.int64)
    codec, rows = pa.Codec("zstd", compression_level=1), []
    for part, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if j > i:
            rows.append((part, j - i, codec.compress(np.ascontiguousarray(keys[i:j].T).tobytes(), asbytes=True), codec.compress(counts[i:j].tobytes(), asbytes=True)))
    return pa.RecordBatch.from_pylist([dict(zip(_RUNS.names, r, strict=True)) for r in rows], _RUNS)


def encoder(dictionary: Callable[[], Dictionary], width: int, bounds: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: texts to runs, or to bare keys where there are no bounds yet."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = dictionary(), [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate(held)
            if bounds is None:
                return pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary())], ["key"])
            return cut_runs(keys, bounds)

        for batch in batches:
            for lang, text in rows_of(batch):
                own = words.get(lang)
                if own:
                    held.append(keys_of(np.array(numbered(text, own), np.int64), width))
                    n += len(held[-1])
                if n >= BUFFER_KEYS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return encode


def range_counter(width: int, least: int, longest: int = LONGEST) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow: the runs of one range to (size, key, f) of phrases that have enough, and of those at its edges."""

    def count(table: pa.Table) -> pa.Table:
        codec, keys, counts = pa.Codec("zstd"), [], []
        for n, k, c in zip(table["n"].to_pylist(), table["keys"], table["counts"], strict=True):
            keys.append(np.frombuffer(codec.decompress(k.as_buffer(), n * longest * width), np.uint8).reshape(longest * width, n).T)
            counts.append(np.frombuffer(codec.decompress(c.as_buffer(), n * 8), np.int64))
        whole, total = run_lengths(np.concatenate(keys), np.concatenate(counts))
        changed = whole[1:] != whole[:-1]
        sizes, names, sums = [], [], []
        for size in range(2, longest + 1):
            first = np.flatnonzero(np.r_[True, changed[:, : size * width].any(axis=1)])
            f = np.add.reduceat(total, first)
            edge = np.zeros(len(first), bool)
            edge[[0, -1]] = True
            kept = np.flatnonzero(((f >= least) | edge) & whole[first, (size - 1) * width : size * width].any(axis=1))
            sizes += [size] * len(kept)
            names += [k.tobytes() for k in whole[first[kept], : size * width]]
            sums += f[kept].tolist()
        return pa.table({"size": pa.array(sizes, pa.int32()), "key": pa.array(names, pa.binary()), "f": pa.array(sums, pa.int64())})

    return count


def dictionary_of(spoken: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, dict[str, int]]:
    """(lang, word, f, id) of the frequent words, and each language's number of words."""
    counts = spoken.mapInArrow(count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    kept = F.when(F.col("f") >= least, F.col("word"))
    counted = scratch.table(counts.groupBy("lang", kept.alias("word")).agg(F.sum("f").alias("f")))
    words = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("f").alias("n")).collect()}
    placed = scratch.table(counted.where("word is not null").repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").withColumn("at", F.monotonically_increasing_id()))
    before, offsets = 1, {}
    for part, n in placed.groupBy(F.shiftright("at", 33)).count().orderBy(F.shiftright("at", 33)).collect():
        offsets[part] = before - (part << 33)
        before += n
    if not offsets:
        return placed.select("lang", "word", "f", F.lit(0).cast("long").alias("id")), words
    move = F.create_map(*(F.lit(x).cast("long") for pair in offsets.items() for x in pair))
    return scratch.table(placed.select("lang", "word", "f", (F.col("at") + move[F.shiftright("at", 33)]).alias("id"))), words


def runs_of(spoken: DataFrame, dictionary: DataFrame, width: int, bounds: np.ndarray | None, most_words: int, most_bytes: int) -> DataFrame:
    """Runs, or bare keys where there are no bounds, of all texts."""
    schema = "key binary" if bounds is None else "part int, n long, keys binary, counts binary"
    words, size = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if words <= most_words and size <= most_bytes:
        sent = spoken.sparkSession.sparkContext.broadcast(dictionary.select("lang", "word", "id").toArrow())

        def whole() -> Dictionary:
            out: Dictionary = {}
            for lang, word, i in zip(*(sent.value[c].to_pylist() for c in ("lang", "word", "id")), strict=True):
                out.setdefault(lang, {})[word.encode()] = i
            return out

        return spoken.mapInArrow(encoder(whole, width, bounds), schema)
    chunks = int(max(1, (spoken.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES))
    # equal texts are dealt by their row's own number as well, so that copies spread
    dealt = spoken.withColumn("chunk", F.pmod(F.xxhash64("text", "row"), F.lit(chunks)))
    own = dealt.mapInArrow(chunk_words, "chunk long, lang string, word string").distinct().join(dictionary.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "lang", "word", "id")

    def encode(texts: pa.Table, found: pa.Table) -> pa.Table:
        out: Dictionary = {}
        for lang, word, i in zip(*(found[c].to_pylist() for c in ("lang", "word", "id")), strict=True):
            out.setdefault(lang, {})[word.encode()] = i
        batches = list(encoder(lambda: out, width, bounds)(texts.to_batches()))
        return pa.Table.from_batches(batches, pa.schema([("key", pa.binary())]) if bounds is None else _RUNS)

    return dealt.select("chunk", "lang", "text").groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(encode, schema)


def chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, lang, word): the different words of each text."""
    for batch in batches:
        for chunk, (lang, text) in zip(batch.column("chunk").to_pylist(), rows_of(batch), strict=True):
            words = [w.decode() for w in set(text.translate(_WORDS).split(b" ")) if w]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(words), pa.int64()), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string())], ["chunk", "lang", "word"])


def bounds_of(spoken: DataFrame, dictionary: DataFrame, width: int, words: int, range_keys: int, most: tuple[int, int]) -> np.ndarray:
    """Keys that divide all keys into ranges of about range_keys, from a sample of documents."""
    ranges = -(-words // range_keys)
    if ranges < 2:
        return np.empty(0, f"S{LONGEST * width}")
    share = min(1.0, max(SAMPLE_PER_RANGE * ranges, SAMPLE_LEAST) / words)
    some = np.sort(np.array([bytes(r.key) for r in runs_of(spoken.sample(share, 11), dictionary, width, None, *most).toLocalIterator()], f"S{LONGEST * width}"))
    return np.unique(some[np.arange(1, ranges) * len(some) // ranges]) if len(some) else some


def phrases(docs: DataFrame, least: int = LEAST, most: int = MOST, range_keys: int = RANGE_KEYS, most_words: int = DICTIONARY_WORDS, most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of documents (text, lang, ...)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    spoken = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    dictionary, totals = dictionary_of(spoken, least, scratch)
    width = max(1, ((dictionary.agg(F.max("id")).first()[0] or 1).bit_length() + 7) // 8)
    spoken = spoken.withColumn("row", F.monotonically_increasing_id())
    bounds = bounds_of(spoken, dictionary, width, sum(totals.values()), range_keys, (most_words, most_bytes))
    runs = runs_of(spoken, dictionary, width, bounds, most_words, most_bytes)
    counted = runs.groupBy("part").applyInArrow(range_counter(width, least), "size int, key binary, f long")
    found = scratch.table(counted.groupBy("size", "key").agg(F.sum("f").alias("a")).where(F.col("a") >= least))
    return ranked(found, dictionary, spark.createDataFrame(list(totals.items()), "lang string, n long"), width, most)


def ranked(found: DataFrame, dictionary: DataFrame, totals: DataFrame, width: int, most: int) -> DataFrame:
    """The best phrases of each language; found: (size, key, a), dictionary: (lang, word, f, id)."""
    words = dictionary.select("lang", "word", "f", F.expr(f"unhex(lpad(hex(id), {2 * width}, '0'))").alias("key"))
    known = found.select("key", F.col("a").alias("f")).union(words.select("key", "f"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", F.expr(f"substring(key, 1, k * {width})")).withColumn("right", F.expr(f"substring(key, k * {width} + 1)")).withColumn("head", F.expr(f"substring(key, 1, {width})"))
    cuts = cuts.join(known.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.join(words.select(F.col("key").alias("head"), "lang"), "head").join(totals, "lang")
    score = F.expr("cast((cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as long)")
    scored = cuts.groupBy("lang", "n", "size", "key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # a longer phrase with the same count has beginnings and ends of every length between with that count: one step is enough
    inner = found.where("size > 2").select(F.explode(F.array(F.expr(f"substring(key, 1, (size - 1) * {width})"), F.expr(f"substring(key, {width} + 1)"))).alias("key"), F.col("a").alias("longer"))
    scored = scored.join(inner.groupBy("key").agg(F.max("longer").alias("longer")), "key", "left").where("longer is null or longer < a")
    best = scored.select("lang", "n", "size", "key", "a", "cut.*")
    order = [F.col("score").desc(), F.col("a").desc()]
    best = best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= most)
    spelled = best.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).withColumn("word_key", F.expr(f"substring(key, i * {width} + 1, {width})"))
    spelled = spelled.join(words.select(F.col("key").alias("word_key"), "word"), "word_key").groupBy("lang", "key", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("spelling"))
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", "spelling.word"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.col("phrase")))
    return spelled.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL = r"""
with doc as (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
piece as (select lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from doc)),
total as (select lang, sum(len(w))::hugeint as n from piece group by lang),
grams as (select lang, k as size, list_slice(w, i, i + k - 1) as g from piece, (select unnest(range(1, 6)) as k), lateral (select unnest(range(1, len(w) - k + 2)) as i) where len(w) >= k),
f as (select lang, size, g, count(*)::hugeint as f from grams group by lang, size, g having count(*) >= 100),
cuts as (select c.lang, c.size, c.g, c.f as a, k, x.f as l, y.f as r, n, (1000 * c.f * n) // (x.f * y.f) as score
  from f c join total using (lang), lateral (select unnest(range(1, c.size)) as k)
  join f x on x.lang = c.lang and x.g = list_slice(c.g, 1, k) join f y on y.lang = c.lang and y.g = list_slice(c.g, k + 1, c.size) where c.size > 1),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
inside as (select distinct lang, g from (select lang, f, list_slice(g, i, i + k - 1) as g from f, (select unnest(range(2, 5)) as k), lateral (select unnest(range(1, size - k + 2)) as i) where size > k) s
  where exists (select 1 from f where f.lang = s.lang and f.g = s.g and 100 * s.f >= 100 * f.f)),
kept as (select *, array_to_string(g, ' ') as phrase from best anti join inside using (lang, g))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from kept qualify rank <= 2000"""

QUERIES = {"op11_phrases": op11_phrases}
ORACLES = {"op11_phrases": _SQL}
