"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel compares units: white-space tokens without their punctuation, or runs of single letters taken together, with a
mark at both ends. A unit's features are its subsequences of three bytes within SPAN bytes, weighted by DECAY for each byte
skipped; the kernel is their inner product, scaled by the landmark's own, to the power of POWER. So "id-iot" and
"i d i o t" are the unit "idiot", and "idxiot" shares most features with it. The kernel of a sentence and a landmark is that of its best unit. Landmarks
are stems or whole units, chosen on the labelled sample; the kernel's values against them, whitened by the landmarks' own
kernel matrix, are a sentence's Nyström features.

Labels are given by document, sentences are wanted: those of a toxic document's sentences are toxic that have
a unit with a beginning from a small set which covers the toxic documents and hardly any other; where that finds none, the one that the
machine itself puts first, if it calls it toxic. All sentences of other documents are clean. Toxic units are also learned with a byte inserted. A
document's score is a logistic curve of the margins of its WORST sentences that the machine puts first and of how many it has,
fitted on documents that the machine was not fitted on: one plain insult is enough, and so are several doubtful ones in a short text.

The sample is at most FIT_ROWS documents of each label outside the held-out fold, in the order of a hash of doc_id, without
those over FIT_BYTES and with one text for each doc_id; it alone goes to the driver. Scoring reads every whole text and shuffles nothing.

Defined cases: an empty table gives an empty one, and texts are read whole, however
long; a null, empty or blank text has no units, and one score for all such texts. Without documents of both labels
every score is the share of label 1, or 0.5 without labels. Null labels are ignored; a doc_id with several labels has the
largest. A null doc_id isn't held out. Rows are scored one by one, so ties, repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import textbytes as tb
from galley.llm.op1_quality import fit_rows, held_out

#: Labelled documents of each label for the fit, and the most bytes that one of them has.
FIT_ROWS, FIT_BYTES = 2000, 1 << 16
#: Bytes that a subsequence of three may span, and its weight's factor for each byte skipped.
SPAN, DECAY, POWER = 6, 0.75, 3
#: Landmarks, and the share of the units chosen together that a stem must begin.
LANDMARKS, STEM = 48, 0.75
#: Hashed features; sizes of beginnings of units in the first choice of sentences, with the mark.
FEATURES, BEGINNINGS = 1 << 16, (5, 6, 7, 8, 9)
#: Kernel value below which a clean sentence counts like one without units.
FAINT = 0.02
#: What a beginning may have of its worth taken off by clean documents that have it too, as a logarithm.
LENIENT = 0.5
#: Sentences whose margins make a document's score, the largest margin that counts, and the ridge of the curve.
WORST, FAR, RIDGE = 3, 4.0, 0.3
#: Units compared with landmarks at once.
UNITS = 1 << 14
#: Bytes of text scored at once, and the least score of a toxic document.
SLICE, TOXIC = 1 << 20, 0.5

_PAIRS = [(d, e, DECAY ** (e - 2)) for e in range(2, SPAN) for d in range(1, e)]
_TOKEN = tb.table_of(set(range(256)) - {0x20, *range(0x09, 0x0E)})
_INNER = tb.table_of({*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)})
_FOLD = tb.folding()


@dataclass
class Units:
    """Units of a run of texts, side by side in flat, each between two marks."""

    flat: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sentence: np.ndarray  # of each unit
    text_of: np.ndarray  # of each sentence


def units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Split texts; every text has one sentence at least."""
    n_texts = len(offsets) - 1
    begin, end, at = tb.words(data, offsets, _TOKEN)
    stop = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8)) if len(end) else np.zeros(0, bool)
    line = np.cumsum(data == 10)
    text = np.repeat(np.arange(n_texts), np.diff(at))
    inner = np.flatnonzero(_INNER[data])
    if len(inner):
        first, last = np.searchsorted(inner, begin), np.searchsorted(inner, end)
        good = last > first
        first, last = first[good], last[good]
        begin, stop, text = inner[first], stop[good], text[good]
    else:
        first = last = begin = begin[:0]
        stop, text = stop[:0], text[:0]
    size = last - first
    after = np.cumsum(size)
    lines = line[begin] if len(begin) else begin
    new = np.ones(len(begin), bool)
    new[1:] = stop[:-1] | (text[1:] != text[:-1]) | (lines[1:] != lines[:-1])
    sentence = np.cumsum(new) - 1
    # Single letters in a row, in one text, are one unit; its sentence is its first letter's.
    single = size == 1
    joined = np.zeros(len(begin), bool)
    joined[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    head = np.flatnonzero(~joined)
    tail = np.r_[head[1:], len(begin)] - 1
    long = (after[tail] - (after - size)[head] if len(head) else head) >= 3
    own = np.cumsum(~joined) - 1 if len(begin) else head
    use = long[own] if len(begin) else np.zeros(0, bool)  # tokens of units that are kept
    number = (np.cumsum(long) - 1)[own[use]] if len(begin) else own
    before = np.cumsum(size[use]) - size[use] + 2 * number + 1
    length = np.bincount(number, size[use], int(long.sum())).astype(np.int64) + 2
    ends = np.cumsum(length)
    starts = ends - length
    flat = np.zeros(int(length.sum()), np.uint8)
    flat[starts], flat[ends - 1] = 2, 3
    step = np.arange(int(size[use].sum()))
    ahead = np.cumsum(size[use]) - size[use]
    flat[step + np.repeat(before - ahead, size[use])] = _FOLD[data[inner[step + np.repeat(first[use] - ahead, size[use])]]]
    # Texts without a sentence get an empty one at the end.
    text_of = text[new]
    empty = np.setdiff1d(np.arange(n_texts), text_of)
    return Units(flat, starts, ends, sentence[head][long], np.r_[text_of, empty].astype(np.int64))


def _features(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(unit, feature, weight) of all subsequences, by their two distances."""
    size = ends - starts
    if not len(size):
        return
    unit = np.repeat(np.arange(len(size)), size)
    place = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    left = np.repeat(ends, size) - place
    value = flat.astype(np.uint32)
    for d, e, weight in _PAIRS:
        ok = np.flatnonzero(left > e)
        p = place[ok]
        key = value[p] * np.uint32(0x9E3779B1) ^ value[p + d] * np.uint32(0x85EBCA77) ^ value[p + e] * np.uint32(0xC2B2AE3D)
        yield unit[ok], ((key * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int64), weight


class Kernel:
    """Kernel values of units against landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        flat = np.frombuffer(b"".join(landmarks), np.uint8)
        ends = np.cumsum([len(x) for x in landmarks])
        starts = ends - [len(x) for x in landmarks]
        full = np.zeros((FEATURES, len(landmarks)), np.float32)
        for unit, feature, weight in _features(flat, starts, ends):
            np.add.at(full, (feature, unit), weight)
        norm = np.sqrt((full.astype(np.float64) ** 2).sum(0))
        full /= np.maximum(norm, 1e-6).astype(np.float32) ** 2
        used = np.flatnonzero(full.any(1))
        self.row = np.full(FEATURES, -1, np.int32)
        self.row[used] = np.arange(len(used))
        # Few landmarks have any one feature: (landmark, weight) of those that do, by feature.
        of, self.mark = np.nonzero(full[used])
        self.worth = full[used][of, self.mark].astype(np.float64)
        self.size = np.bincount(of, minlength=len(used))
        self.at = np.cumsum(self.size) - self.size
        unit = (full * norm.astype(np.float32)).astype(np.float64)
        self.own = (unit.T @ unit) ** POWER

    def values(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each unit; units follow each other in flat."""
        out = np.zeros((len(starts), len(self.landmarks)), np.float32)
        for k in range(0, len(starts), UNITS):
            a, b = starts[k : k + UNITS], ends[k : k + UNITS]
            out[k : k + UNITS] = self._sums(flat[a[0] : b[-1]], a - a[0], b - a[0])
        return np.minimum(out, 1) ** POWER

    def _sums(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Inner products, summed over the features that a unit and a landmark share."""
        n, cells, worths = len(self.landmarks), [], []
        for unit, feature, weight in _features(flat, starts, ends):
            row = self.row[feature]
            hit = np.flatnonzero(row >= 0)
            row = row[hit]
            size = self.size[row]
            after = np.cumsum(size)
            own = np.repeat(self.at[row] - after + size, size) + np.arange(int(size.sum()))
            cells.append(np.repeat(unit[hit] * n, size) + self.mark[own])
            worths.append(weight * self.worth[own])
        return np.bincount(np.concatenate(cells), np.concatenate(worths), len(starts) * n).reshape(-1, n)

    def sentences(self, u: Units) -> np.ndarray:
        """A row for each sentence: the best value of its units."""
        out = np.zeros((len(u.text_of), len(self.landmarks)), np.float32)
        if len(u.starts):
            _, first, place = np.unique(tb.hashes(u.flat, u.starts, u.ends), return_index=True, return_inverse=True)
            values = self.values(*_packed(u.flat, u.starts[first], u.ends[first]))
            head = np.flatnonzero(np.r_[True, u.sentence[1:] != u.sentence[:-1]])
            cut = np.r_[head, len(place)]
            for k in range(0, len(head), 2000):
                a, b = cut[k], cut[min(k + 2000, len(head))]
                out[u.sentence[head[k : k + 2000]]] = np.maximum.reduceat(values[place[a:b]], head[k : k + 2000] - a, axis=0)
        return out


def _packed(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same units side by side."""
    size = ends - starts
    after = np.cumsum(size)
    return flat[np.arange(int(size.sum())) + np.repeat(starts - (after - size), size)], after - size, after


@dataclass
class ToxicityModel:
    """Landmarks, the machine's weights on kernel values, and the curve's on a document's measures, the last a constant."""

    kernel: Kernel | None
    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.kernel is None:
            return np.full(n, 1 / (1 + np.exp(-self.curve[-1])))
        u = units(data, offsets)
        margin = self.kernel.sentences(u).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(_measures(margin, u.text_of, n, self.bias) @ self.curve, -500, 500)))

    def scored(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """The kept columns of documents (text, ...), with score and predicted; no shuffle."""

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, offsets in tb.slices(batch.column("text"), SLICE):
                    s = self.score(data, offsets)
                    part = batch.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s), pa.array((s >= TOXIC).astype(np.int32))], [*keep, "score", "predicted"])

        frame = docs.select(*dict.fromkeys([*keep, "text"]))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
        return frame.mapInArrow(score, f"{schema}, score double, predicted int")

    @classmethod
    def fitted(cls, docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> ToxicityModel:
        rows = fit_rows(labels.where("toxic = 1"), "toxic", most)
        clean = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic = 0")
        rows = rows.union(fit_rows(clean, "toxic", most))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        own = texts.where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(rows), "doc_id")
        got = own.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()  # 2 * FIT_ROWS rows of FIT_BYTES at most
        got.sort(key=lambda r: r.doc_id)
        return fit([r.text for r in got], np.array([r.label for r in got], np.int64))


def _keys(u: Units) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(unit, hashed beginning) for each size of beginnings, and for whole units."""
    size = u.ends - u.starts
    for n in BEGINNINGS:
        own = np.flatnonzero(size >= n)
        yield own, tb.hashes(u.flat, u.starts[own], u.starts[own] + n)
    yield np.arange(len(size)), tb.hashes(u.flat, u.starts, u.ends)


def _cover(parts: list[Units], toxic: np.ndarray) -> np.ndarray:
    """Keys of a small set that covers the toxic texts (1) and hardly any clean one (0), sorted. Again and again the key is taken that
    tells most of the toxic texts that are left from all others. Texts count half as much with each key that they have."""
    rows, others = [], []  # (text, key, word) of toxic texts; keys of others
    for u in parts:
        text, whole = u.text_of[u.sentence], tb.hashes(u.flat, u.starts, u.ends)
        unit, key = (np.concatenate(x) for x in zip(*_keys(u), strict=True))
        first = np.unique(tb.mix(key + text[unit].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        unit, key = unit[first], key[first]
        bad, good = toxic[text[unit]] > 0, toxic[text[unit]] == 0
        rows.append((text[unit[bad]].astype(np.int32), key[bad], whole[unit[bad]]))
        others.append(key[good])
    of, key, word = (np.concatenate(x) for x in zip(*rows, strict=True))
    names, key, c1 = np.unique(key, return_inverse=True, return_counts=True)
    c0 = np.zeros(len(names))
    for x in others:
        at = np.minimum(np.searchsorted(names, x), max(len(names) - 1, 0))
        c0 += np.bincount(at[names[at] == x], minlength=len(names)) if len(names) else 0
    n1, n0 = int((toxic > 0).sum()), int((toxic == 0).sum())
    tells = np.where(c1 > 1, np.maximum(np.log((c1 / n1) / ((c0 + 0.5) / n0 + c1 / n1)) + LENIENT, 0), 0)
    own = tells[key] > 0
    of, word, key = of[own], word[own], key[own]
    weight, chosen = np.ones(len(toxic)), []
    while len(of) and len(chosen) < LANDMARKS:
        best = int(np.argmax(np.bincount(key, weight[of], len(names)) * tells))
        hit = key == best
        if weight[of[hit]].sum() < max(2, n1 / 1000):
            break
        chosen.append(best)
        weight[of[hit]] /= 2
        left = ~np.isin(word, word[hit])
        of, word, key = of[left], word[left], key[left]
    return np.sort(names[chosen])


def _stem(words: list[bytes]) -> bytes:
    """The longest beginning of the commonest word that a share of all words has."""
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    best = min(counts, key=lambda w: (-counts[w], w))
    n = len(best)
    while n > 5 and sum(c for w, c in counts.items() if w.startswith(best[:n])) < STEM * len(words):
        n -= 1
    return best[:n]


def _inserted(words: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """The words with a byte inserted."""
    out = []
    for w in words:
        at = int(rng.integers(2, len(w) - 1))
        out.append(w[:at] + bytes([rng.choice(list(b"-*_.x"))]) + w[at:])
    return out


def _machine(x: np.ndarray, y: np.ndarray, count: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine on rows that count so often, with squared hinge loss and ten times the weight on clean rows, by Newton's method."""
    z = np.c_[x, np.ones(len(x))]
    weight = count * np.where(y > 0, cost / max(count[y > 0].sum(), 1), 10 * cost / max(count[y < 0].sum(), 1)) * 1000
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.ones(x.shape[1]), 1e-6]

    def loss(v: np.ndarray) -> float:
        return float((ridge * v * v).sum() / 2 + (weight * np.maximum(0, 1 - y * (z @ v)) ** 2).sum())

    for _ in range(30):
        gap = np.maximum(0, 1 - y * (z @ w))
        on = gap > 0
        step = np.linalg.solve(np.diag(ridge) + 2 * (z[on].T * weight[on]) @ z[on], ridge * w - 2 * z[on].T @ (weight * gap * y)[on])
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _measures(margin: np.ndarray, text_of: np.ndarray, n: int, bias: float) -> np.ndarray:
    """For each of n texts the margins of its worst sentences (that of an empty one where it has fewer), the logarithm of how many it has, and 1."""
    count = np.bincount(text_of, minlength=n)
    order = np.lexsort((-margin, text_of))
    place = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    worst = np.full((n, WORST), bias)
    first = place < WORST
    worst[text_of[order][first], place[first]] = margin[order][first]
    return np.c_[np.clip(worst, -FAR, FAR), np.log(count), np.ones(n)]


def _curve(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve on measures, with labels drawn in a little."""
    ones = (y > 0).sum()
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    ridge = np.r_[np.full(z.shape[1] - 1, RIDGE), 1e-6]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + np.diag(ridge), z.T @ (p - t) + ridge * w)
        w -= step * min(1, 2 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], toxic: np.ndarray) -> ToxicityModel:
    """Fit on labelled documents."""
    share = float(toxic.mean()) if len(toxic) else 0.5
    constant = ToxicityModel(None, np.zeros(0), 0.0, np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6))]))
    if len(toxic) < 10 or toxic.min() == toxic.max():
        return constant
    rng = np.random.default_rng(3)
    parts, begin = [], 0
    for i, j, data, at in tb.slices(pa.array(texts, pa.large_string()), SLICE):
        parts.append(units(data, at))
        parts[-1].text_of += i
        begin = j
    aside = rng.random(begin) < 0.2
    learned = np.where(aside, -1, toxic)
    cover = _cover(parts, learned)
    groups: dict[int, list[bytes]] = {k: [] for k in cover.tolist()}
    taken = []  # (part, sentence) of toxic units
    for u in parts:
        text, mine = u.text_of[u.sentence], np.zeros(len(u.text_of), bool)
        for unit, key in _keys(u):
            own = np.flatnonzero(np.isin(key, cover) & (learned[text[unit]] > 0))
            mine[u.sentence[unit[own]]] = True
            for k in own.tolist():
                groups[int(key[k])].append(u.flat[u.starts[unit[k]] : u.ends[unit[k]]].tobytes())
        taken.append(mine)
    groups = {k: g for k, g in groups.items() if g}
    if not groups:
        return constant
    kernel = Kernel(list(dict.fromkeys(map(_stem, groups.values()))))
    values = np.concatenate([kernel.sentences(u) for u in parts])
    text_of = np.concatenate([u.text_of for u in parts])
    covered = np.flatnonzero(np.concatenate(taken))
    del parts

    extra = _inserted(sorted(w for g in groups.values() for w in g), rng)
    ends = np.cumsum([len(w) for w in extra])
    extra_values = kernel.values(np.frombuffer(b"".join(extra), np.uint8), ends - [len(w) for w in extra], ends)
    root, vectors = np.linalg.eigh(kernel.own)
    whiten = vectors / np.sqrt(np.maximum(root, 0.05)) @ vectors.T
    clean = (toxic[text_of] == 0) & ~aside[text_of]
    plain = clean & (values.max(1) < FAINT)
    negative = np.flatnonzero(clean & ~plain)
    rest = np.flatnonzero((toxic[text_of] == 1) & ~aside[text_of] & ~np.isin(text_of, text_of[covered]))
    positive = covered
    for _ in range(3):
        x = np.concatenate([values[positive], extra_values, values[negative], np.zeros((1, values.shape[1]), np.float32)]) @ whiten
        y = np.r_[np.ones(len(positive) + len(extra)), -np.ones(len(negative) + 1)]
        w, bias = _machine(x, y, np.r_[np.ones(len(y) - 1), max(plain.sum(), 1)])
        weights = whiten @ w
        margin = values @ weights + bias
        order = rest[np.lexsort((-margin[rest], text_of[rest]))]
        found = order[np.r_[True, text_of[order][1:] != text_of[order][:-1]][: len(order)]]
        positive = np.r_[covered, found[margin[found] > 0]]
    measures = _measures(margin, text_of, len(texts), bias)
    held = aside if len(set(toxic[aside].tolist())) == 2 and aside.sum() >= 20 else ~aside
    return ToxicityModel(kernel, weights, bias, _curve(measures[held], toxic[held]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = ToxicityModel.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.scored(docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
