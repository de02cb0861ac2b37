"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in NumPy.

Words are runs of letters, of digits, or of other signs. Each counts under its lower-cased form, hashed to one of FORMS
rows, and under its shape (kind and length). Every row has a sparse random index vector; a row's word vector is the sum of
the index vectors of its neighbours over the whole corpus, two to each side, forms and shapes apart. These sums are
integers, added up by Spark from one partial table per task, so they don't depend on how rows are dealt. The table has a
fixed size (ROWS x DIM numbers, 2 MB) whatever the corpus, which is what makes sending it to every task safe.

A document is the mean vector of its forms beside that of its shapes. The network is fitted on at most FIT_ROWS labelled
rows outside the held-out fold, taken in the order of a hash of doc_id, and a temperature fitted on rows that it hasn't
seen turns its output into probabilities.

Defined cases: an empty table gives an empty one, and texts are read whole, however
long; a null, empty or blank text has the zero vector and so one score for all such texts. Without labels of both
kinds every score is the share of label 1, or 0.5 where there are none. A label that is null is ignored; a doc_id that is
labelled more than once has its largest label. A null doc_id isn't held out. Rows are scored one by one, so ties, repeated
rows and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import textbytes as tb

#: Rows for shapes and for forms, numbers in a vector, entries that are not zero in an index vector, neighbours to a side.
SHAPES, FORMS, DIM, ENTRIES, REACH = 128, 8064, 32, 2, 2
ROWS = SHAPES + FORMS
#: Labelled rows for the fit, and the fold that is never learned from.
FIT_ROWS, FOLDS, HELD_OUT = 20_000, 5, 0
#: Units of the hidden layer, passes over the rows, rows in a step.
HIDDEN, EPOCHS, STEP_ROWS = 24, 40, 256
#: Least score of a document that is kept.
KEEP = 0.3

_rng = np.random.default_rng(20240608)
_PLACE = _rng.integers(0, DIM, (ROWS, ENTRIES)).astype(np.int64)
_SIGN = _rng.choice([-1.0, 1.0], (ROWS, ENTRIES))
_CLASS = np.full(256, 3, np.int8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[range(48, 58)] = 2
_FOLD = tb.folding()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the form, row of the shape) of each word, and words before each text."""
    if data.size == 0:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    cuts = offsets[(offsets > 0) & (offsets < data.size)]
    before, after = np.r_[np.int8(0), kind[:-1]], np.r_[kind[1:], np.int8(0)]
    before[cuts] = 0
    after[cuts - 1] = 0
    starts, ends = np.flatnonzero((kind != before) & (kind > 0)), np.flatnonzero((kind != after) & (kind > 0)) + 1
    form = (tb.hashes(_FOLD[data], starts, ends) % np.uint64(FORMS)).astype(np.int64) + SHAPES
    capital = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
    n, large = ends - starts, capital[ends] - capital[starts]
    of = kind[starts].astype(np.int64)
    first = (data[starts] >= 65) & (data[starts] <= 90)
    letters = np.where(large == 0, 0, np.where((large == 1) & first, 1, np.where(large == n, 2, 3)))
    shape = np.where(of == 1, letters, of + 2) * 16 + np.minimum(n, 15)
    return form, shape, np.searchsorted(starts, offsets)


def neighbours(form: np.ndarray, shape: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors, by row."""
    out = np.zeros(ROWS * DIM)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for d in range(1, REACH + 1):
        same = np.flatnonzero(text[d:] == text[:-d])
        for row in (form, shape):
            a, b = row[same], row[same + d]
            for x, y in ((a, b), (b, a)):
                for k in range(ENTRIES):
                    out += np.bincount(x * DIM + _PLACE[y, k], _SIGN[y, k], ROWS * DIM)
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ROWS * DIM)
    for batch in batches:
        for *_, data, offsets in tb.slices(batch.column("text")):
            total += neighbours(*words(data, offsets))
    sums = total.reshape(ROWS, DIM).astype(np.int64)
    full = np.flatnonzero(sums.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(sums[full, k]) for k in range(DIM))], ["row", *(f"v{k}" for k in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors by row, from the neighbours of every word of every text."""
    parts = docs.select("text").mapInArrow(_gather, "row long, " + ", ".join(f"v{k} long" for k in range(DIM)))
    table = np.zeros((ROWS, DIM))
    for row, *values in parts.groupBy("row").agg(*(F.sum(f"v{k}") for k in range(DIM))).collect():  # ROWS rows at most
        table[row] = values
    norm = np.sqrt((table**2).sum(1, keepdims=True))
    return (table / np.maximum(norm, 1)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A vector for each text."""
    form, shape, at = words(data, offsets)
    n = np.diff(at)
    out = np.zeros((len(n), 2 * DIM), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        text = np.repeat(np.arange(len(n)), n)
        for k in range(0, len(full), 512):
            some = full[k : k + 512]
            a, b = at[some[0]], at[some[-1] + 1]
            out[some, :DIM] = np.add.reduceat(table[form[a:b]], at[some] - a, axis=0)
        counts = np.bincount(text * SHAPES + shape, minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
        out[:, DIM:] = counts @ table[:SHAPES]
        out[full] /= n[full, None]
    return out


@dataclass
class Network:
    """Two layers, with the scale of its inputs and the temperature of its output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def output(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(x.astype(np.float64)) / self.temperature, -500, 500)))


def _constant(width: int, share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit by Adam on four fifths of the rows, and the temperature on the rest."""
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return _constant(x.shape[1], float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(1)
    x = x.astype(np.float64)
    order = rng.permutation(len(y))
    rest, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-4
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z, p = (x - mean) / scale, ["w1", "b1", "w2", "b2"]
    m, v, t = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(max(EPOCHS, 3000 * STEP_ROWS // len(own) if len(own) < 20 * STEP_ROWS else EPOCHS)):
        rng.shuffle(own)
        rate = 0.01 * 0.95**min(epoch, 60)
        for k in range(0, len(own), STEP_ROWS):
            i = own[k : k + STEP_ROWS]
            h = np.tanh(z[i] @ net.w1 + net.b1)
            e = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -50, 50))) - y[i]) / len(i)
            back = e[:, None] * net.w2 * (1 - h**2)
            t += 1
            for name, g in zip(p, (z[i].T @ back + 1e-4 * net.w1, back.sum(0), h.T @ e + 1e-4 * net.w2, e.sum()), strict=True):
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g**2
                setattr(net, name, getattr(net, name) - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8))
    out, ones = net.output(x[rest]), y[rest].sum()
    soft = np.where(y[rest] > 0, (ones + 1) / (ones + 2), 1 / (len(rest) - ones + 2))  # else separable labels ask for certainty
    net.temperature = float(min(np.geomspace(0.25, 16, 73), key=lambda s: _loss(out / s, soft)))
    return net


def fold(doc_id: str = "doc_id") -> Column:
    """The fold of a row."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def fit_rows(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of at most so many labelled rows outside the held-out fold."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _pool(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tb.slices(batch.column("text")):
                rows = [x.tobytes() for x in pooled(data, offsets, table)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ("doc_id", "label")] + [pa.array(rows, pa.binary())], ["doc_id", "label", "vector"])

    return pool


class QualityModel:
    """Word vectors and the network; what is sent to tasks has a fixed size."""

    def __init__(self, table: np.ndarray, net: Network):
        self.table, self.net = table, net

    @classmethod
    def fitted(cls, docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> QualityModel:
        table = word_vectors(docs)
        rows = F.broadcast(fit_rows(labels, "quality", most))  # at most FIT_ROWS rows of 12 bytes
        got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(rows, "doc_id").select("doc_id", "label", "text")
        got = got.mapInArrow(_pool(table), "doc_id long, label int, vector binary")
        got = got.groupBy("doc_id", "label").agg(F.min("vector").alias("vector")).collect()  # at most FIT_ROWS vectors, one for each doc_id
        got.sort(key=lambda r: r.doc_id)
        x = np.array([np.frombuffer(r.vector, np.float32) for r in got], np.float32).reshape(len(got), 2 * DIM)
        return cls(table, fit(x, np.array([r.label for r in got], np.float64)))

    def scored(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """The kept columns of documents (text, ...), with score and predicted; no shuffle."""
        table, net = self.table, self.net

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, offsets in tb.slices(batch.column("text")):
                    s = net.score(pooled(data, offsets, table))
                    part = batch.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s), pa.array((s >= KEEP).astype(np.int32))], [*keep, "score", "predicted"])

        frame = docs.select(*dict.fromkeys([*keep, "text"]))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
        return frame.mapInArrow(score, f"{schema}, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = QualityModel.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.scored(docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
