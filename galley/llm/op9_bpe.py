"""BPE encoding and decoding by tables of distinct words and of pieces.

A word here is a run of bytes other than ASCII white space. This tokenizer's rules never reach across white space, so a
word's ids don't depend on its neighbours. Texts are split by byte arithmetic over whole Arrow columns; each slice's
distinct words are encoded once, and their ids are joined back to every place where the word stands. Decoding joins the
ids with the table of pieces and concatenates, a space between pieces, as this tokenizer (which has no decoder) does.

The tables are joined inside each task. A join through a shuffle of all words by word would move a row for each of them,
many times the input's size, where the limit is one and a half times.

Defined cases: an empty table gives an empty one, and texts are read whole, however
long; a null, empty or blank text has no ids and decodes to an empty text. Strings of special tokens in a text
become their ids, as in the library. Rows are independent; repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from galley.llm import textbytes as tb

#: Bytes of text whose distinct words make one table.
TABLE_BYTES = 4 << 20
#: Distinct words in one call of the library.
CALL_WORDS = 20_000

COLUMNS = "n_tokens long, ids_sha256 string, decoded_sha256 string"

_WORD = tb.table_of(set(range(256)) - {0x20, *range(0x09, 0x0E)})


def vocabulary_path() -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each word has the bytes of the word whose number is given for it; hashes alone don't prove that."""
    size = ends - starts
    if not np.array_equal(size, size[like]):
        return False
    for a in range(0, len(starts), 1 << 16):
        n = size[a : a + (1 << 16)]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(data[at + np.repeat(starts[a : a + (1 << 16)], n)], data[at + np.repeat(starts[like[a : a + (1 << 16)]], n)]):
            return False
    return True


class Codec:
    """Distinct words to ids, and ids to pieces."""

    def __init__(self, path: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(known.values()) + 1)
        for piece, i in known.items():
            pieces[i] = piece.encode() + b" "
        self.pieces = pa.array(pieces, pa.large_binary())
        self.piece_sizes = np.array([len(p) for p in pieces], np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each)."""
        ids, sizes = [], []
        for k in range(0, len(words), CALL_WORDS):
            some = words[k : k + CALL_WORDS]
            done = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            own = np.array([-1 if w is None else w for w in done.word_ids], np.int64)
            ids.append(np.array(done.ids, np.uint32))
            if len(own) and own.min() < 0:  # special tokens don't name their word
                ids[-1], count = self._one_by_one(some)
                sizes.append(count)
            else:
                sizes.append(np.bincount(own, minlength=len(some)))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        done = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.array([i for x in done for i in x], np.uint32), np.array([len(x) for x in done], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's begin, with an end)."""
        starts, ends, at = tb.words(data, offsets, _WORD)
        if len(starts) == 0:
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        _, first, place = np.unique(tb.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if not same_words(data, starts, ends, first[place]):  # a collision: every place is its own word
            first = place = np.arange(len(starts))
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        ids, sizes = self.encode_words(words)
        begin = np.cumsum(sizes) - sizes
        count = sizes[place]
        ahead = np.cumsum(count) - count
        out = ids[np.arange(int(count.sum())) + np.repeat(begin[place] - ahead, count)]
        return out, np.r_[ahead, count.sum()][at]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(decoded bytes of all texts in turn, each with a space after it; where each text's begin, with an end)."""
        sizes = self.piece_sizes[ids]
        joined = self.pieces.take(pa.array(ids))
        text = joined.buffers()[2].to_pybytes() if len(ids) else b""
        return text, np.r_[0, np.cumsum(sizes)][at]


def coder(keep: list[str], with_ids: bool, path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that adds COLUMNS, and the ids themselves if asked for, to the columns kept."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for i, j, data, offsets in tb.slices(batch.column("text"), TABLE_BYTES):
                ids, at = codec.encode(data, offsets)
                text, where = codec.decode(ids, at)
                raw = ids.astype("<u4").tobytes()
                cut, back = at.tolist(), where.tolist()
                sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cut, cut[1:])]
                decoded = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(back, back[1:])]
                arrays = [pa.array(np.diff(at)), pa.array(sha, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *arrays], names)

    return code


def encoded(docs: DataFrame, keep: list[str], with_ids: bool = True, path: str | None = None) -> DataFrame:
    """The kept columns of documents (text, ...), with COLUMNS and token_ids; no shuffle."""
    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return frame.mapInArrow(coder(keep, with_ids, path), f"{schema}, {COLUMNS}" + ", token_ids array<int>" * with_ids)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and their round trip, as digests."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], with_ids=False)


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}
