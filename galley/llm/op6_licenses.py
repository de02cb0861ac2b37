"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures and places them.

Words are runs of letters and digits, lower-cased. Each template's GRAM-word hashes are winnowed (the least of every WINDOW
in a row) into an inverted index from hash to template and place. A document's grams are looked up there all at once. Hits of
one template near one diagonal are a piece; pieces that follow each other in text and template, with at most GAP words
of the text between them, are chained to a candidate, so that inserted runs of words don't part a license. The words around a
candidate are aligned with the whole template, in a band BAND words wider than its diagonals, and reported if COVERAGE of the
template's words match and both name the same license: the words of NAMES and the numbers behind them must be equal, one
by one. Of findings that overlap, that with the most matched words stays.

Templates are a parameter, sent to every task; their index takes about 24 bytes a word. Texts are read one by one and whole.

Defined cases: an empty table gives an empty one, and texts are read whole, however
long; a null or empty text has no findings. A template under GRAM words is found only as that whole run of words.
Ties go to the earlier span, then to the template's name. Repeated rows give repeated findings. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from galley.llm import textbytes as tb

#: Words in a gram, grams in a window, words off the diagonal that the alignment allows, words between hits of a candidate.
GRAM, WINDOW, BAND, GAP = 3, 2, 8, 40
#: Least share of a template's words that match.
COVERAGE = 0.8
#: Least share of a template's picked grams that a chain has; a text with COVERAGE keeps 0.4 of all grams at least.
HITS = 0.1
#: Words that name licenses. Numbers behind them, or behind the words of _BEFORE, are versions.
NAMES = """apache mit bsd isc gnu gpl gplv2 gplv3 lgpl agpl general lesser library affero public mozilla mpl eclipse epl boost zlib artistic
    cc cc0 by nc nd sa creative commons attribution noncommercial commercial noderivatives derivatives sharealike zero unlicense wtfpl"""
_BEFORE = "license licence version v"

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
        HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License
        as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. {0} is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."""

#: Notices that public licenses ask for or are commonly announced with.
TEMPLATES = {
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT statement": "Released under the MIT License",
    "MIT statement, licensed": "Licensed under the MIT License",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
        OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format("""Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. """),
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0 notice": _GPL.format("This program", "", 2),
    "GPL-3.0 notice": _GPL.format("This program", "", 3),
    "LGPL-2.1 notice": _GPL.format("This library", "Lesser ", "2.1"),
    "LGPL-3.0 notice": _GPL.format("This library", "Lesser ", 3),
    "AGPL-3.0 notice": _GPL.format("This program", "Affero ", 3),
    "MPL-2.0 notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 statement": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

_WORD = tb.table_of({*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)})
_FOLD = tb.folding()
_STEP = np.uint64(0x9E3779B97F4A7C15)

COLUMNS = "license string, start long, end long, matched long, coverage double"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, words before each text)."""
    starts, ends, at = tb.words(data, offsets, _WORD)
    return tb.hashes(_FOLD[data], starts, ends), starts, ends, at


def grams(word: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A hash for each run of so many words."""
    last = len(word) - n + 1
    if last <= 0:
        return word[:0]
    out = word[:last].copy()
    for j in range(1, n):
        out = out * _STEP + word[j : j + last]
    return tb.mix(out)


def winnow(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least of every so many values in a row, the rightmost of equal ones."""
    if len(values) <= window:
        return np.array([len(values) - 1 - int(np.argmin(values[::-1]))]) if len(values) else np.empty(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(values, window)[:, ::-1]
    return np.unique(np.arange(len(rows)) + window - 1 - np.argmin(rows, 1))


def named(words: str) -> np.ndarray:
    """Sorted hashes of words."""
    return np.unique(word_hashes(*tb.column_bytes(pa.array([words])))[0])


_NAMES, _LEADS, _NUMBERS = named(NAMES), named(f"{NAMES} {_BEFORE}"), named(" ".join(map(str, range(100))))


def naming(word: np.ndarray) -> np.ndarray:
    """The words that name a license and its version, in order."""
    number = np.isin(word, _NUMBERS)
    marked, lead = np.isin(word, _NAMES), np.isin(word, _LEADS)
    # a number is a version behind a leading word, or behind a version
    for i in np.flatnonzero(number).tolist():
        marked[i] = lead[i] = i > 0 and lead[i - 1]
    return word[marked]


class Index:
    """Templates and the inverted index of their winnowed grams: for each key, rows of (template, place)."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(templates)
        self.words: list[np.ndarray] = []
        keys, rows = [np.empty(0, np.uint64)], [np.empty((0, 2), np.int32)]
        for k, name in enumerate(self.names):
            word = word_hashes(*tb.column_bytes(pa.array([templates[name]])))[0]
            self.words.append(word)
            n = min(GRAM, len(word))
            own = grams(word, n) if n else word
            if n < GRAM:
                own = own + np.uint64(n)
            at = winnow(own)
            keys.append(own[at])
            rows.append(np.c_[np.full(len(at), k), at].astype(np.int32))
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.rows, self.at = row[order], np.r_[first, len(order)]
        self.picked = np.bincount(row[:, 0], minlength=len(self.words))
        self.naming = [naming(w) for w in self.words]
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < GRAM})

    def hits(self, word: np.ndarray) -> list[tuple[int, int]]:
        """(place, number of the key) of all words' grams in the index."""
        out = []
        for n in [GRAM, *self.short]:
            own = grams(word, n)
            if n < GRAM:
                own = own + np.uint64(n)
            if len(own) and len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
                found = np.flatnonzero(self.keys[at] == own)
                out += zip(found.tolist(), at[found].tolist(), strict=True)
        return out

    def places(self, key: int) -> list[list[int]]:
        """(template, place) of a key's grams."""
        return self.rows[self.at[key] : self.at[key + 1]].tolist()


_BITS = 21
_ALL = (1 << _BITS) - 1


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first and last matched place in the text) of the best alignment that keeps within a band of the
    diagonal (place in the text less place in the template); of equally good ones the earlier.

    A cell holds matched words, then how early the first and the last one are, as one number: a row of the table is a maximum
    of shifted rows. Places count from the first one that the band can reach.
    """
    base = max(0, diagonal - band)
    best = np.zeros(2 * band + 1, np.int64)
    for t, word in enumerate(template):
        at = np.arange(t + diagonal - band, t + diagonal + band + 1)
        inside = (at >= 0) & (at < len(text))
        now = best.copy()
        np.maximum(now[:-1], best[1:], out=now[:-1])  # a word of the template has no match
        match = np.flatnonzero(inside & (text[np.where(inside, at, 0)] == word)) if len(text) else at[:0]
        if len(match):
            old, early = best[match], _ALL - (at[match] - base)
            matched = old >> 2 * _BITS
            first = np.where(matched > 0, (old >> _BITS) & _ALL, early)
            now[match] = np.maximum(now[match], (matched + 1 << 2 * _BITS) | (first << _BITS) | early)
        best = np.maximum.accumulate(now)  # a word of the text has none
    top = int(best.max())
    return top >> 2 * _BITS, base + _ALL - ((top >> _BITS) & _ALL), base + _ALL - (top & _ALL)


def _candidates(hits: list[tuple[int, int, int]], index: Index) -> Iterator[tuple[int, int, int]]:
    """(template, diagonal, how far the diagonals spread) of chains of pieces; hits are (template, place in text, in template)."""
    groups: dict[int, list[tuple[int, int, int]]] = {}
    for k, i, p in hits:
        groups.setdefault(k, []).append((i - p, i, p))
    for k, own in sorted(groups.items()):
        own.sort()
        pieces, start = [], 0
        for j in range(1, len(own) + 1):
            if j == len(own) or own[j][0] - own[j - 1][0] > BAND // 2 or own[j][0] - own[start][0] > BAND:
                part = sorted((i, p) for _, i, p in own[start:j])
                begin = 0
                for m in range(1, len(part) + 1):
                    if m == len(part) or part[m][0] - part[m - 1][0] > GAP:
                        pieces.append(Piece(part[begin:m]))
                        begin = m
                start = j
        for low, high, n in chains(pieces):
            if n >= HITS * index.picked[k]:
                yield k, (low + high) // 2, (high - low + 1) // 2


class Piece:
    """Hits near one diagonal: first and last place in the text and in the template, least and largest diagonal, number."""

    def __init__(self, hits: list[tuple[int, int]]):
        (self.first, self.start), (self.last, self.end) = hits[0], hits[-1]
        self.low, self.high, self.n = min(i - p for i, p in hits), max(i - p for i, p in hits), len(hits)


def chains(pieces: list[Piece]) -> Iterator[tuple[int, int, int]]:
    """(least and largest diagonal, hits) of chains of pieces, those with the most hits first; each piece is in one."""
    pieces.sort(key=lambda x: (x.first, x.start))
    score, before, near = [x.n for x in pieces], [-1] * len(pieces), []
    for j, x in enumerate(pieces):
        near = [i for i in near if pieces[i].last >= x.first - GAP]
        ways = [i for i in near if pieces[i].first < x.first and pieces[i].last - GRAM < x.first and pieces[i].end - GRAM < x.start and pieces[i].start < x.start]
        if ways:
            before[j] = max(ways, key=lambda i: (score[i], i))
            score[j] += score[before[j]]
        near.append(j)
    used = [False] * len(pieces)
    for j in sorted(range(len(pieces)), key=lambda j: (-score[j], j)):
        own = []
        while j >= 0 and not used[j]:
            used[j] = True
            own.append(pieces[j])
            j = before[j]
        if own:
            yield min(x.low for x in own), max(x.high for x in own), sum(x.n for x in own)


def findings(word: np.ndarray, index: Index, hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first, last word) of the templates in a text, by place."""
    full = [(k, i, p) for i, key in hits for k, p in index.places(key)]
    found = set()
    for k, diagonal, spread in _candidates(full, index):
        template = index.words[k]
        matched, first, last = align(word, template, diagonal, BAND + spread)
        if matched >= COVERAGE * len(template) and np.array_equal(naming(word[first : last + 1]), index.naming[k]):
            found.add((k, matched, first, last))
    found = list(found)
    found.sort(key=lambda x: (-x[1], x[2], x[0]))
    taken: list[tuple[int, int, int, int]] = []
    for x in found:
        if all(x[3] < y[2] or x[2] > y[3] for y in taken):
            taken.append(x)
    return sorted(taken, key=lambda x: x[2])


def scanner(templates: Mapping[str, str], keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives a row for each finding: the kept columns and COLUMNS."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            rows, out = [], []
            for i, _, data, offsets in tb.slices(batch.column("text")):
                word, starts, ends, at = word_hashes(data, offsets)
                hits = index.hits(word)
                hits.sort()
                places = np.array([h[0] for h in hits], np.int64)
                text_of = np.searchsorted(at, places, "right") - 1
                cut = [*np.flatnonzero(np.r_[True, text_of[1:] != text_of[:-1]]).tolist(), len(hits)] if hits else []
                for a, b in zip(cut, cut[1:]):
                    t = int(text_of[a])
                    first = int(at[t])
                    own = word[first : int(at[t + 1])]
                    for k, matched, x, y in findings(own, index, [(p - first, key) for p, key in hits[a:b]]):
                        raw = data[offsets[t] : offsets[t + 1]]
                        begin, end = int(starts[first + x] - offsets[t]), int(ends[first + y] - offsets[t])
                        point = lambda n, raw=raw: int(((raw[:n] & 0xC0) != 0x80).sum())
                        rows.append(i + t)
                        out.append((index.names[k], point(begin), point(end), matched, matched / len(index.words[k])))
            taken = pa.array(rows, pa.int64())
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            arrays = [pa.array([r[c] for r in out], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in keep), *arrays], [*keep, *(c.split()[0] for c in COLUMNS.split(", "))])

    return scan


def licenses(docs: DataFrame, keep: list[str], templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """A row for each license found in documents (text, ...); no shuffle."""
    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return frame.mapInArrow(scanner({k: re.sub(r"\s+", " ", v) for k, v in templates.items()}, keep), f"{schema}, {COLUMNS}")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every document."""
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


QUERIES = {"op6_licenses": op6_licenses}
ORACLES: dict[str, str] = {}
