"""Secret scans: patterns, and structure that decoded candidates confirm.

Three patterns give the base findings. Runs of base64, base64url or hex digits that are long enough are then decoded, and
only what their bytes confirm is reported:

- pem: an armoured private key whose body decodes to a key encoding, or says that it is encrypted; line breaks in it may
  be written out as \\n, as in JSON;
- jwt: three dotted base64url parts whose first decodes to a JSON object with an "alg" and second to a JSON object;
- key: base64 or hex whose bytes are a private key: nested ASN.1 elements whose lengths end where the outer one's does and
  whose types are those of a PKCS #1, PKCS #8 or SEC 1 key, or the magic and length-prefixed strings of an OpenSSH key;
  base64 may go over lines of 40 digits and more.

Texts are read one by one, so memory is bounded by the longest, and time is linear in it. Spans are code points, the end
exclusive.

Defined cases: a null or empty text has no findings; an empty table gives an empty one; very long texts are read whole. Findings of one kind never overlap; those of different kinds may, and
all are listed, by start and then in the order of KINDS. Repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: All kinds, in the order in which findings with the same start are listed. The first three are patterns.
KINDS = ("assign", "access", "hex", "pem", "jwt", "key")
#: Least characters: of an assigned value, an access key, a hex run, and a run that is decoded.
VALUE, ACCESS, HEX, DECODED = 12, 18, 16, 48

COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % DECODED)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{40,}(?:\r?\n|\\r?\\n|\\n))+[A-Za-z0-9+/]+={0,2}")
_LINE = re.compile(r"(?:(?<=\\n)|(?<!\\))[A-Za-z0-9+/]+={0,2}")
_BREAK = re.compile(r"\s+|\\r|\\n")
_PEM = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")


def _elements(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the ASN.1 elements that fill a range, or None if they don't."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(raw[at : at + n], "big"), at + n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def private_key(raw: bytes) -> bool:
    """Whether bytes are the encoding of a private key."""
    if raw.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, key derivation and its options
            if at + 4 > len(raw):
                return False
            at += 4 + int.from_bytes(raw[at : at + 4], "big")
        return at + 4 <= len(raw) and 1 <= int.from_bytes(raw[at : at + 4], "big") <= 64
    outer = _elements(raw, 0, len(raw))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = _elements(raw, *outer[0][1:])
    if not inner or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    version, tags = raw[inner[0][1]], [x[0] for x in inner]
    if version <= 1 and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # PKCS #1: nine integers
    if version <= 1 and tags[1:3] == [0x30, 0x04]:
        name = _elements(raw, *inner[1][1:])
        return bool(name) and name[0][0] == 0x06  # PKCS #8: an algorithm's identifier, then octets
    return version == 1 and tags[1:2] == [0x04] and inner[1][2] - inner[1][1] >= 16  # SEC 1


def decoded(run: str) -> list[bytes]:
    """What a run can stand for, as hex, base64 or base64url."""
    out = []
    if len(run) % 2 == 0:
        try:
            out.append(binascii.unhexlify(run))
        except ValueError:
            pass
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 != 1:
        try:
            out.append(base64.b64decode(body + "=" * (-len(body) % 4), validate=True))
        except ValueError:
            pass
    return out


def _object(part: str) -> dict | None:
    try:
        value = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def armoured(text: str) -> Iterator[tuple[int, str, str, int]]:
    """(start, name, body without breaks, end) of armoured keys. An armour ends at the mark that follows its own beginning;
    one that another beginning or another name's end follows is not closed. So each character is in one body at most."""
    begun = None
    for m in _PEM.finditer(text):
        if m[1] == "END" and begun is not None and begun[2] == m[2]:
            yield begun.start(), m[2], _BREAK.sub("", text[begun.end() : m.start()]), m.end()
        begun = m if m[1] == "BEGIN" else None


def wrapped(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what may be a key over lines: lines of one width, with the shorter one that follows and without it."""
    for m in _WRAPPED.finditer(text):
        lines = [(x.start() + m.start(), x.end() + m.start()) for x in _LINE.finditer(m[0])]
        at = 0
        while at < len(lines):
            width, k = lines[at][1] - lines[at][0], at + 1
            while k < len(lines) and lines[k][1] - lines[k][0] == width:
                k += 1
            if k < len(lines) and lines[k][1] - lines[k][0] < width:
                yield lines[at][0], lines[k][1]
            if k - at > 1:
                yield lines[at][0], lines[k - 1][1]
            at = k


def findings(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [(a, 3, b) for a, name, body, b in armoured(text) if "ENCRYPTED" in name or "Proc-Type:4,ENCRYPTED" in body or any(map(private_key, decoded(body)))]
    if "ey" in text and "." in text:
        for m in _JWT.finditer(text):
            head = _object(m[1]) if m[1].startswith("e") else None
            if head and isinstance(head.get("alg"), str) and _object(m[2]) is not None:
                out.append((m.start(), 4, m.end()))
    keys = [(a, 5, b) for a, b in wrapped(text) if any(map(private_key, decoded(_BREAK.sub("", text[a:b]))))]
    keys = [x for i, x in enumerate(keys) if i == 0 or x[0] >= keys[i - 1][2]]
    begins = [a for a, *_ in keys]
    for m in _RUN.finditer(text):
        k = bisect(begins, m.start()) - 1
        if (k < 0 or m.start() >= keys[k][2]) and any(map(private_key, decoded(m[0]))):
            out.append((m.start(), 5, m.end()))
    return sorted(out + keys)


def redacted(text: str, found: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with a mark in place of each run of findings that overlap."""
    parts, at = [], 0
    for start, _, end in found:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scanner(keep: list[str], redact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that adds COLUMNS, and the redacted text if asked for, to the columns kept."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            clean = []
            for value in batch.column("text"):
                text = value.as_py()
                found = findings(text or "")
                base = [x for x in found if x[1] < 3]
                row = *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)
                for held, x in zip(out, row, strict=True):
                    held.append(x)
                if redact:
                    clean.append(redacted(text, found) if found else text)
            arrays = [pa.array(x, t) for x, t in zip(out, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
            if redact:
                arrays.append(pa.array(clean, pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], [*keep, *(c.split()[0] for c in COLUMNS.split(", ")), *["redacted"] * redact])

    return scan


def scanned(docs: DataFrame, keep: list[str], redact: bool = False) -> DataFrame:
    """The kept columns of documents (text, ...), with COLUMNS; no shuffle."""
    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return frame.mapInArrow(scanner(keep, redact), f"{schema}, {COLUMNS}" + ", redacted string" * redact)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


QUERIES = {"op5_secrets": op5_secrets}
ORACLES: dict[str, str] = {}
