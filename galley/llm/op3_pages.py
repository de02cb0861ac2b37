"""Main text of web pages by differencing with the page whose URL is nearest.

1. Each page is read into blocks of text. A block knows whether it lies in a part that its markup names as boilerplate
   (navigation, footers, adverts, forms, comments and so on), in a part that it names as the article, or in neither.
2. All pages are put in order of host and path by one range sort, so a large host is dealt over many tasks. Each page is
   paired with the neighbour on the same host that shares the longer path. Pages at the ends of a task's share are paired
   in a second pass over those few rows, so the pairs don't depend on how rows are dealt.
3. The blocks of a pair are aligned by longest common subsequence. Shared blocks that no markup claims as the article are
   deleted, as are those that markup names as boilerplate.

Shared blocks inside a named article stay, and pages that share all their text count as copies and lose nothing by it:
copies of an article on one host share its every line, and deleting those would empty both. Where a page names an
article, blocks outside it are left out; where none does, differencing decides alone.

Every page is paired, and every row comes from the join of a page's blocks with what differencing found. Only hashes of blocks
are sorted; the texts that move are those that may stay. Memory is bounded by three pages at a time. Defined cases: a null or empty html has an empty text. A null URL has no host
and no neighbour. Pages with equal host and path are ordered by page_id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.scratch import Scratch

#: What markup says of a block.
BOILERPLATE, PLAIN, ARTICLE = 0, 1, 2

_DROPPED = {"nav", "footer", "aside", "form", "dialog", "menu"}
_RAW = "script|style|title|template|noscript|iframe|svg|select|textarea|button|object|canvas"
#: Class and id names of boilerplate; those that stay boilerplate inside a named article, or on it; beginnings and
#: ends of names made of several words (`cookie-bar`, `site-header`), unless they tell a state (`with-sidebar`).
_COMMENTS_ADVERTS = set("comment comments comment-list respond disqus ad ads advert adverts advertisement sponsor sponsored".split())
_WORDS = _COMMENTS_ADVERTS | set("nav navbar navigation menu breadcrumb breadcrumbs masthead header footer sidebar banner promo cookie cookies consent notice newsletter subscribe signup share sharing social related popup modal skip".split())
_BEGINNINGS = set("ad ads advert cookie cookies newsletter promo sponsored social disqus".split())
_STATES = set("with has no without is".split())
_BODY = re.compile(r"(?:^|\s)(?:articlebody|article-body|article-content|post-content|post-body|entry-content|main-content|story-body)(?:$|\s)", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_CONTAINERS = _DROPPED | {"article", "main", "header", "section", "div", "ul", "ol", "table", "fieldset", "details", "body", "blockquote", "figure"}
_BLOCKS = _CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dl", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "hr", "pre", "address", "figcaption", "summary", "html", "head", "legend", "center"}
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _marks(names: str, words: set[str], parts: bool) -> bool:
    """Whether one of several names is one of the words, or, with parts, ends or begins with one."""
    for name in names.lower().split():
        own = re.split("[_-]+", name)
        if name in words or parts and own[0] not in _STATES and (own[-1] in words or own[0] in _BEGINNINGS):
            return True
    return False


def _named(tag: str, rest: str, zone: int) -> int:
    """The zone inside an element. Its name and role come before its class; inside an article only what names comments or
    adverts by a whole word is left out, besides elements that are never text."""
    if zone == BOILERPLATE or tag in _DROPPED or tag == "header" and zone != ARTICLE:
        return BOILERPLATE
    own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest.strip() else {}
    role = own.get("role", "").lower()
    if role in _ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true":
        return BOILERPLATE
    if _BODY.search(own.get("class", "")) or own.get("itemprop", "").lower() == "articlebody":
        return ARTICLE
    article = tag in {"article", "main"} or role in {"main", "article"}
    words, parts = (_COMMENTS_ADVERTS, False) if article or zone == ARTICLE else (_WORDS, True)
    if tag != "body" and any(_marks(own.get(k, ""), words, parts) for k in ("class", "id")):
        return BOILERPLATE
    return ARTICLE if article else zone


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page, in order; white space is one space, empty blocks are left out."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, held, at = PLAIN, [], 0

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((zone, text))
        held.clear()

    for m in _TOKEN.finditer(page):
        held.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag == "br":
            held.append(" ")
        if tag not in _BLOCKS:
            continue
        close()
        if tag not in _CONTAINERS or m["rest"].endswith("/"):
            continue
        if not m["close"]:
            stack.append((tag, zone))
            zone = _named(tag, m["rest"], zone)
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    zone = stack[k][1]
                    del stack[k:]
                    break
    held.append(page[at:])
    close()
    return out


def common(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def address(url: str | None) -> tuple[str, str]:
    """(host, path) without scheme, user, port, query or fragment; a null URL has neither."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url or "", re.I)
    return (m[1].lower(), m[2] or "/") if m else ("", "/")


def named(own: list[tuple[int, str]]) -> bool:
    """Whether a page's markup names its article."""
    return any(z == ARTICLE for z, _ in own)


def deleted(own: list, other: list | None) -> set[int]:
    """Places of a page's blocks that the nearest page shares; copies share nothing that counts."""
    return common(own, other) if other is not None and own != other else set()


def main_text(own: list[tuple[int, str]], gone: set[int]) -> str:
    """The text of a page's blocks, given the places of those that its nearest page shares. What differencing leaves is checked
    by markup: what it names as the article comes back, and where it names one, all else goes."""
    article = named(own)
    return "\n".join(t for i, (z, t) in enumerate(own) if (i not in gone or z == ARTICLE) and z >= (ARTICLE if article else PLAIN))


def candidates(own: list[tuple[int, str]]) -> list[str | None]:
    """Texts of the blocks that may stay, null for those that markup rules out whatever differencing finds."""
    least = ARTICLE if named(own) else PLAIN
    return [t if z >= least else None for z, t in own]


def _key(page_id: int | None, url: str | None, page: str | None) -> int:
    raw = f"{page_id}\0{url}\0{page}".encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pairing needs of each page: its address and a hash of each block."""
    names = ["page_id", "key", "host", "path", "blocks"]
    for batch in batches:
        for at in range(0, len(batch), 200):
            out: list[list] = [[] for _ in names]
            for page_id, url, page in _columns(batch.slice(at, 200)):
                own = blocks(page or "")
                raw = b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for _, t in own)
                for held, x in zip(out, (page_id, _key(page_id, url, page), *address(url), raw), strict=True):
                    held.append(x)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The zones of each page's blocks, and the texts of those that may stay."""
    names = ["page_id", "url", "key", "zones", "lines"]
    for batch in batches:
        for at in range(0, len(batch), 200):
            out: list[list] = [[] for _ in names]
            for page_id, url, page in _columns(batch.slice(at, 200)):
                own = blocks(page or "")
                for held, x in zip(out, (page_id, url, _key(page_id, url, page), bytes(z for z, _ in own), candidates(own)), strict=True):
                    held.append(x)
            types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)


def _nearest(before: tuple | None, now: tuple, after: tuple | None) -> list | None:
    """The blocks of the neighbour on the same host that shares the longer path; of two alike, the one before."""
    best = None
    for other in (before, after):
        if other is not None and other[2] == now[2] and now[2]:
            n = next((k for k, (x, y) in enumerate(zip(now[3], other[3], strict=False)) if x != y), min(len(now[3]), len(other[3])))
            if best is None or n > best[0]:
                best = n, other[5]
    return best[1] if best else None


def _parts(raw: bytes) -> list[bytes]:
    return [raw[i : i + 8] for i in range(0, len(raw), 8)]


def _judged(row: tuple, before: tuple | None, after: tuple | None) -> list[list]:
    """A row for a page, with the places of blocks to delete."""
    near = _nearest(before, row, after)
    gone = deleted(_parts(row[5]), None if near is None else _parts(near))
    return [[row[1], sorted(gone), *[None] * 6]]


_FIELDS = "key long, gone array<int>, share string, at long, page_id long, host string, path string, blocks binary"
_TYPES = [pa.int64(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], [f.split()[0] for f in _FIELDS.split(", ")])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(page_id, key, host, path, at, blocks) of pages; at is null where they haven't been handed on."""
    for batch in batches:
        own = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * len(batch) for c in ("page_id", "key", "host", "path", "at", "blocks")]
        yield from zip(*own, strict=True)


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge sorted pages. The first and last of a share lack a neighbour: they are handed on, each beside the neighbour that
    it has, with their place; at is even for those beside and odd for those to be judged."""
    share, window, n, out = "", [], 0, []

    def handed(row: tuple, to_judge: bool) -> list:
        return [row[1], None, share, 2 * n + to_judge, row[0], row[2], row[3], row[5]]

    for row in _pages(batches):
        window.append(row)
        n += 1
        if n == 1:
            share = f"{row[2]}\0{row[3]}\0{-1 if row[0] is None else row[0]:020d}\0{row[1]}"
            out.append(handed(row, True))
        elif n == 2:
            out.append(handed(row, False))
        else:
            out += _judged(window[1], window[0], window[2])
            window.pop(0)
        if len(out) >= 500:
            yield _batch(out)
            out = []
    if n > 1:
        out.append(handed(window[0], False))
        n += 1
        out.append(handed(window[1], True))
    yield _batch(out)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge what was handed on, in order of shares."""
    out, window = [], []
    for row in _pages(batches):
        window.append(row)
        if len(window) == 2 and window[0][4] % 2:
            out += _judged(window[0], None, window[1])
        if len(window) == 3:
            if window[1][4] % 2:
                out += _judged(window[1], window[0], window[2])
            window.pop(0)
    if window and window[-1][4] % 2:
        out += _judged(window[-1], window[-2] if len(window) > 1 else None, None)
    yield _batch(out)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("zones", "lines", "gone")), strict=True)
        texts = [main_text(list(zip(zones, lines, strict=True)), set(gone or ())) for zones, lines, gone in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def differences(pages: DataFrame) -> DataFrame:
    """(key, gone): the places of blocks that each page shares with the nearest page."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    read = pages.mapInArrow(_order, "page_id long, key long, host string, path string, blocks binary")
    by = ["host", "path", "page_id", "key"]
    read = scratch.table(read)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    judged = scratch.table(read.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_pair, _FIELDS))
    # Four rows a share at most, without texts, in one order: each page to judge stands beside its neighbours.
    ends = judged.where("at is not null").coalesce(1).sortWithinPartitions("share", "at").mapInArrow(_close, _FIELDS)
    return judged.where("at is null").union(ends).select("key", "gone").dropDuplicates(["key"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    read = pages.mapInArrow(_write, "page_id long, url string, key long, zones binary, lines array<string>")
    judged = read.join(differences(pages), "key", "left").select("page_id", "url", "zones", "lines", "gone")
    return judged.mapInArrow(_finish, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_pages": op3_pages}
ORACLES: dict[str, str] = {}
