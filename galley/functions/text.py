"""Scalar functions on text as Column expressions, with the rule language's own notion of space, case and digits."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, for a character class of a Java pattern.
WS = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0  -     　"
#: Letters, digits and the underscore; and letters with case.
WORD = r"\p{L}\p{N}_"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"

#: Python's escapes outside and inside a character class.
_ESCAPES = {
    "s": (f"[{WS}]", WS), "S": (f"[^{WS}]", f"[^{WS}]"), "d": (r"\p{Nd}", r"\p{Nd}"), "D": (r"\P{Nd}", r"\P{Nd}"),
    "w": (f"[{WORD}]", WORD), "W": (f"[^{WORD}]", f"[^{WORD}]"), "Z": (r"\z", "Z"),
    "b": (f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))", r"\x08"),
    "B": (f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))", "B"),
}


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A Python pattern as a Java one that finds the same. Raises re.error where Python refuses it."""
    re.compile(pattern)
    out, i, inside = ["(?diu)" if ignore_case else "(?d)"], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1]
            out.append(_ESCAPES[nxt][inside] if nxt in _ESCAPES else c + nxt)
            i += 2
            continue
        if inside:
            if c == "]" and out[-1] not in {"[", "[^"}:
                inside = False
            elif c in "[&~" or c == "]":
                c = "\\" + c
            out.append(c)
        elif c == "[":
            inside = True
            out.append("[^" if pattern[i + 1 : i + 2] == "^" else "[")
            i += len(out[-1])
            continue
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(rf"\k<{pattern[i + 4 : end]}>")
            i = end + 1
            continue
        else:
            out.append(c)
        i += 1
    return "".join(out)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a Python pattern is found anywhere in a text; null counts as not."""
    return F.coalesce(F.rlike(text, F.lit(java_pattern(pattern, ignore_case))), F.lit(False))


#: White space but the space itself, one by one.
_OTHER_SPACE = "".join(c for c in map(chr, range(0x3001)) if c != " " and re.match(f"[{WS}]", c))


def word_count(text: Column) -> Column:
    """Runs of anything but white space. Texts are cut at spaces, which takes a fraction of a pattern's time; other white space
    is made spaces first where there is any."""
    words = lambda t: F.size(F.array_remove(F.split(t, " "), ""))
    other = reduce(or_, (F.contains(text, F.lit(c)) for c in _OTHER_SPACE))
    return F.when(other, words(F.translate(text, _OTHER_SPACE, " " * len(_OTHER_SPACE)))).when(text.isNotNull(), words(text)).cast("bigint")


def strip(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def non_blank(text: Column) -> Column:
    """Whether a text has anything but white space."""
    return F.coalesce(F.rlike(text, F.lit(f"[^{WS}]")), F.lit(False))


def is_title_case(text: Column) -> Column:
    """Whether capitals start all runs of letters with case and only those, and there is one."""
    found = F.rlike(text, F.lit(r"[\p{Lu}\p{Lt}]")) & ~F.rlike(text, F.lit(rf"(?<=[{CASED}])[\p{{Lu}}\p{{Lt}}]")) & ~F.rlike(text, F.lit(rf"(?<![{CASED}])\p{{Ll}}"))
    return F.coalesce(found, F.lit(False))


def is_upper_literal(text: Column) -> Column:
    """Whether a text has a letter A-Z of either case and is its own upper case."""
    return F.coalesce(F.rlike(text, F.lit("[A-Za-z]")) & (F.upper(text) == text), F.lit(False))


def is_keywords_line(text: Column) -> Column:
    """Whether a text begins with a word for keywords."""
    return F.rlike(F.lower(strip(text)), F.lit("^(keywords|key words|keyword)"))


#: What looks like a key of a service, and what stands in its place.
REDACTED = "<redacted>"
SECRET_PATTERNS = (r"AIza[0-9A-Za-z_\-]{35}",)


def redact(text: Column, literals: list[str] = (), patterns: list[str] = SECRET_PATTERNS) -> Column:
    """A text with known secrets and what looks like one replaced."""
    for x in [*map(re.escape, literals), *patterns]:
        text = F.regexp_replace(text, java_pattern(x), REDACTED)
    return text


def render(template: str, names: list[str], text: Column) -> Column:
    """A template with a text in place of each named placeholder."""
    out = F.lit(template)
    for name in names:
        out = F.replace(out, F.lit(f"{{{name}}}"), text)
    return out


def placeholders(text: Column) -> Column:
    """Placeholders that are left in a rendered template."""
    return F.regexp_extract_all(text, F.lit(r"(\{[A-Za-z_][A-Za-z0-9_]*\})"), 1)


def heading_text(text: Column) -> Column:
    """A heading to compare: lower case, no enumeration before, no colon after, single spaces. Callers that need NFKC and
    full case folding apply folded() first."""
    text = strip(F.lower(text))
    text = F.regexp_replace(text, rf"^[{WS}]*(?:\p{{Nd}}+|[ivxlcdm]+|[a-z])[.)][{WS}]+", "")
    text = strip(F.regexp_replace(text, r":+\z", ""))
    return F.regexp_replace(text, f"[{WS}]+", " ")


def utc_timestamp(when: Column) -> Column:
    """A timestamp as UTC text, to the second."""
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def python_repr(value: Column, kind: str) -> Column:
    """A value as Python shows it: 'string', 9.0, True, None."""
    if kind == "string":
        escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), "\n", r"\\n")
        quoted = F.when(F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"')), F.concat(F.lit('"'), escaped, F.lit('"')))
        shown = F.coalesce(quoted, F.concat(F.lit("'"), F.regexp_replace(escaped, "'", r"\\'"), F.lit("'")))
    elif kind == "boolean":
        shown = F.initcap(value.cast("string"))
    elif kind.startswith("array"):
        shown = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit("None"))
