"""The comparison operators of rules. All are two-valued: a null value never gives null."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions import text as T


class PredicateError(ValueError):
    """An operator doesn't fit its value or attribute."""


def _known(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _member(actual: Column, value: Any) -> Column:
    if isinstance(value, str):
        return _known(F.contains(actual, F.lit(value)))
    if not isinstance(value, (list, tuple)):
        raise PredicateError(f"needs a list or a string, not {value!r}")
    some = [x for x in value if x is not None]
    found = _known(actual.isin(some)) if some else F.lit(False)
    return found | actual.isNull() if None in value else found


def _text_only(f: Callable[[Column], Column]) -> Callable[[Column, Any, str], Column]:
    def test(actual: Column, value: Any, kind: str) -> Column:
        if kind != "string":
            raise PredicateError(f"needs text, not {kind}")
        return f(actual)

    return test


def _found(actual: Column, value: Any, kind: str) -> Column:
    return T.matches(actual, value) if kind == "string" else F.lit(False)


def _any(actual: Column, value: Any, kind: str) -> Column:
    if kind == "string":
        return _known(actual != "")
    if kind == "boolean":
        return _known(actual)
    if kind.startswith(("array", "map")):
        return _known(F.size(actual) > 0)
    return actual.isNotNull() if kind.startswith("struct") else _known(actual != 0)


def _words(actual: Column, value: Any, kind: str) -> Column:
    if kind != "string":
        raise PredicateError(f"needs text, not {kind}")
    return F.coalesce(T.word_count(actual), F.lit(0)) <= value


#: By name: (attribute, value, Spark type of the attribute) to a test.
OPERATORS: dict[str, Callable[[Column, Any, str], Column]] = {
    "==": lambda a, v, kind: a.eqNullSafe(F.lit(v)),
    "!=": lambda a, v, kind: ~a.eqNullSafe(F.lit(v)),
    "<": lambda a, v, kind: _known(a < F.lit(v)),
    "<=": lambda a, v, kind: _known(a <= F.lit(v)),
    ">": lambda a, v, kind: _known(a > F.lit(v)),
    ">=": lambda a, v, kind: _known(a >= F.lit(v)),
    "in": lambda a, v, kind: _member(a, v),
    "not_in": lambda a, v, kind: ~_member(a, v),
    "matches_regex": _found,
    "not_matches_regex": lambda a, v, kind: ~_found(a, v, kind),
    "is_title_case": _text_only(T.is_title_case),
    "is_uppercase_literal": _text_only(T.is_upper_literal),
    "word_count_lte": _words,
    "is_non_empty": _any,
}
UNARY = {"is_title_case", "is_uppercase_literal", "is_non_empty"}


def predicate(operator: str, actual: Column, value: Any, kind: str) -> Column:
    """A test of an attribute of the given Spark type."""
    try:
        test = OPERATORS[operator]
    except KeyError:
        raise PredicateError(f"no operator {operator!r}") from None
    if operator in {"<", "<=", ">", ">="} and isinstance(value, str) != (kind == "string"):
        raise PredicateError(f"{operator} can't order {kind} and {value!r}")
    return test(actual, value, kind)
