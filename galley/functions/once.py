"""Columns that are built once. Building a large Column costs thousands of calls between Python and the JVM, and a Column
belongs to no frame: the same rules over the next batch of documents can use it again."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext

#: Results kept of each builder.
KEPT = 32


def once[**P, R](build: Callable[P, R]) -> Callable[P, R]:
    """A builder that is called once for each Spark context and arguments, which must be hashable."""
    held: OrderedDict = OrderedDict()

    @wraps(build)
    def given(*args: P.args) -> R:
        key = (SparkContext._active_spark_context, *args)
        if key not in held:
            held[key] = build(*args)
            if len(held) > KEPT:
                held.popitem(last=False)
        held.move_to_end(key)
        return held[key]

    return given
