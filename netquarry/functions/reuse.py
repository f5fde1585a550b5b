"""Column expressions made once."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(build: Callable) -> Callable:
    """``build``, whose columns are kept for the running application: making thousands of expressions takes seconds.

    Columns only name what they read, so they can be used on any table with those names.
    """
    held: dict = {}

    @wraps(build)
    def get():
        app = SparkContext.getOrCreate().applicationId
        if app not in held:
            held.clear()
            held[app] = build()
        return held[app]

    return get


_LITERALS: dict = {}


def literal(value: str | float | int, name: str) -> Column:
    """A named literal; the same Column each time in one application, as expressions of many literals take long to make."""
    key = (id(SparkContext._active_spark_context), type(value), value, name)
    if key not in _LITERALS:
        _LITERALS[key] = F.lit(value).alias(name)
    return _LITERALS[key]
