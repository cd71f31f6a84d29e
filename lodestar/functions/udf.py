"""Functions in Python that are built on first use, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas function with a DDL result type as a function of columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        made = cache(lambda: F.pandas_udf(f, kind))

        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return made()(*columns)

        del call.__wrapped__
        call.made = made
        return call

    return wrap


def rowwise(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function of one row with a DDL result type. Spark hands it 100 rows at a time, where an Arrow batch holds
    10,000: for whole payloads, so that a worker's memory does not grow with the rows of a task."""

    def wrap(f: Callable) -> Callable[..., Column]:
        made = cache(lambda: F.udf(f, kind, useArrow=False))

        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return made()(*columns)

        del call.__wrapped__
        call.made = made
        return call

    return wrap
