"""Pandas UDFs that are built on first use, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps
from inspect import isgenerator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows, and characters or bytes of texts, that a slice of a batch has at most (a single row may have more).
ROWS, SIZE = 512, 1 << 18


def slices(columns: tuple[pd.Series, ...]) -> Iterator[tuple[pd.Series, ...]]:
    """A batch's columns in slices of bounded rows and size."""
    start = size = 0
    n = len(columns[0])
    texts = [c for c in columns if c.dtype == object]
    for i in range(n):
        more = sum(len(x) for c in texts if isinstance(x := c.iat[i], (str, bytes, bytearray)))
        if i > start and (i - start == ROWS or size + more > SIZE):
            yield tuple(c.iloc[start:i].reset_index(drop=True) for c in columns)
            start, size = i, 0
        size += more
    if n > start:
        yield tuple(c.iloc[start:].reset_index(drop=True) for c in columns)


def batch_udf(kind: str) -> Callable:
    """Like ``pandas_udf``, with its result's type as DDL.

    The function gets slices of Arrow batches, and may yield a slice's result in parts: what it
    made leaves the worker before the next is made, so memory doesn't grow with a batch's rows.
    """

    def wrap(f: Callable) -> Callable[..., Column]:
        def sliced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                for part in slices(batch if isinstance(batch, tuple) else (batch,)):
                    made = f(*part)
                    yield from made if isgenerator(made) else (made,)

        @wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(sliced, kind)(*columns)

        return call

    return wrap
