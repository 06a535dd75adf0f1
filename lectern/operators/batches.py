"""Python steps over columns, a slice of a batch at a time, so that a task never holds a whole batch as Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and bytes of a slice; one row may be longer.
ROWS, BYTES = 512, 2 << 20


def slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of these columns in order, in slices within ROWS and BYTES."""
    todo = [columns]
    while todo:
        part = todo.pop()
        n = len(part[0])
        if n < 2 or n <= ROWS and sum(c.nbytes for c in part) <= BYTES:
            yield part
        else:
            todo += [tuple(c.slice(n // 2) for c in part), tuple(c.slice(0, n // 2) for c in part)]


def by_row(function: Callable, returns: str, kind: pa.DataType) -> Callable[..., Column]:
    """A column of this type (kind is the same to Arrow), function(*values) of each row."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for part in slices(columns if isinstance(columns, tuple) else (columns,)):
                yield pa.array([function(*row) for row in zip(*(c.to_pylist() for c in part), strict=True)], kind)

    return run
