"""What keeps Python workers small: few texts a batch, and memory given back after each task.

A worker serves one task after another and keeps what the allocator holds; in a chain of stages the largest one would
count for all that follow.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts in one Arrow batch.
TEXT_ROWS = 1_000


def few_rows(docs: DataFrame, most: int = TEXT_ROWS) -> DataFrame:
    """The same frame in a session that sends Python at most so many rows at once; a smaller setting stays."""
    conf = docs.sparkSession.conf
    now = int(conf.get(_ROWS, "10000"))
    if now <= 0 or now > most:
        conf.set(_ROWS, str(most))
    return docs


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` for mapInArrow, giving memory back when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
