"""What keeps a Python worker's memory apart from its input's size: small batches, and memory that is given back."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch that a Python worker gets at once, whichever is reached first: texts and blocks can be long.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function over a task's batches, that returns its freed memory to the system at the task's end.

    Workers outlive their tasks, and allocators keep what a task has freed unless they are asked.
    """

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim is not None:
            trim(0)

    return inner
