"""Arrow batches of bounded size, and workers that give memory back when a task ends.

Documents may be long, so batches are bounded by bytes: what a task holds at a time doesn't
depend on the length of the texts, save for a single text that is longer than a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Spark's bound of an Arrow batch in bytes, and the bound where the session sets none.
SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def give_back() -> None:
    """Return freed memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of bounded size."""
    if SETTING not in rows.sparkSession.conf.getAll:
        rows.sparkSession.conf.set(SETTING, BATCH_BYTES)

    def whole_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(whole_task, schema)
