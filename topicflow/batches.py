"""Arrow batches of bounded size: fewer rows in a batch, and a batch worked on piece by piece."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SPLITS = "spark.sql.files.minPartitionNum"
#: A batch of this many texts of 100 KB is 100 MB; the session's own setting holds again afterwards.
ROWS = 1000
#: List entries that are worked on at once: arrays of 2 MB each.
ENTRIES = 1 << 18


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """For jobs that run inside the block; a smaller setting of the session stays."""
    before = int(spark.conf.get(_KEY))
    spark.conf.set(_KEY, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_KEY, str(before))


@contextmanager
def split_scans(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Files that jobs inside the block read go to at least about ``tasks`` tasks, however few bytes they have."""
    before = spark.conf.get(_SPLITS, None)
    spark.conf.set(_SPLITS, str(tasks))
    try:
        yield
    finally:
        spark.conf.unset(_SPLITS) if before is None else spark.conf.set(_SPLITS, before)


def pieces(batches: Iterator[pa.RecordBatch], column: str, entries: int = ENTRIES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose lists in ``column`` have at most ``entries`` entries together (or one row)."""
    for batch in batches:
        offsets = np.asarray(batch.column(column).offsets)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + entries, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
