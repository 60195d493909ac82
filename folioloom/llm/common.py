"""Helpers shared by the corpus operators: intermediate tables, checked broadcasts, Arrow batches, text splitting."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folioloom.operators.tables import materialized as written
from folioloom.operators.tables import Scratch, scratch, small

__all__ = ["ascii_lower", "slices", "small", "word_count", "working", "written"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows, and about as many bytes of text, that a Python worker handles at once.
SLICE_ROWS, SLICE_BYTES = 512, 4 * 1024 * 1024


#: Settings under which operators run their own plans: batches to Python as small as slices(), which keeps what tasks hold
#: outside the heap small, and small results in few files, where Spark by default gives every core one.
WORKING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(SLICE_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(SLICE_BYTES),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}


@contextmanager
def working(spark: SparkSession) -> Iterator[Scratch]:
    """A scratch() in which plans run under WORKING; the session's own settings come back at the end. Partitioning that the
    session has been given explicitly stays as it is."""
    before = {name: spark.conf.get(name, None) for name in WORKING}
    try:
        for name, value in WORKING.items():
            if before[name] is None or ".arrow." in name:
                spark.conf.set(name, value)
        with scratch(spark) as tables:
            yield tables
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SLICE_ROWS rows or SLICE_BYTES bytes in the column `text`; what a worker makes of one part
    is bounded, whatever the session's batch size. Parts are copies, as casts lose the offsets of Arrow's own slices."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        part = np.arange(len(batch)) // SLICE_ROWS + size // SLICE_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if i < j:
                yield batch if j - i == len(batch) else batch.take(pa.array(range(i, j)))


def ascii_lower(word: Column) -> Column:
    """A-Z lower-cased and nothing else. For a word of ASCII alone lower() is the same and faster."""
    other = F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(other)


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
