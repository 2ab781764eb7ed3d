"""Helpers shared by the operators: reading two columns of any table, slices of batches, bounded caches."""

from __future__ import annotations

import ctypes
import gc
from contextlib import suppress
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrow batches are cut to about this many bytes of text before Python objects are made of them.
SLICE_BYTES = 8 << 20


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that no other column can clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batch: pa.RecordBatch, text_col: str = "text", size: int = SLICE_BYTES):
    """Zero-copy pieces of a batch of about `size` bytes of text each; a single longer text is a piece by itself."""
    n = batch.num_rows
    if n == 0:
        return
    lengths = pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i in range(n):
        if held and held + lengths[i] > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(lengths[i])
    yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text_col: str = "text") -> list[str | None]:
    return batch.column(text_col).to_pylist()


def bytes_of(batch: pa.RecordBatch, text_col: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of the texts; null stays None."""
    return batch.column(text_col).cast(pa.binary()).to_pylist()


def release() -> None:
    """Give memory back to the system: Python workers live on after a task, and are many."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def frugal(over):
    """A function over batches that releases memory when its task ends."""

    @wraps(over)
    def run(batches):
        try:
            yield from over(batches)
        finally:
            release()

    return run


class Bounded(dict):
    """A cache that computes missing entries and starts anew when it is full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._make(key)
        return value
