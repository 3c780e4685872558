"""Walks Arrow batches of documents in slices of bounded size, and gives memory back after a task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20
#: Bytes of rows that are sent to a Python worker at a time.
BATCH_BYTES = 8 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same frame; from now on its session sends Python workers batches of bounded bytes, not only of
    bounded rows, unless the session has a smaller bound already."""
    conf = df.sparkSession.conf
    held = conf.get(_BYTES_SETTING, None)
    if held is None or not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(_BYTES_SETTING, str(BATCH_BYTES))
    return df


def frugal(task: Callable) -> Callable:
    """A task for mapInArrow that returns what its worker has freed: workers live on after a stage."""
    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library has it
                pass

    return run


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A column of strings; ``a.b`` is field b of the struct a."""
    outer, _, inner = column.partition(".")
    found = batch.column(outer)
    return pc.struct_field(found, inner).cast(pa.string()) if inner else found


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts hold about ``limit`` bytes; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(texts_of(batch, column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [t or "" for t in texts_of(batch, column).to_pylist()]
