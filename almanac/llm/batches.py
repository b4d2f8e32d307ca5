"""Slices of Arrow batches that hold a bounded amount of text, and workers that keep none of it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once; one longer text makes a slice of its own.
TEXT_BYTES = 4_000_000


def column_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = TEXT_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive rows of the batches with their column of texts, about ``size`` bytes of text at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate(([0], np.cumsum(lengths)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(before, before[start] + size, side="right")) - 1)
            part = batch.slice(start, end - start)
            yield part, column.slice(start, end - start)
            start = end


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = TEXT_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """As ``column_slices``, with the texts as a list."""
    for part, column in column_slices(batches, text, size):
        yield part, column.to_pylist()


def give_back() -> None:
    """Hand memory that was freed, but is still held for later use, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc: its C library has no such call


def leaving_nothing(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``step``, after which a worker gives back what it does not use.

    Spark keeps workers for later tasks; what an idle one holds is lost to the stages that run meanwhile.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run
