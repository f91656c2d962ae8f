"""Helpers over Arrow batches: UTF-8 bytes as numpy arrays, slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text handled at once; one longer text makes a slice of its own.  Arrays over its bytes take up to fifty times as much.
SLICE_BYTES = 1 << 20


def filled(column: pa.Array) -> pa.Array:
    """The column with null read as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows."""
    column = filled(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text of a slice stays near ``most`` bytes; at the end of the task Arrow gives free memory back."""
    try:
        yield from _cut(batches, name, most)
    finally:
        pa.default_memory_pool().release_unused()


def _cut(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def whole() -> Column:
    """All columns of a row as one, out of the way of every other name; ``row.*`` gives them back."""
    return F.struct("*").alias("row")


def row_ids() -> Iterator[int]:
    """Numbers for the rows of this task that no other partition gives; stable once they are written."""
    at = TaskContext.get().partitionId() << 33
    while True:
        yield at
        at += 1


def with_text(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``row``, and in ``text`` its field at ``place`` as a string: whole rows need not carry their text twice."""
    for b in batches:
        field = pc.struct_field(b.column("row"), [place])
        yield pa.RecordBatch.from_arrays([*b.columns, field if pa.types.is_string(field.type) or pa.types.is_large_string(field.type) else field.cast(pa.string())], names=[*b.schema.names, "text"])
