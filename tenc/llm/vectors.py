"""What the operators on vectors share: which rows count, and vectors as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# A vector is normalised, or compared, in batches of so many rows.
BATCH_ROWS = 4096


def complete(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    unfit = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    )
    return F.coalesce(F.col(vector).isNotNull() & ~unfit, F.lit(False))


def as_matrix(values: pa.Array, width: int, kind: type) -> np.ndarray:
    """The rows of a list array as a matrix; short rows are filled up with zeros."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(kind)
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    result = np.zeros((len(sizes), width), kind)
    result[rows, places] = flat
    return result


def packed(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    raw = np.ascontiguousarray(matrix)
    size = raw.shape[1] * raw.itemsize
    offsets = pa.array(np.arange(len(raw) + 1) * size, pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, offsets.buffers()[1], pa.py_buffer(raw.tobytes())])


def unpacked(column, width: int, kind: str) -> np.ndarray:
    """The matrix that ``packed`` made rows of bytes from."""
    if not len(column):
        return np.zeros((0, width), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)
