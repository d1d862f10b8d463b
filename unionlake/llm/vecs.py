"""Vector columns of DataFrames and Arrow batches, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer components stay below this, so that sums of squares of up to 256 differences are exact in 64 bits.
LARGEST = 1 << 27


def usable(vector: str) -> Column:
    """True if the vector and all of its components are there and finite."""
    return F.coalesce(F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter rows are filled up with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    whole = np.floor(values * scale)
    if whole.size and np.abs(whole).max() >= LARGEST:
        raise ValueError(f"a component times {scale} reaches {LARGEST}: squared distances would not be exact in 64 bits")
    return whole.astype(np.int64)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] if values.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def packed(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    raw = np.ascontiguousarray(values)
    return pa.array([r.tobytes() for r in raw], pa.binary())


def unpacked(column: pa.Array, kind, width: int) -> np.ndarray:
    """The matrix whose rows are equally long binary values."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, width), kind)
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width) if width else np.zeros((len(column), 0), kind)
