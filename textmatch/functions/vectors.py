"""Vector expressions.

Rows travel to Python as Arrow batches and are handled as one NumPy matrix per
batch. That measured 15 times faster than higher-order SQL functions, which Spark
interprets element by element. ``dot`` stays native for row-wise use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

SCORE_DIGITS = 6  # float32 accuracy; equal vectors tie exactly after rounding


def as_matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as one matrix, without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0), dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.size % rows or column.null_count:
        raise ValueError("vectors must not be null and must have one common length")
    return flat.reshape(rows, -1).astype(dtype, copy=False)


def as_lists(matrix: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """The reverse of :func:`as_matrix`."""
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), type=kind))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Divide rows by their length; a zero row stays zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _normalise(vectors: pa.Array) -> pa.Array:
    if len(vectors) == 0:
        return pa.array([], pa.list_(pa.float32()))
    return as_lists(unit_rows(as_matrix(vectors)).astype(np.float32))


def normalise(vector: Column) -> Column:
    """Unit-length float vector; a zero vector stays zero."""
    return arrow_udf(_normalise, T.ArrayType(T.FloatType()))(vector)


def to_float32(vector: Column) -> Column:
    return vector.cast("array<float>")


def round_values(vector: Column, digits: int = SCORE_DIGITS) -> Column:
    return F.transform(vector, lambda x: F.round(x.cast("double"), digits))


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision; the cosine of unit vectors."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def gather(sequence: Column, positions: Column) -> Column:
    """Elements of ``sequence`` at 0-based ``positions``."""
    return F.transform(positions, lambda p: F.element_at(sequence, p + 1))


def pad(values: Column, length: int, filler: Column) -> Column:
    """Fill up to ``length``; a longer array is an error."""
    missing = F.lit(length) - F.size(values)
    checked = F.when(missing < 0, F.raise_error(F.lit(f"more than {length} values"))).otherwise(missing)
    return F.concat(values, F.array_repeat(filler, checked.cast("int")))
