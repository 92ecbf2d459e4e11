"""What the operators on embeddings share: integer vectors, their arrays in Arrow batches, exact products and distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components scale to integers of this many bits at most; products and squares of all dimensions then stay within a long.
SCALE, MOST = 256, 1 << 24


def usable(vector: str) -> Column:
    """Not null, and no null, NaN or infinite component."""
    x = F.col(vector)
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))


def scaled(vector: str) -> Column:
    """floor(256 * x) of each component as integers; a component that leaves MOST is an error."""
    too_large = F.raise_error(F.lit(f"a component of {MOST // SCALE} or more: sums would leave 64 bits")).cast("int")
    return F.transform(F.col(vector), lambda v: F.when(F.abs(v.cast("double")) < MOST // SCALE, F.floor(v.cast("double") * SCALE).cast("int")).otherwise(too_large))


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id long, label int, v array<int>, of the rows with a usable vector."""
    return df.filter(usable(vec_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), scaled(vec_col).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix; shorter rows are filled up with zeros."""
    ends = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    if (sizes == width).all():
        return flat[ends[0] : ends[-1]].reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        out[k, : b - a] = flat[a:b]
    return out


def packed(x: np.ndarray) -> bytes:
    """Integers as two bytes each if they fit, else as four."""
    return x.astype("<i2" if not x.size or np.abs(x).max() < 1 << 15 else "<i4").tobytes()


def unpacked(raw: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * width * rows else "<i2").reshape(rows, width).astype(np.int64)


def squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centers, of integers; over floating point where all sums are exact there."""
    most = max([1, *(int(np.abs(a).max()) for a in (x, centers) if a.size)])
    kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < 1 << 52 else np.int64
    x, centers = x.astype(kind), centers.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(1)
