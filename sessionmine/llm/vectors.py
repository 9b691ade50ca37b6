"""Whole-number vectors for the vector operators: which rows count, and their components."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: str | Column) -> Column:
    """True for a vector without null, NaN or infinite components; never null."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def whole(vectors: pa.Array, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) of all components, a row for each vector.

    Squared distances of up to four times the largest square in all dimensions must fit in 64
    bits; a component beyond that has no exact answer and ends the job with an error.
    """
    x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(vectors), dims)
    most = isqrt(((1 << 63) - 1) // (4 * max(dims, 1)))
    if x.size and max(-x.min(), x.max()) > most:
        raise ValueError(f"a component beyond {most / scale:.6g} has no exact squared distance in 64 bits")
    return x.astype(np.int64)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(rows)
    at = np.arange(len(data) + 1, dtype=np.int32) * (data.itemsize * data.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(at), pa.py_buffer(data)])


def unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The matrix again."""
    if not len(column):
        return np.zeros((0, width), kind)
    _valid, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind).reshape(len(column), width)


def floored_means(sums: DataFrame, key: list[str], width: int) -> dict[tuple, list[int]]:
    """floor(sum / count) of each component by key, from the tasks' partial sums (`key`,
    `n`, `sums array<long>`). One row a key comes to the driver, so keys must be few by design."""
    exact = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    rows = sums.groupBy(*key).agg(F.sum("n").alias("n"), *exact).collect()
    return {tuple(r[k] for k in key): [int(r[f"s{j}"]) // r["n"] for j in range(width)] for r in rows}


def partial_sums(labels: np.ndarray, rows: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
    """Add the rows of each label to `total` and their number to `count`, in 64-bit integers."""
    order = np.argsort(labels, kind="stable")
    found, first, many = np.unique(labels[order], return_index=True, return_counts=True)
    total[found] += np.add.reduceat(rows[order], first, axis=0) if len(rows) else 0
    count[found] += many
