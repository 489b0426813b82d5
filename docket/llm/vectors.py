"""Integer vectors: read from Arrow, kept as packed bytes, multiplied without rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MOST = 1 << 27  # of a component's size, so that a squared distance of 64 components fits a long


def finite(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values) of a list<double> array: the places of lists of exactly ``size`` components, none null or non-finite."""
    lengths = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (lengths == size))
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    good = np.isfinite(x).all(1)
    return rows[good], x[good]


def floors(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as int64; refuses components beyond MOST, whose products a long can't hold."""
    out = np.floor(scale * x)
    if out.size and np.abs(out).max() > MOST:
        raise ValueError(f"a vector component is beyond {MOST // scale}: its distances do not fit a long")
    return out.astype(np.int64)


def packed(x: np.ndarray) -> pa.Array:
    """One binary value a row, little-endian 32-bit."""
    size = x.shape[1] * 4
    offsets = np.arange(len(x) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, "<i4"))])


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    """What ``packed`` made, as int64."""
    if not len(column):
        return np.zeros((0, size), np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], "<i4", len(column) * size, int(ends[0])).reshape(-1, size).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as int64, exact: in floating point only where every partial sum stays below 2 ** 53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of a to all rows of b, as int64, exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if 4 * max(int(np.abs(a).max()), int(np.abs(b).max())) ** 2 * a.shape[1] < 1 << 53:
        return (a * a).sum(1)[:, None] - 2 * products(a, b) + (b * b).sum(1)[None]
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1)
