"""Usable vectors of a binary column, and a bounded tree that routes them to shards."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, id_col: str, vector: str, dim: int, dtype: str) -> DataFrame:
    """``id STRING, vec BINARY``: unit vectors as little-endian f32.

    A vector counts only if it has exactly ``dim`` numbers of ``dtype``
    (``<f4`` or ``<f2``), all finite and not all zero, and its id is not null.
    Rows given again stay; the callers group.
    """
    width = dim * np.dtype(dtype).itemsize
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector).alias("vec")).where(
        F.col("id").isNotNull() & (F.octet_length("vec") == width)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=dtype).reshape(-1, dim).astype(np.float64)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = x[ok]
            x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), as_binary(x)], names=["id", "vec"])

    return rows.mapInArrow(run, "id string, vec binary")


def as_binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary array of f32."""
    x = np.ascontiguousarray(x, dtype=np.float32)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4 if x.ndim == 2 else 0)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def as_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A binary column of f32 rows as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def principal(dev: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The direction in which centred rows spread most, by power iteration from the
    largest row: no matrix of the square of the dimension is made."""
    v = dev[np.einsum("nd,nd->n", dev, dev).argmax()].copy()
    for _ in range(rounds):
        norm = np.linalg.norm(v)
        if norm == 0:
            break
        v = (dev @ (v / norm)) @ dev
    norm = np.linalg.norm(v)
    return v / norm if norm > 0 else v


def two_means(x: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Splits unit vectors in two (True: second part), started on the principal direction."""
    side = (dev := x - x.mean(axis=0)) @ principal(dev) > 0
    for _ in range(rounds):
        if side.all() or not side.any():
            break
        c = np.stack([x[~side].mean(axis=0), x[side].mean(axis=0)])
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c /= np.where(norm > 0, norm, 1)
        s = x @ c.T
        new = s[:, 1] > s[:, 0]
        if (new == side).all():
            break
        side = new
    return side


def fit_cells(sample: np.ndarray, most: int, limit: int = 4096) -> np.ndarray:
    """Unit centres of cells with at most ``most`` sample rows, by repeated bisection
    of the one with the largest dispersion; no more than ``limit`` cells."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]), np.float32)
    todo, centres, made = [(0.0, 0, sample)], [], 0
    while todo:
        _, _, x = heapq.heappop(todo)
        if len(x) > most and len(todo) + len(centres) + 2 <= limit:
            side = two_means(x)
            if side.any() and not side.all():
                for part in (x[~side], x[side]):
                    made += 1
                    heapq.heappush(todo, (float(np.linalg.norm(part.sum(axis=0)) - len(part)), made, part))
                continue
        c = x.mean(axis=0)
        norm = np.linalg.norm(c)
        centres.append(c / norm if norm > 0 else x[0])
    return np.asarray(centres, dtype=np.float32)
