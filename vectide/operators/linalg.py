"""Small dense linear algebra: SVD, projections, residuals of chunks, random projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gram(points: DataFrame, vec: str = "vec") -> np.ndarray:
    """X'X over all rows: each task adds up its own, the partial sums are added in a tree of
    tasks, and one matrix comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    partial = points.select(vec).where(F.col(vec).isNotNull()).mapInArrow(run, "g binary")
    tasks = partial.rdd.getNumPartitions()
    while tasks > GRAM_FAN:
        tasks = -(-tasks // GRAM_FAN)
        partial = partial.repartition(tasks).mapInArrow(_added, "g binary")
    found = partial.coalesce(1).mapInArrow(_added, "g binary").collect()  # one row at most
    if not found:
        return np.zeros((0, 0))
    total = np.frombuffer(found[0].g)
    dim = int(round(len(total) ** 0.5))
    return total.reshape(dim, dim)


#: Partial sums that one task of the tree adds.
GRAM_FAN = 32


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for g in b.column(0):
            x = np.frombuffer(g.as_py())
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])


def svd(points: DataFrame, k: int, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as rows), largest first, at most k and the dimension.
    Signs are fixed: the largest entry of each vector is positive."""
    g = gram(points, vec)
    if not g.size:
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values)[:k]
    v = vectors[:, order].T
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    return np.sqrt(np.maximum(values[order], 0)), v


def orthogonal_projection(x: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(projection, absolute coefficients, residual norm) on the Gram-Schmidt basis; dependent vectors (< 1e-6) are skipped."""
    ortho: list[np.ndarray] = []
    for b in np.asarray(basis, float):
        r = b - sum(((b @ o) * o for o in ortho), np.zeros_like(b))
        n = np.linalg.norm(r)
        if n >= 1e-6:
            ortho.append(r / n)
    coef = np.array([x @ o for o in ortho])
    p = sum((c * o for c, o in zip(coef, ortho)), np.zeros_like(np.asarray(x, float)))
    return p, np.abs(coef), float(np.linalg.norm(x - p))


def intrinsic_residuals(chunks: DataFrame, dim: int, rank: int = 8, most: int = 100, least: int = 3, salt_rows: int = 20_000) -> DataFrame:
    """``id, residual, residual_raw, neighbors``: what a chunk's vector keeps beside the
    first ``rank`` directions of (at most ``most``) other chunks of its file, scaled to
    [0.5, 2] over all rows (all equal: 1).

    ``chunks`` has (id, file_id, vec). The neighbours are the file's smallest ids, so a
    file of any size sends only ``most`` + 1 rows to each block of its own rows. Files
    with fewer than ``least`` others give no row; nulls and other lengths drop out.
    """
    from vectide.shared import stored

    rows = stored(chunks.where((F.size("vec") == dim) & F.col("file_id").isNotNull()).select("id", "file_id", "vec").dropDuplicates(["id"]), "residual-rows")
    heads = rows.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy("id"))).where(F.col("r") <= most + 1).select("file_id", F.col("id").alias("nid"), F.col("vec").alias("nvec"))
    blocks = rows.groupBy("file_id").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("blocks"))
    left = rows.join(blocks, "file_id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).select("file_id", F.col("block").alias("part"), "id", "vec")
    right = heads.join(blocks, "file_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.col("file_id").alias("fid"), "block", "nid", "nvec")

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("nid")
        ids, x = b.nid.to_numpy(), np.stack(b.nvec.to_list()).astype(float) if len(b) else np.zeros((0, dim))
        out, shared = [], None
        for i, v in zip(a.id, a.vec):
            inside = (ids == i).any()
            if inside:
                near = x[ids != i][:most]
            else:
                near = x[:most]
            if len(near) < least:
                continue
            if inside or shared is None:
                vt = np.linalg.svd(near, full_matrices=False)[2][: min(rank, len(near), dim)]
                if not inside:
                    shared = vt
            else:
                vt = shared
            v = np.asarray(v, float)
            out.append((i, float(np.linalg.norm(v - vt.T @ (vt @ v))), len(near)))
        return pd.DataFrame(out, columns=["id", "residual_raw", "neighbors"])

    raw = left.groupBy("file_id", "part").cogroup(right.groupBy("fid", "block")).applyInPandas(work, "id bigint, residual_raw double, neighbors bigint")
    raw = stored(raw, "residuals")
    ends = raw.agg(F.min("residual_raw").alias("lo"), F.max("residual_raw").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return raw.join(F.broadcast(ends)).select("id", F.when(span > 1e-12, 0.5 + 1.5 * (F.col("residual_raw") - F.col("lo")) / span).otherwise(1.0).alias("residual"), "residual_raw", "neighbors")  # one row is broadcast


def mulberry32(seed: int):
    """The 32-bit generator that the random projection is seeded with."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t = (t ^ (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF))) & 0xFFFFFFFF
        yield (t ^ (t >> 14)) / 4294967296.0


def projection_matrix(dim: int, out: int, seed: int = 42) -> np.ndarray:
    """Gaussian (Box-Muller), scaled by 1/sqrt(out)."""
    g = mulberry32(seed)
    draws = np.empty(dim * out)
    for i in range(len(draws)):
        u, v = next(g), next(g)
        draws[i] = np.sqrt(-2 * np.log(u + 1e-10)) * np.cos(2 * np.pi * v)
    return draws.reshape(out, dim) / np.sqrt(out)


def uniform_projections(heads: int, width: int, dim: int, seed: int = 42) -> np.ndarray:
    """heads x width x dim: rows of unit length, drawn evenly from -0.5 to 0.5 by a 32-bit
    linear congruential generator."""
    # Multiplier and increment of the generator.
    state, draws = seed, np.empty(heads * width * dim)
    for i in range(len(draws)):
        state = (state * 1664525 + 1013904223) % (1 << 32)
        draws[i] = state / 4294967295 - 0.5
    rows = draws.reshape(heads, width, dim)
    return rows / (np.linalg.norm(rows, axis=2, keepdims=True) + 1e-8)


def random_projection(points: DataFrame, dim: int, out: int = 16, seed: int = 42, unit: bool = True) -> DataFrame:
    """Adds ``projected``: the vector times a fixed random matrix, to unit length if asked."""
    matrix = projection_matrix(dim, out, seed)

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_list()).astype(float) @ matrix.T
        if unit:
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
        return pd.Series(list(x))

    return points.where(F.size("vec") == dim).withColumn("projected", project("vec"))
