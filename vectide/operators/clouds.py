"""Clouds: documents as sets of vectors, long (one row a point) or nested (one row a document)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_point_index(df: DataFrame, doc: str, order: str, vector: str, dim: int | None = None) -> DataFrame:
    """``doc_id, point_idx, vec``: points numbered from 0 in order; null vectors, null
    documents and vectors of another length than ``dim`` are skipped."""
    ok = F.col(vector).isNotNull() & F.col(doc).isNotNull()
    if dim is not None:
        ok &= F.size(vector) == dim
    w = Window.partitionBy("doc_id").orderBy("__order")
    rows = df.where(ok).select(F.col(doc).alias("doc_id"), F.col(order).alias("__order"), F.col(vector).alias("vec"))
    return rows.withColumn("point_idx", (F.row_number().over(w) - 1).cast("int")).select("doc_id", "point_idx", "vec")


def nested(points: DataFrame) -> DataFrame:
    """``doc_id, points`` in order of ``point_idx``."""
    packed = points.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("point_idx", "vec"))).alias("p"))
    return packed.select("doc_id", F.transform("p", lambda x: x["vec"]).alias("points"))


def long_form(clouds: DataFrame) -> DataFrame:
    return clouds.select("doc_id", F.posexplode("points").alias("point_idx", "vec"))


def sizes(points: DataFrame, width: int = 4) -> DataFrame:
    """One row: documents, points and bytes of the numbers, ``width`` each."""
    return points.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("points"), F.coalesce(F.sum(F.size("vec").cast("bigint") * F.lit(width)), F.lit(0)).cast("bigint").alias("bytes"))


def _drawn(keys: list[str], seed: int) -> Column:
    """A hash that stands for a random number, the same wherever a row lies."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sampled(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """A seeded random sample of n rows without replacement, by their key: every task keeps
    n, nothing else moves. Fewer rows come back if there are fewer."""
    return df.orderBy(_drawn(keys, seed), *keys).limit(n)


#: Ways to choose a document's header points.
SELECTORS = ("max_norm", "random", "uniform", "first")


def header(points: DataFrame, n: int, how: str = "max_norm", seed: int = 0) -> DataFrame:
    """At most n points of every document (doc_id, point_idx, vec): those of the largest
    norms, a seeded random choice, evenly spaced ones or the first."""
    if how not in SELECTORS:
        raise ValueError(f"how is one of {SELECTORS}")
    if how == "first":
        return points.where(F.col("point_idx") < n)
    if how == "uniform":
        size = F.count("*").over(Window.partitionBy("doc_id"))
        rows = points.withColumn("__n", size)
        picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("__n") / n).cast("int"))
        return rows.where((F.col("__n") <= n) | F.array_contains(picks, F.col("point_idx"))).drop("__n")
    from vectide.functions.vectors import norm

    order = [F.desc(norm(F.col("vec")))] if how == "max_norm" else [_drawn(["doc_id", "point_idx"], seed)]
    return points.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order, "point_idx"))).where(F.col("__r") <= n).drop("__r")


def centroids(points: DataFrame, keys: tuple[str, ...] = ("doc_id",), vec: str = "vec") -> DataFrame:
    """Mean vector of each document: one partial aggregate a dimension, no Python."""
    parts = points.select(*keys, F.posexplode(vec).alias("i", "x"))
    means = parts.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    return packed.select(*keys, F.transform("p", lambda s: s["m"]).alias("centroid"))


def mean_of(points: Column, dim: int) -> Column:
    """Centroid of a nested cloud, in one expression."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(points, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.size(points))


def variance_of(points: Column, dim: int) -> Column:
    """Population variance of each dimension of a nested cloud."""

    def one(i: Column) -> Column:
        m = F.aggregate(points, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.size(points)
        return F.aggregate(points, F.lit(0.0), lambda s, v: s + (F.get(v, i).cast("double") - m) * (F.get(v, i).cast("double") - m)) / F.size(points)

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)


def fid_scale(queries: DataFrame, docs: DataFrame, dim: int, spread: str = "variance") -> float:
    """Mean squared distance of the means by that of the variances (or standard deviations)
    over every pair of a query and a document, 1 where the latter is 0. Both means come
    from sums over either side alone; no pair is made."""

    def moments(side: DataFrame) -> list:
        m, v = mean_of(F.col("points"), dim), variance_of(F.col("points"), dim)
        rows = side.where("size(points) > 0").select(m.alias("m"), (F.transform(v, F.sqrt) if spread == "std" else v).alias("v"))
        return rows.select([F.avg(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in "mv" for i in range(dim)] + [F.avg(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)).alias(f"{c}_all") for c in "mv"]).first()

    a, b = moments(queries), moments(docs)
    if a["m_all"] is None or b["m_all"] is None:
        return 1.0
    apart = [a[f"{c}_all"] + b[f"{c}_all"] - 2 * sum(a[f"{c}{i}"] * b[f"{c}{i}"] for i in range(dim)) for c in "mv"]
    return apart[0] / (apart[1] or 1.0)


def arrow_clouds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Points of all clouds of an Arrow column as one matrix, and where each begins."""
    sizes = np.diff(column.offsets.to_numpy())
    vectors = column.flatten()
    count = int(sizes.sum())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    return flat.reshape(count, -1) if count else flat.reshape(0, 1), starts
