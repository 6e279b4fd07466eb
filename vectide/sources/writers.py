"""Sinks: codebooks, codes, result lines, appends that resume."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Parquet with zstd; Spark's committer makes it visible as a whole."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def flat_codebook(book: DataFrame, path: str) -> None:
    """Little-endian f32 in order of subspace and centroid; written beside and renamed. A
    codebook has at most 65,536 rows, checked here; the file is the driver's."""
    rows = book.orderBy("subspace", "centroid").limit(65_537).collect()
    if len(rows) > 65_536:
        raise ValueError("a codebook has at most 65,536 centroids")
    with open(path + ".tmp", "wb") as f:
        for r in rows:
            f.write(np.asarray(r.vec, "<f4").tobytes())
    os.replace(path + ".tmp", path)


def read_flat_codebook(spark, path: str, parts: int, centroids: int, width: int) -> DataFrame:
    x = np.fromfile(path, "<f4").reshape(parts, centroids, width)
    rows = [(s, c, [float(v) for v in x[s, c]]) for s in range(parts) for c in range(centroids)]
    return spark.createDataFrame(rows, "subspace int, centroid int, vec array<float>")


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends rows whose key the table does not have yet: a stopped job goes on where it was."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
    new = df.dropDuplicates(key)
    if there:
        new = new.join(spark.read.parquet(path).select(*key), key, "left_anti")
    new.write.mode("append").option("compression", "zstd").parquet(path)


def points_of_clouds(clouds: DataFrame, path: str, first_id: int = 0) -> None:
    """Nested clouds as point rows with a running id from ``first_id`` per document order."""
    rows = clouds.select("doc_id", F.posexplode("points").alias("point_idx", "vec"))
    table(rows.withColumn("first_id", F.lit(first_id)), path)


def pq_store(book: DataFrame, codes: DataFrame, folder: str) -> None:
    """A codebook (subspace, centroid, vec) and codes (doc_id, point_idx, codes) side by side."""
    table(book, f"{folder}/codebook")
    table(codes, f"{folder}/codes")


def replaced(df: DataFrame, path: str) -> None:
    """The table at ``path`` written anew, even from itself: beside it first, then moved into
    its place. A reader sees the old rows or the new ones; a job that stops before the move leaves the old."""
    spark = df.sparkSession
    fresh = path.rstrip("/") + ".new"
    table(df, fresh)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm(path.rstrip("/") + ".old")
    fs.delete(old, True)
    if fs.exists(jvm(path)):
        fs.rename(jvm(path), old)
    fs.rename(jvm(fresh), jvm(path))
    fs.delete(old, True)
