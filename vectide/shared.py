"""Intermediate tables in the folder all executors share.

Long jobs cut their lineage by writing a table and reading it back. The folder
is ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a local
temporary folder is used. Tables are removed when the session's Python ends, those
of a loop by ``release`` as soon as their successor is written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: str | None = None
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    global _LOCAL
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="vectide-")
    return "file://" + _LOCAL


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other table has, dropped at exit."""
    path = f"{shared_root(spark)}/vectide/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once to the shared folder and read back: later readers
    neither recompute it nor depend on a single executor."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer partitions than there are; an input
    that fills the cluster stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def is_there(df: DataFrame) -> bool:
    """Whether the table behind a frame that ``stored`` gave still lies in the folder."""
    path = getattr(df, "_stored_at", None)
    if path is None:
        return False
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def release(df: DataFrame) -> None:
    """Removes the table behind a frame that ``stored`` gave; nothing may read it any more."""
    path = getattr(df, "_stored_at", None)
    if path is not None:
        _delete(df.sparkSession, path)
        _WRITTEN.remove((df.sparkSession, path))
        del df._stored_at


@atexit.register
def _drop_all() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            if path.startswith(("file:", "/")):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
