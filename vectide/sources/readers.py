"""Readers of the formats that clouds, corpora and judgements come in."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.operators.clouds import with_point_index
from vectide.sources import schemas
from vectide.sources.blobs import decode_f16, decode_f32, decoded, reshape_f32

#: Names that an embedding column may have, in order of preference.
VECTOR_NAMES = ("embedding", "emb", "emb_fp16", "vector", "dense", "vec")


def cloud_points(chunks: DataFrame, dim: int) -> DataFrame:
    """Chunk rows as ``doc_id, point_idx, vec``; null and misfit vectors are skipped."""
    return with_point_index(decoded(chunks, "vector", dim), "file_id", "id", "vec", dim)


def sqlite_table(spark: SparkSession, path: str, name: str, columns: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that all executors can read, by ranges of rowid.

    With an SQLite driver on the class path the JDBC source does the same; this reads
    with Python's own library and pushes the column list and the range down."""
    if not name.isidentifier():
        raise ValueError(f"no table name: {name}")
    names = [c.split()[0] for c in columns.split(", ")]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{name}"').fetchone()
    step = max(1, -(-(high - low + 1) // parts))
    ranges = [(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]
    if not ranges:
        return spark.createDataFrame([], columns)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, b in zip(f.a, f.b):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    cursor = db.execute("select {} from \"{}\" where rowid between ? and ?".format(", ".join(f'"{n}"' for n in names), name), (int(a), int(b)))
                    while rows := cursor.fetchmany(4096):
                        yield pd.DataFrame(rows, columns=names)

    return spark.createDataFrame(ranges, "a long, b long").repartition(len(ranges)).mapInPandas(read, columns)


def fp16_store(spark: SparkSession, binary: str, index: str, dim: int) -> DataFrame:
    """``doc_id STRING, points`` of a flat f16 file and its JSON index
    {id: {offset, n_tokens}}; an entry beyond the file's end raises."""
    entries = spark.read.option("wholetext", True).text(index).select(F.explode(F.from_json("value", "map<string, struct<offset: bigint, n_tokens: bigint>>")).alias("doc_id", "e"))
    local = binary.removeprefix("file://")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = np.memmap(local, dtype=np.uint8, mode="r")
        for f in frames:
            out = []
            for o, n in zip(f.offset, f.n_tokens):
                end = int(o) + int(n) * dim * 2
                if o < 0 or end > len(data):
                    raise ValueError(f"entry of {n} vectors at {o} lies beyond the file's {len(data)} bytes")
                out.append(list(np.frombuffer(data[int(o) : end].tobytes(), "<f2").astype("<f4").reshape(int(n), dim)))
            yield pd.DataFrame({"doc_id": f.doc_id, "points": out})

    return entries.select("doc_id", F.col("e.offset").alias("offset"), F.col("e.n_tokens").alias("n_tokens")).repartition(spark.sparkContext.defaultParallelism, "doc_id").mapInPandas(read, "doc_id string, points array<array<float>>")


def corpus_lines(spark: SparkSession, path: str, schema: str = schemas.CORPUS) -> DataFrame:
    """JSON lines; lines that cannot be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def vector_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VECTOR_LINES).option("mode", "DROPMALFORMED").json(path)


def clouds_of_lines(lines: DataFrame, vector_fallback: bool = False) -> DataFrame:
    """``doc_id STRING, points`` of the sentences; without sentences a row is skipped, or
    (with one at most) its document vector is taken if ``vector_fallback``."""
    points = F.col("sentences")
    if vector_fallback:
        points = F.when(F.size("sentences") > 1, points).otherwise(F.when(F.col("vector").isNotNull(), F.array("vector")))
    return lines.select(F.col("_id").alias("doc_id"), points.alias("points")).where("size(points) > 0")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated judgements with a header; short lines are dropped."""
    raw = spark.read.option("sep", "\t").option("header", True).schema(schemas.QRELS).csv(path)
    return raw.where("query_id is not null and doc_id is not null and rel is not null")


def late_interaction(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id STRING, points`` of token blocks; blocks that do not fit n_tokens drop out."""
    rows = spark.read.parquet(path).select(F.col("id").alias("doc_id"), reshape_f32("token_emb", "n_tokens").alias("points"))
    return rows.where("points is not null")


def dense(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """``doc_id, vec`` of the first column with a known embedding name; binary is f16 if
    the name says so or the width fits f16 only."""
    raw = spark.read.parquet(path)
    kinds = dict(raw.dtypes)
    name = next((n for n in VECTOR_NAMES if n in kinds), None)
    if name is None:
        raise ValueError(f"none of {VECTOR_NAMES} in {raw.columns}")
    key = next(c for c in ("id", "_id", "doc_id", "vec_id", raw.columns[0]) if c in kinds)
    if kinds[name] == "binary":
        half = "16" in name
        rows = raw if dim is None else raw.where(F.octet_length(name) == dim * (2 if half else 4))
        vec = (decode_f16 if half else decode_f32)(name)
    else:
        rows, vec = raw, F.col(name).cast("array<float>")
    out = rows.select(F.col(key).alias("doc_id"), vec.alias("vec")).where("vec is not null")
    return out if dim is None else out.where(F.size("vec") == dim)


def recover(points: DataFrame, files: DataFrame, category: str | None) -> DataFrame:
    """Rebuilds an index table from stored vectors: joined with the files and filtered by category."""
    rows = points.join(files, points["file_id"] == files["id"], "left_semi" if category is None else "inner")
    return rows if category is None else rows.where(files["category"] == F.lit(category)).select(points["*"])


def id_map(path: str) -> dict[str, int]:
    """A small id map file."""
    with open(path) as f:
        return {str(k): int(v) for k, v in json.load(f).items()}


def pq_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(codebook, codes) as ``writers.pq_store`` wrote them."""
    return spark.read.parquet(f"{folder}/codebook"), spark.read.parquet(f"{folder}/codes")
