"""Named vector indices as tables: create, add, remove, search, save, evict.

An index is a base table (doc_id, points), a table of HNSW graphs over it, and a log of
deltas: added rows and removed ids, each numbered. A change writes its own rows only; a
read merges, the last word on a document holding. ``compact`` writes base and graphs anew,
and a change does so by itself once the deltas hold more than ``MOST_DELTA`` of the base.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.vectors import SubspaceSpec, cosine_distance
from vectide.operators.clouds import arrow_clouds
from vectide.operators.hnsw import Graph
from vectide.operators.scan import query_blocks, scan, top_k
from vectide.shared import new_path

#: The four indices of the multi-index search; the first two are never evicted.
NAMES = ("statute", "literature", "case", "judgment")
PERMANENT = {"statute", "literature"}
#: Vectors of a graph; more make more graphs.
SHARD = 24_576
#: Links a node and level, and beam of a search.
LINKS, BEAM = 24, 128
#: Share of the base that deltas may reach before they are merged into it.
MOST_DELTA = 0.1

_ROW = "doc_id bigint, points array<array<double>>"
_GRAPH = "shard int, ids array<bigint>, vecs binary, sizes binary, degrees binary, members binary, links binary"


def unit(x: np.ndarray) -> np.ndarray:
    """Unit f32 vectors; those of a norm under 1e-9 stay zero, similar to nothing."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm < 1e-9, 0.0, x / np.where(norm < 1e-9, 1.0, norm)).astype(np.float32)


def graphs(rows: DataFrame, count: int) -> DataFrame:
    """One row a shard: the ids and the flat arrays of the graph over their vectors."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        p, _ = arrow_clouds(table.column("points").combine_chunks())
        ids = table.column("doc_id").combine_chunks()
        packed = Graph.build(unit(p), ids.to_numpy().astype(np.uint64), LINKS).pack()
        return pa.table({"shard": table.column("shard").slice(0, 1), "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), **{k: pa.array([v], pa.binary()) for k, v in packed.items()}})

    shards = max(1, -(-count // SHARD))
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, _GRAPH)


def graph_search(queries: DataFrame, index: DataFrame, beam: int = BEAM) -> DataFrame:
    """``query_id, doc_id, value``: of every graph the ``beam`` documents nearest to each
    query's first vector; value is the cosine distance. Queries go to the graphs in blocks
    of bounded size; neither graphs nor vectors are shuffled."""
    out = None
    for block in query_blocks(queries):
        names = np.array([q for q, _ in block], np.int64)
        asked = unit(np.stack([p[0] for _, p in block]))

        def run(batches: Iterator[pa.RecordBatch], names=names, asked=asked) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found, sims = Graph.unpack(*(row[c] for c in ("vecs", "sizes", "degrees", "members", "links"))).search(asked, beam, beam)
                    r, c = np.nonzero(found >= 0)
                    ids = np.asarray(row["ids"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(ids[found[r, c]]), pa.array(1.0 - sims[r, c].astype(np.float64))], names=["query_id", "doc_id", "value"])

        one = index.mapInArrow(run, "query_id bigint, doc_id bigint, value double")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else index.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, value double")


@dataclass
class Index:
    """Where an index lies: base, its graphs, and deltas in order, (added?, path)."""

    base: str
    graphs: str | None = None
    size: int = 0
    deltas: list[tuple[bool, str]] = field(default_factory=list)
    changed: int = 0


class IndexManager:
    """Indices by name. Changes write new files and then move the pointer, so readers never
    see half a change."""

    def __init__(self, spark: SparkSession, dim: int, idle_seconds: float = 7200.0) -> None:
        self.spark, self.dim, self.idle = spark, dim, idle_seconds
        self._tables: dict[str, Index] = {}
        self._cached: dict[str, tuple[DataFrame, float]] = {}

    def _write(self, name: str, df: DataFrame) -> None:
        path = new_path(self.spark, f"index-{name}")
        df.write.option("compression", "zstd").parquet(path)
        self._tables[name] = Index(path, size=self.spark.read.parquet(path).count())
        self._cached.pop(name, None)

    def create(self, name: str, vectors: DataFrame | None = None) -> None:
        """``vectors`` (doc_id BIGINT, vec); vectors of another length raise."""
        self._write(name, self._checked(vectors).dropDuplicates(["doc_id"]) if vectors is not None else self.spark.createDataFrame([], _ROW))

    def _checked(self, vectors: DataFrame) -> DataFrame:
        if vectors.where(F.size("vec") != self.dim).limit(1).count():
            raise ValueError(f"an index holds vectors of {self.dim} numbers")
        return vectors.where("doc_id is not null and vec is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.array(F.col("vec").cast("array<double>")).alias("points"))

    def _changes(self, index: Index) -> DataFrame:
        """``doc_id, points, n``: every change, the later the larger n; a removal has no points."""
        out = self.spark.createDataFrame([], _ROW + ", n int")
        for n, (added, path) in enumerate(index.deltas):
            one = self.spark.read.parquet(path)
            out = out.unionByName((one if added else one.withColumn("points", F.lit(None).cast("array<array<double>>"))).withColumn("n", F.lit(n)))
        return out

    def _last(self, index: Index) -> DataFrame:
        """``doc_id, points`` of every changed document as it is now; null points: gone."""
        return self._changes(index).groupBy("doc_id").agg(F.max_by("points", "n").alias("points"))

    def load(self, name: str) -> DataFrame:
        """The rows of an index, deltas merged in."""
        if name not in self._tables:
            raise KeyError(f"no index {name}")
        if name not in self._cached:
            index = self._tables[name]
            df = self.spark.read.parquet(index.base)
            if index.deltas:
                last = self._last(index)
                df = df.join(last.select("doc_id"), "doc_id", "left_anti").unionByName(last.where("points is not null"))
            self._cached[name] = (df, time.time())
        df, _ = self._cached[name]
        self._cached[name] = (df, time.time())
        return df

    def _change(self, name: str, rows: DataFrame, added: bool) -> None:
        self.load(name)
        index = self._tables[name]
        path = new_path(self.spark, f"index-{name}-delta")
        rows.write.option("compression", "zstd").parquet(path)
        index.deltas.append((added, path))
        index.changed += self.spark.read.parquet(path).count()
        self._cached.pop(name, None)
        if index.changed > max(1000, MOST_DELTA * index.size):
            self.compact(name)

    def add(self, name: str, vectors: DataFrame) -> None:
        """Adds rows; a doc_id that is there already is replaced. Writes the added rows only."""
        self._change(name, self._checked(vectors).dropDuplicates(["doc_id"]), True)

    def remove(self, name: str, ids: DataFrame) -> None:
        """Removes documents; unknown ids do nothing. Writes the ids only."""
        self._change(name, ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct(), False)

    def compact(self, name: str) -> None:
        """Base and deltas become a new base; its graphs are built at the next search."""
        self._write(name, self.load(name))

    def _graphs(self, name: str) -> DataFrame:
        index = self._tables[name]
        if index.graphs is None:
            path = new_path(self.spark, f"index-{name}-graphs")
            graphs(self.spark.read.parquet(index.base), index.size).write.option("compression", "zstd").parquet(path)
            index.graphs = path
        return self.spark.read.parquet(index.graphs)

    def search(self, name: str, queries: DataFrame, k: int, exact: bool = False) -> DataFrame:
        """``query_id, doc_id, score, rank``; score is 1 - cosine distance. The base is
        searched by its graphs, added rows one by one; ``exact`` compares all. A missing
        index gives no rows."""
        if name not in self._tables or k <= 0:
            return self.spark.createDataFrame([], "query_id bigint, doc_id bigint, score double, rank bigint")
        spec = SubspaceSpec(1, self.dim)
        if exact:
            hits = scan(queries, self.load(name), "centroid_cosine", spec, k)
        else:
            index = self._tables[name]
            found = graph_search(queries, self._graphs(name), max(BEAM, 2 * k))
            if index.deltas:
                last = self._last(index)
                fresh = scan(queries, last.where("points is not null"), "centroid_cosine", spec, k).drop("rank")
                found = found.join(last.select("doc_id"), "doc_id", "left_anti").select("query_id", "doc_id", "value").unionByName(fresh)
            # the graphs hold floats: the best are measured again on the stored vectors
            best = top_k(found, 2 * k).select("query_id", "doc_id").join(self.load(name), "doc_id").join(queries.select("query_id", F.col("points").alias("q")), "query_id")
            value = cosine_distance(F.get("q", F.lit(0)), F.get("points", F.lit(0)))
            hits = top_k(best.select("query_id", "doc_id", value.alias("value")), k)
        return hits.select("query_id", "doc_id", (1 - F.col("value")).alias("score"), "rank")

    def stats(self) -> dict[str, int]:
        return {name: self.load(name).count() for name in self._tables}

    def sizes(self) -> DataFrame:
        """``name, documents, points, bytes`` of every index; bytes are those of its numbers."""
        out = self.spark.createDataFrame([], "name string, documents bigint, points bigint, bytes bigint")
        for name in self._tables:
            points = F.coalesce(F.sum(F.size("points")), F.lit(0))
            out = out.unionByName(self.load(name).agg(F.count("*").alias("documents"), points.alias("points"), (points * F.lit(4 * self.dim)).alias("bytes")).select(F.lit(name).alias("name"), "documents", "points", "bytes"))
        return out

    def save(self, name: str, path: str) -> None:
        self.load(name).write.mode("overwrite").option("compression", "zstd").parquet(path)

    def save_all(self, folder: str) -> None:
        for name in self._tables:
            self.save(name, f"{folder}/{name}.parquet")

    def restore(self, name: str, path: str) -> None:
        self._tables[name] = Index(path, size=self.spark.read.parquet(path).count())
        self._cached.pop(name, None)

    def evict_idle(self, now: float | None = None) -> list[str]:
        """Forgets loaded tables that were idle too long, but for the permanent ones."""
        now = time.time() if now is None else now
        gone = [n for n, (_, used) in self._cached.items() if n not in PERMANENT and now - used > self.idle]
        for n in gone:
            del self._cached[n]
        return gone
