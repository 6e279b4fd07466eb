"""The k most similar vectors of every vector, by one HNSW graph per shard.

1. Exact copies are one vector with many ids, so a group of copies, however
   large, is searched once and cannot overfill a shard.
2. Vectors are routed to cells. Centres are fitted on a bounded sample (``SAMPLE``
   vectors, so at most ``SAMPLE / 8`` centres, which every task gets); every vector
   is indexed in its nearest cell. A cell that holds more than twice ``shard_cap``
   vectors is divided again in the same way, from a sample of its own, until none
   does: the number of cells grows with the data, a shard does not. Below the first
   level the centres of a cell travel to its vectors through the shuffle, so no task
   holds those of other cells. A cell that a
   division left whole, of vectors so alike that no centres part them, is dealt by a
   hash of the id, and so is what the last division still finds overfull.
3. A cell is a shard. Its task builds the graph as flat arrays, then searches in it:
   first its own members, each from its own node, then, as they stream by, the
   vectors of other cells that reach it. A vector reaches the cells whose centre is
   at most ``margin`` less similar than its nearest one's, ``reach`` of them at most.
   A shard that more than ``ASK_BLOCK`` vectors reach is built by several tasks.
   Every result comes from a graph search; shards' results are merged.

``shard_cap``, ``margin``, ``reach`` and ``ef`` set accuracy against cost; recall
against brute force is measured in the tests and in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.operators.hnsw import Graph
from vectide.llm.vectors import as_matrix, fit_cells, usable_vectors
from vectide.shared import stored

#: Vectors that the cells of one node are fitted on, and their numbers at most.
SAMPLE = 16_384
SAMPLE_NUMBERS = 1 << 23
ASK_BLOCK = 65_536
ROUTE_BLOCK = 262_144
#: Children of a node of the tree of cells; five levels fit a BIGINT.
FAN = 4096
MOST_LEVELS = 5
MOST_TASKS = 100_000
QUERIES = 8192

_ROUTED = "id string, vec binary, node long, home boolean"
_HITS = "id string, other string, sim double"


def sample_rows(dim: int) -> int:
    """Vectors of ``dim`` numbers in a sample."""
    return max(256, min(SAMPLE, SAMPLE_NUMBERS // dim))


def hash_id(x: str, seed: int = 0) -> int:
    """A fixed 64-bit hash of a string (Python's own differs by process)."""
    return xxhash.xxh64_intdigest(x, seed)


def reached(x: np.ndarray, ids: list[str], centres: np.ndarray, margin: float, reach: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, nearest) of the cells that each vector reaches. Cells that do not
    differ are told apart by a hash of the id, another one on each level."""
    if len(centres) > 1 and (centres == centres[0]).all():
        step = np.arange(min(reach, len(centres)))
        cell = (np.fromiter((hash_id(i, level) % len(centres) for i in ids), np.int64, len(ids))[:, None] + step) % len(centres)
        row = np.repeat(np.arange(len(ids)), len(step))
        return row, cell.ravel(), np.tile(step == 0, len(ids))
    rows, cells, homes = [], [], []
    most = min(reach, len(centres))
    for at in range(0, len(x), 4096):
        s = x[at : at + 4096] @ centres.T
        best = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < len(centres) else np.broadcast_to(np.arange(most), (len(s), most))
        value = np.take_along_axis(s, best, axis=1)
        own = value.argmax(axis=1)
        r, c = np.nonzero(value >= value[np.arange(len(s)), own][:, None] - margin)
        rows.append(r + at)
        cells.append(best[r, c])
        homes.append(c == own[r])
    return np.concatenate(rows), np.concatenate(cells).astype(np.int64), np.concatenate(homes)


def _first_route(rows: DataFrame, centres: np.ndarray, margin: float, reach: int) -> DataFrame:
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, cell, home = reached(as_matrix(batch.column(1), dim), batch.column(0).to_pylist(), centres, margin, reach)
                yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).take(pa.array(row)).columns, pa.array(cell), pa.array(home)], names=["id", "vec", "node", "home"])

    return rows.select("id", "vec").mapInArrow(run, _ROUTED)


def _centres_of(sample: np.ndarray, size: int, cap: int, fan: int, dealt: bool = False) -> np.ndarray:
    """Centres for cells of about ``0.7 * cap`` of ``size`` vectors; with ``dealt`` equal ones."""
    centres = fit_cells(sample.astype(np.float64), len(sample) if dealt else max(8, int(0.7 * cap * len(sample) / max(1, size))), fan)
    if len(centres) == 1 and size > 2 * cap:  # nothing to tell them apart by
        centres = np.repeat(centres, -(-size // cap), axis=0)
    return centres[:fan]


def _divided(deep: DataFrame, over: DataFrame, dim: int, cap: int, margin: float, reach: int, level: int) -> DataFrame:
    """The vectors of overfull cells (``over``: node, own, far, dealt) routed to cells of
    these; those that are at home elsewhere to the nearest only."""
    fan, most = FAN, sample_rows(dim)
    rows = deep.join(over.select("node", "own", "dealt"), "node")
    rate = F.lit(0.95 * most) / F.col("own")
    sample = rows.where(F.col("home") & (F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30)) < rate * (1 << 30)))

    def fit(table: pa.Table) -> pa.Table:
        x = as_matrix(table.column("vec"), dim)[np.argsort(table.column("id").to_pylist(), kind="stable")][:most]
        centres = _centres_of(x, table.column("own")[0].as_py(), cap, fan, table.column("dealt")[0].as_py())
        return pa.table({"node": table.column("node").slice(0, 1), "centres": pa.array([centres.tobytes()], pa.binary())})

    # the sample of a node is bounded
    fitted = sample.groupBy("node").applyInArrow(fit, "node long, centres binary").join(over, "node")
    salts = F.ceil((F.col("own") + F.col("far")) / F.lit(ROUTE_BLOCK)).cast("int")
    heads = fitted.select("node", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit("").alias("id"), F.col("centres").alias("vec"), F.lit(False).alias("home"))
    body = deep.join(over.select("node", salts.alias("salts")), "node")
    body = body.select("node", F.pmod(F.xxhash64("id", F.lit(5)), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "vec", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = None
        for batch in batches:
            node, kind = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            salt = batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(node) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(node)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    centres = as_matrix(part.column(4), dim)
                    continue
                row, cell, nearest = reached(as_matrix(part.column(4), dim), part.column(3).to_pylist(), centres, margin, reach, level)
                mine = part.column(5).to_numpy(zero_copy_only=False)[row]
                row, cell, home = (v[mine | nearest] for v in (row, cell, mine & nearest))
                picked = part.select([3, 4]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array((node[lo] + 1) * fan + cell), pa.array(home)], names=["id", "vec", "node", "home"])

    ordered = heads.unionByName(body).repartition("node", "salt").sortWithinPartitions("node", "salt", "kind")
    return ordered.mapInArrow(run, _ROUTED)


def cells_of(reps: DataFrame, count: int, dim: int, cap: int, margin: float, reach: int) -> tuple[DataFrame, DataFrame]:
    """(``id, vec, node, home``: the cells that each vector reaches, its own among them;
    ``node, own, far``: their members, and the vectors of other cells that reach them).
    No cell has more than twice ``cap`` members."""
    most = sample_rows(dim)
    rate = min(1.0, 0.95 * most / max(1, count))
    picked = reps.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int(rate * (1 << 30))) if rate < 1 else reps
    picked = sorted((r.id, bytes(r.vec)) for r in picked.select("id", "vec").limit(most).toLocalIterator())
    sample = np.frombuffer(b"".join(v for _, v in picked), np.float32).reshape(-1, dim)
    routed = _first_route(reps, _centres_of(sample, count, cap, FAN), margin, reach)
    placed = sizes = before = None
    for level in range(1, MOST_LEVELS + 1):
        own = F.sum(F.col("home").cast("long"))
        counts = stored(routed.groupBy("node").agg(own.alias("own"), (F.count("*") - own).alias("far")), "knn-cells")
        over = counts.where(F.col("own") > 2 * cap).withColumn("dealt", F.lit(level == MOST_LEVELS - 1))
        if before is not None:
            whole = F.col("dealt") | (F.col("own") > F.lit(0.9) * F.col("was"))
            parents = before.select(F.col("node").alias("parent"), F.col("own").alias("was"))
            over = over.withColumn("parent", F.expr(f"node div {FAN} - 1")).join(parents, "parent").select("node", "own", "far", whole.alias("dealt"))
        before = counts
        fits = counts.where(F.col("own") <= 2 * cap)
        sizes = fits if sizes is None else sizes.unionByName(fits)
        if over.isEmpty():
            return routed if placed is None else placed.unionByName(routed), sizes
        if level == MOST_LEVELS:
            raise ValueError(f"cells still hold more than {2 * cap} vectors after {MOST_LEVELS} levels")
        done = routed.join(over.select("node"), "node", "left_anti").select("id", "vec", "node", "home")
        placed = done if placed is None else placed.unionByName(done)
        deep = routed.join(over.select("node"), "node", "left_semi").select("id", "vec", "node", "home")
        routed = stored(_divided(deep, over, dim, cap, margin, reach, level), "knn-deeper")


class _Shard:
    """A cell's members, then their graph, and the answers it gives."""

    def __init__(self, dim: int, k: int, ef: int, m: int, min_sim: float | None):
        self.dim, self.k, self.ef, self.m, self.min_sim = dim, k, ef, m, min_sim
        self.members: list[pa.RecordBatch] = []
        self.asking: list[pa.RecordBatch] = []
        self.graph = None

    def _hits(self, ids: np.ndarray, found: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
        good = found >= 0 if self.min_sim is None else (found >= 0) & (sims >= self.min_sim)
        r, c = np.nonzero(good)
        return pa.RecordBatch.from_arrays([pa.array(ids[r], pa.string()), pa.array(self.ids[found[r, c]], pa.string()), pa.array(sims[r, c].astype(np.float64))], names=["id", "other", "sim"])

    def build(self, own: bool) -> Iterator[pa.RecordBatch]:
        """The graph of the members, and with ``own`` their own neighbours in it."""
        if self.graph is not None:
            return
        table = pa.Table.from_batches(self.members)
        self.members = []
        ids = np.asarray(table.column("id").to_pylist(), dtype=object)
        order = np.argsort(ids, kind="stable")  # the shuffle's order has no say
        self.ids = ids[order]
        vecs = as_matrix(table.column("vec"), self.dim)[order]
        self.graph = Graph.build(vecs, np.fromiter(map(hash_id, self.ids), np.uint64, len(ids)), self.m)
        for at in range(0, len(ids) if own else 0, QUERIES):
            mine = np.arange(at, min(len(ids), at + QUERIES))
            yield self._hits(self.ids[mine], *self.graph.search(vecs[mine], self.k, self.ef, own=mine))

    def answer(self) -> Iterator[pa.RecordBatch]:
        if self.asking:
            table = pa.Table.from_batches(self.asking)
            self.asking = []
            yield self._hits(np.asarray(table.column("id").to_pylist(), dtype=object), *self.graph.search(as_matrix(table.column("vec"), self.dim), self.k, self.ef))


def nearest_of_classes(reps: DataFrame, count: int, dim: int, k: int, shard_cap: int, margin: float, reach: int, ef: int, m: int, min_sim: float | None = None) -> DataFrame:
    """``id, other, sim``: candidates among different vectors (``reps``: id, vec), with ``min_sim`` only those as similar."""
    placed, sizes = cells_of(reps, count, dim, shard_cap, margin, reach)
    # equal similarities go to one centre: a cell that vectors reach may have no members, and so no answers
    blocks = sizes.where("own > 0").select("node", F.greatest(F.lit(1), F.ceil(F.col("far") / F.lit(ASK_BLOCK))).cast("int").alias("blocks"))
    rows = placed.join(blocks, "node")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = F.array(F.pmod(F.xxhash64("id", F.lit(3)), "blocks").cast("int"))
    rows = rows.select("node", F.explode(F.when(F.col("home"), every).otherwise(one)).alias("block"), F.when(F.col("home"), 0).otherwise(1).alias("kind"), "id", "vec")
    # two tasks a shard, so that few shards share one; of very many shards several do
    parts = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-2 * count // shard_cap)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current, waiting = None, None, 0
        for batch in batches:
            node, block, kind = (batch.column(c).to_numpy() for c in range(3))
            edges = [0, *(np.flatnonzero((np.diff(node) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(node)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo).select([3, 4])
                if (node[lo], block[lo]) != current:
                    if shard is not None:
                        yield from shard.build(current[1] == 0)
                        yield from shard.answer()
                    shard, current, waiting = _Shard(dim, k, ef, m, min_sim), (node[lo], block[lo]), 0
                if kind[lo] == 0:
                    shard.members.append(part)
                    continue
                yield from shard.build(current[1] == 0)
                shard.asking.append(part)
                waiting += hi - lo
                if waiting >= QUERIES:
                    yield from shard.answer()
                    waiting = 0
        if shard is not None:
            yield from shard.build(current[1] == 0)
            yield from shard.answer()

    return rows.repartition(parts, "node", "block").sortWithinPartitions("node", "block", "kind").mapInArrow(run, _HITS)


def _with_key(vecs: DataFrame) -> DataFrame:
    """``id, vec, key``: the key is a 128-bit hash of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([xxhash.xxh3_128_digest(v) for v in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["id", "vec", "key"])

    return vecs.mapInArrow(run, "id string, vec binary, key binary")


def most_similar(
    df: DataFrame,
    id_col: str,
    vector: str,
    dim: int,
    dtype: str = "<f4",
    k: int = 5,
    min_sim: float | None = None,
    shard_cap: int = 24_576,
    margin: float = 0.12,
    reach: int = 4,
    ef: int = 16,
    m: int = 16,
) -> DataFrame:
    """``id STRING, other STRING, sim DOUBLE, rank INT``: the k most similar others of each id.

    Equal similarity (to 6 decimals) is ordered by the other id, smaller first.
    Vectors that are null, of another length, all zero or not finite, and null
    ids, count for nothing; an id given again counts once; copies of a vector are
    each other's neighbours with similarity 1. With ``min_sim`` only pairs that
    similar come out, ranked as among all. An empty table gives an empty table.
    Joins on a class of copies have a few rows on one side; a class that is a large
    part of the table is left to the adaptive split of skewed joins on the other.
    """
    vecs = _with_key(usable_vectors(df, id_col, vector, dim, dtype))
    classes = stored(vecs.groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("vec").alias("vec")), "knn-classes")
    count = classes.count()
    if count == 0:
        return vecs.select("id", F.col("id").alias("other"), F.lit(1.0).alias("sim"), F.lit(1).alias("rank")).where("false")
    hits = stored(nearest_of_classes(classes.select("id", "vec"), count, dim, k, shard_cap, margin, reach, ef, m, min_sim), "knn-hits")
    # members of classes with copies; the k + 1 smallest ids stand for a class as neighbours
    shared_keys = classes.where("id != last").select("key", F.col("id").alias("rep"))
    members = stored(vecs.select("key", "id").join(shared_keys, "key").select("rep", "id").distinct(), "knn-copies")
    order = Window.partitionBy("rep").orderBy("id")
    first = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("firsts"))
    spread = (
        hits.join(first.withColumnRenamed("rep", "other"), "other", "left")
        .select("id", F.explode(F.coalesce("firsts", F.array("other"))).alias("other"), "sim")
    )
    best = Window.partitionBy("id").orderBy(F.desc(F.round("sim", 6)), "other")
    ranked = spread.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # each copy: its class's lists, and the other copies
    of_copies = members.join(ranked.select(F.col("id").alias("rep"), "other", "sim"), "rep").select("id", "other", "sim")
    copies = members.join(first, "rep").select("id", F.explode("firsts").alias("other"), F.lit(1.0).alias("sim")).where("id != other")
    touched = of_copies.unionByName(copies).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    single = ranked.join(members.select(F.col("id")), "id", "left_anti")
    return single.select("id", "other", "sim", "rank").unionByName(touched.select("id", "other", "sim", "rank"))
