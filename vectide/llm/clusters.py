"""Bisecting k-means until every leaf is compact, on any number of vectors.

1. The upper part of the tree is grown across the cluster: the node of the largest
   dispersion is split along its principal direction, again and again, until no node
   holds more than twice ``local_cap`` vectors. These splits are fitted on a bounded
   sample of each node (``knn.SAMPLE``); every vector goes down the tree.
2. A node is finished inside one task on all its vectors, always splitting the node of
   the largest dispersion next, until all leaves are compact.
3. Cutting a cluster in two is undone through the index of problem 1 over the leaves'
   most typical members: a leaf joins the largest leaf (ties: smaller id) among its
   neighbours of ``min_cos`` or more that itself joins no other. Repeated among those
   with neighbours left, until no leaf joins. A leaf joins only where the typical member
   of every leaf it brings along is ``min_cos`` similar to the new centre, and stays
   there only if each of its own members is: a joined cluster is as compact as a leaf.

A leaf is compact when each member has a similarity of at least ``min_cos`` to
its most typical member, the one nearest to the centre.

Vectors that are not usable, and null ids, count for nothing; an id given again
counts once; copies fall in one cluster; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm import knn
from vectide.llm.vectors import as_matrix, two_means, usable_vectors
from vectide.shared import stored

#: Of the index over typical members: neighbours, size of a shard, reach and beam.
NEAR, SHARD, MARGIN, REACH, BEAM, LINKS = 8, 24_576, 0.3, 8, 64, 16
MOST_ROUNDS = 64


def unit(c: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(c, axis=-1, keepdims=True)
    return c / np.where(norm > 0, norm, 1)


def bisect_locally(x: np.ndarray, min_cos: float) -> list[np.ndarray]:
    """Leaves (row numbers, the most typical first) of a few thousand vectors."""
    leaves, todo = [], [(0.0, np.arange(len(x)))]
    while todo:
        todo.sort(key=lambda t: t[0])
        _, rows = todo.pop()  # the node of the largest dispersion
        y = x[rows]
        s = y @ unit(y.mean(axis=0))
        first = int(s.argmax())
        to_first = y @ y[first]
        if len(rows) == 1 or (to_first >= min_cos).all():
            leaves.append(np.concatenate([rows[[first]], np.delete(rows, first)]))
            continue
        far = to_first < min_cos
        side = two_means(y)
        if far.mean() < 0.25:  # a few strangers in a compact node: parted from it in one cut
            side = far
        if side.all() or not side.any():
            side = far
        for part in (rows[~side], rows[side]):
            z = x[part]
            todo.append((float(len(part) - np.linalg.norm(z.sum(axis=0))), part))
    return leaves


def _similar(pairs: DataFrame, dim: int) -> DataFrame:
    """``pairs`` (key, a BINARY, b BINARY) as (key, sim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = np.einsum("nd,nd->n", as_matrix(batch.column(1), dim), as_matrix(batch.column(2), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sim.astype(np.float64))], names=["key", "sim"])

    return pairs.select("key", "a", "b").mapInArrow(run, "key string, sim double")


class BisectingClusters:
    """``members`` (cluster, id, typical, to_typical): every usable id; ``typical`` is the
    most typical member of its leaf, ``cluster`` that of the leaf which the cluster is
    centred on."""

    def __init__(self, df: DataFrame, id_col: str, vector: str, dim: int, dtype: str = "<f4", min_cos: float = 0.68, local_cap: int = 8192) -> None:
        self.dim, self.min_cos = dim, min_cos
        vecs = usable_vectors(df, id_col, vector, dim, dtype).groupBy("id").agg(F.min("vec").alias("vec"))
        self.vecs = vecs = stored(vecs, "cluster-vectors")
        placed, _ = knn.cells_of(vecs, vecs.count(), dim, local_cap, 0.0, 1)
        self.leaves = stored(self._leaves(placed), "cluster-leaves")
        self.members = self._merged()

    def _leaves(self, placed: DataFrame) -> DataFrame:
        """(leaf, id, to_typical, vec): leaf is the most typical member's id."""
        dim, min_cos = self.dim, self.min_cos

        def part(table: pa.Table) -> pa.Table:
            ids = np.asarray(table.column("id").to_pylist(), dtype=object)
            order = np.argsort(ids, kind="stable")
            x = as_matrix(table.column("vec"), dim)[order]
            leaves = bisect_locally(x.astype(np.float64), min_cos)
            rows = np.concatenate(leaves)
            first = np.repeat([leaf[0] for leaf in leaves], [len(leaf) for leaf in leaves])
            sim = np.einsum("nd,nd->n", x[rows], x[first])
            names = ids[order]
            return pa.table(
                {
                    "leaf": pa.array(names[first], pa.string()),
                    "id": pa.array(names[rows], pa.string()),
                    "to_typical": pa.array(sim.astype(np.float64)),
                    "vec": table.column("vec").take(pa.array(order[rows])),
                }
            )

        # no node has more than twice local_cap rows
        return placed.select("node", "id", "vec").groupBy("node").applyInArrow(part, "leaf string, id string, to_typical double, vec binary")

    def _joined(self, reps: DataFrame) -> DataFrame:
        """(leaf, centre) of the leaves that join another; ``reps``: leaf, vec, n."""
        spark, dim, min_cos = reps.sparkSession, self.dim, self.min_cos
        joined = spark.createDataFrame([], "leaf string, centre string")
        active, size = reps, reps.select("leaf", "n")
        for _ in range(MOST_ROUNDS):
            hits = knn.nearest_of_classes(active.select(F.col("leaf").alias("id"), "vec"), active.count(), dim, NEAR, SHARD, MARGIN, REACH, BEAM, LINKS, min_cos)
            hits = stored(hits.select("id", "other"), "cluster-near")
            both = hits.unionByName(hits.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
            sized = both.join(size.select(F.col("leaf").alias("id"), F.col("n").alias("mine")), "id").join(size.select(F.col("leaf").alias("other"), "n"), "other")
            larger = sized.where("n > mine or (n = mine and other < id)")
            no_centre = larger.select(F.col("id").alias("other")).distinct()
            wish = larger.join(no_centre, "other", "left_anti").groupBy("id").agg(F.min_by("other", F.struct(-F.col("n"), "other")).alias("new"))
            wish = stored(wish, "cluster-wishes")
            if wish.isEmpty():
                return joined
            # what a leaf brings along must fit the new centre too
            along = wish.select(F.col("id").alias("leaf"), F.col("id").alias("centre"), "new").unionByName(joined.join(wish.withColumnRenamed("id", "centre"), "centre").select("leaf", "centre", "new"))
            with_vecs = along.join(reps.select("leaf", F.col("vec").alias("a")), "leaf").join(reps.select(F.col("leaf").alias("new"), F.col("vec").alias("b")), "new")
            fits = _similar(with_vecs.withColumn("key", F.col("centre")), dim).groupBy("key").agg(F.min("sim").alias("least")).where(F.col("least") >= min_cos)
            moves = stored(wish.join(fits.select(F.col("key").alias("id")), "id", "left_semi"), "cluster-moves")
            if moves.isEmpty():
                return joined
            kept = joined.join(moves.withColumnRenamed("id", "centre"), "centre", "left").select("leaf", F.coalesce("new", "centre").alias("centre"))
            joined = stored(kept.unionByName(moves.select(F.col("id").alias("leaf"), F.col("new").alias("centre"))), "cluster-joined")
            gone = moves.select(F.col("id").alias("leaf"))
            active = stored(active.join(both.select(F.col("id").alias("leaf")).distinct(), "leaf", "left_semi").join(gone, "leaf", "left_anti"), "cluster-active")
        raise RuntimeError(f"leaves still join after {MOST_ROUNDS} rounds")

    def _merged(self) -> DataFrame:
        """Leaves joined where every member keeps its similarity to the centre."""
        reps = self.leaves.groupBy("leaf").agg(F.count("*").alias("n"), F.max(F.when(F.col("id") == F.col("leaf"), F.col("vec"))).alias("vec"))
        reps = stored(reps, "cluster-reps")
        joined = self._joined(reps)
        centres = joined.join(reps.select(F.col("leaf").alias("centre"), F.col("vec").alias("b")), "centre")
        moved = self.leaves.join(centres, "leaf").select(F.col("leaf").alias("key"), F.col("vec").alias("a"), "b")
        whole = _similar(moved, self.dim).groupBy("key").agg(F.min("sim").alias("least")).where(F.col("least") >= self.min_cos)
        joined = stored(joined.join(whole.select(F.col("key").alias("leaf")), "leaf", "left_semi"), "cluster-joined")
        return self.leaves.join(joined, "leaf", "left").select(F.coalesce("centre", "leaf").alias("cluster"), "id", F.col("leaf").alias("typical"), "to_typical")

    def report(self, typical: int = 3) -> DataFrame:
        """``cluster, size, leaves, typical_ids, mean_to_typical``: the ``typical``
        members nearest to the typical member of the cluster's largest leaf."""
        sizes = self.members.groupBy("cluster").agg(F.count("*").alias("size"), F.countDistinct("typical").alias("leaves"), F.avg("to_typical").alias("mean_to_typical"))
        by_leaf = self.members.groupBy("cluster", "typical").agg(F.count("*").alias("n"))
        main = by_leaf.groupBy("cluster").agg(F.max_by("typical", F.struct("n", "typical")).alias("main"))
        near = self.members.join(main, "cluster").where("typical = main")
        order = Window.partitionBy("cluster").orderBy(F.desc("to_typical"), "id")
        best = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= typical)
        lists = best.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("typical_ids"))
        return sizes.join(lists, "cluster")


def codebook_similarity(vecs: DataFrame, book: list[tuple[int, int, bytes]], dim: int) -> DataFrame:
    """``id, to_codebook``: similarity of each unit vector with its rebuilding from
    the nearest stored centroid of every subspace. Null, zero and misfit centroids
    count for nothing; a subspace without any gives zeros."""
    parts = 1 + max((s for s, _, _ in book), default=0)
    width = dim // parts
    stored_: dict[int, list[np.ndarray]] = {}
    for s, _, raw in book:
        v = np.frombuffer(raw, np.float32) if len(raw) == 4 * width else None
        if v is not None and np.isfinite(v).all() and v.any():
            stored_.setdefault(s, []).append(v)
    centroids = {s: np.stack(v) for s, v in stored_.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(1), dim)
            made = np.zeros_like(x)
            for s, c in centroids.items():
                y = x[:, s * width : (s + 1) * width]
                made[:, s * width : (s + 1) * width] = c[((c * c).sum(1)[None, :] - 2 * y @ c.T).argmin(axis=1)]
            sim = np.einsum("nd,nd->n", unit(made.astype(np.float64)), x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sim)], names=["id", "to_codebook"])

    return vecs.mapInArrow(run, "id string, to_codebook double")
