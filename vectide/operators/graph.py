"""Candidate graphs: edges as tables, and grouped solvers that take all queries at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.vectors import PLAIN, Kernel, SubspaceSpec, kernel_distance, sub_vectors
from vectide.operators import solvers
from vectide.operators.kernels import cloud_matrix

#: A group is a query's candidates; more than this is refused, not cut.
MOST_NODES = 2000


def knn_edges(dist: DataFrame, k: int, beta: float = 2.0) -> DataFrame:
    """``query_id, src, dst, w`` from pair distances ``query_id, src, dst, d`` (both
    directions): the k nearest of each src, ties by dst, and the missing reverse edges."""
    w = Window.partitionBy("query_id", "src").orderBy("d", "dst")
    near = dist.where("src != dst").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "src", "dst", F.exp(-beta * F.col("d")).alias("w"))
    back = near.select("query_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return near.unionByName(back.join(near.select("query_id", "src", "dst"), ["query_id", "src", "dst"], "left_anti"))


def smooth_step(field: DataFrame, edges: DataFrame, alpha: float) -> DataFrame:
    """One Laplacian step on ``query_id, doc_id, c`` over edges; isolated nodes stay."""
    pulled = (
        edges.join(field.select("query_id", F.col("doc_id").alias("dst"), F.col("c").alias("cj")), ["query_id", "dst"])
        .groupBy("query_id", F.col("src").alias("doc_id"))
        .agg(F.sum(F.col("w") * F.col("cj")).alias("wc"), F.sum("w").alias("ws"))
    )
    new = F.greatest(F.lit(0.0), F.col("c") + alpha * F.when(F.col("ws") > 0, F.col("wc") / F.col("ws") - F.col("c")).otherwise(0.0))
    return field.join(pulled, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce(new, F.col("c")).alias("c"))


def advection_edges(edges: DataFrame, centres: DataFrame, queries: DataFrame, alpha: float = 0.3) -> DataFrame:
    """``query_id, src, dst, u`` on the edge table; ``centres`` (doc_id, centroid), ``queries`` (query_id, q)."""
    from vectide.functions.vectors import dot, norm

    a = centres.select(F.col("doc_id").alias("src"), F.col("centroid").alias("ci"))
    b = centres.select(F.col("doc_id").alias("dst"), F.col("centroid").alias("cj"))
    rows = edges.join(a, "src").join(b, "dst").join(queries.select("query_id", "q"), "query_id")
    gap = F.zip_with("cj", "ci", lambda x, y: x - y)
    return rows.select("query_id", "src", "dst", (alpha * dot(gap, F.col("q")) / (norm(F.col("q")) + 1e-8) / (norm(gap) + 1e-8)).alias("u"))


def pair_distances(cands: DataFrame, spec: SubspaceSpec, kernel: Kernel = PLAIN) -> DataFrame:
    """Relational form: subspace-first distances ``query_id, src, dst, d`` of all candidate
    pairs; ``cands`` has (query_id, doc_id, points)."""
    points = cands.select("query_id", "doc_id", F.posexplode("points").alias("i", "v"))
    subs = points.select("query_id", "doc_id", "i", F.posexplode(sub_vectors(F.col("v"), spec)).alias("s", "sv"))
    a, b = subs.alias("a"), subs.alias("b")
    pairs = a.join(b, F.expr("a.query_id = b.query_id and a.s = b.s and a.doc_id < b.doc_id")).select(
        F.col("a.query_id").alias("query_id"), F.col("a.doc_id").alias("src"), F.col("b.doc_id").alias("dst"), F.col("a.s").alias("s"), F.col("a.i").alias("i"), F.col("b.i").alias("j"), kernel_distance(F.col("a.sv"), F.col("b.sv"), kernel).alias("d")
    )
    there = pairs.groupBy("query_id", "src", "dst", "s", "i").agg(F.min("d").alias("m")).groupBy("query_id", "src", "dst", "s").agg(F.avg("m").alias("x"))
    back = pairs.groupBy("query_id", "src", "dst", "s", "j").agg(F.min("d").alias("m")).groupBy("query_id", "src", "dst", "s").agg(F.avg("m").alias("y"))
    half = there.join(back, ["query_id", "src", "dst", "s"]).groupBy("query_id", "src", "dst").agg(F.avg(F.col("x") + F.col("y")).alias("d"))
    return half.unionByName(half.select("query_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "d"))


def metric_distances(cands: DataFrame, spec: SubspaceSpec, metric: str) -> DataFrame:
    """``query_id, src, dst, d`` of all pairs of a query's candidates (query_id, doc_id,
    points), both directions, by any symmetric set distance; groups as in ``solve_by_query``."""
    kind = dict(cands.dtypes)["doc_id"]

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows > MOST_NODES:
            raise ValueError(f"{table.num_rows} candidates for one query; at most {MOST_NODES}")
        table = table.sort_by("doc_id")
        ids = table.column("doc_id").combine_chunks()
        d = cloud_matrix([np.asarray(p, float) for p in table.column("points").to_pylist()], spec, metric)
        i, j = np.nonzero(~np.eye(len(d), dtype=bool))
        return pa.table({"query_id": table.column("query_id").take(pa.array(i)), "src": ids.take(pa.array(i)), "dst": ids.take(pa.array(j)), "d": d[i, j]})

    return cands.select("query_id", "doc_id", "points").groupBy("query_id").applyInArrow(run, f"query_id bigint, src {kind}, dst {kind}, d double")


def solve_by_query(cands: DataFrame, solve: Callable[[dict], np.ndarray], extra: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, doc_id, score``: ``solve`` gets one query's candidates, ordered by
    document: ids, c0, points (list of matrices), q (vector), qp (the query's cloud, where
    ``cands`` has it) and the ``extra`` columns.

    ``cands`` has (query_id, doc_id, c0, points, q). A group of more than
    ``MOST_NODES`` candidates raises; nulls in c0 count as 0.
    """
    kind = dict(cands.dtypes)["doc_id"]

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows > MOST_NODES:
            raise ValueError(f"{table.num_rows} candidates for one query; at most {MOST_NODES}")
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        table = table.take(pa.array(order))
        frame = {
            "ids": [ids[i] for i in order],
            "c0": np.array([x or 0.0 for x in table.column("c0").to_pylist()], dtype=float),
            "points": [np.asarray(p, dtype=np.float64) for p in table.column("points").to_pylist()],
            "q": np.asarray(table.column("q")[0].as_py(), dtype=np.float64),
            **({"qp": np.asarray(table.column("qp")[0].as_py(), dtype=np.float64)} if "qp" in table.column_names else {}),
            **{e: np.array(table.column(e).to_pylist(), dtype=float) for e in extra},
        }
        score = solve(frame)
        return pa.table({"query_id": table.column("query_id"), "doc_id": table.column("doc_id"), "score": pa.array(np.asarray(score, dtype=float))})

    cloud = ["qp"] if "qp" in cands.columns else []
    return cands.select("query_id", "doc_id", "c0", "points", "q", *cloud, *extra).groupBy("query_id").applyInArrow(run, f"query_id bigint, doc_id {kind}, score double")


def graph_of(frame: dict, spec: SubspaceSpec, k: int = 3, metric: str = "subspace_first") -> np.ndarray:
    """The k nearest candidates by a set distance: subspace-first, ``plain_chamfer``, ``symmetric_max_sim_distance``, ``unaligned``."""
    return solvers.knn_weights(cloud_matrix(frame["points"], spec, metric), k)


def max_sim_graph(frame: dict, k: int = 10) -> np.ndarray:
    """Late-interaction graph: weight is the mean of both directions' sums of largest
    products, kept for the k largest of each node and mirrored."""
    sims = cloud_matrix(frame["points"], None, "max_sim")
    n = len(sims)
    w = np.zeros((n, n))
    if n > 1 and k > 0:
        order = sims.copy()
        np.fill_diagonal(order, -np.inf)
        near = np.argsort(-order, axis=1, kind="stable")[:, : min(k, n - 1)]
        rows = np.arange(n)[:, None]
        w[rows, near] = sims[rows, near]
        w = np.where(w != 0, w, w.T)
    return w


def centre_graph(frame: dict, k: int, beta: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Cosine graph of the candidates' centroids, and the centroids."""
    c = np.stack([p.mean(axis=0) for p in frame["points"]])
    n = np.linalg.norm(c, axis=1)
    safe = np.where(n > 1e-9, n, 1.0)
    d = np.where((n[:, None] > 1e-9) & (n[None, :] > 1e-9), 1 - (c / safe[:, None]) @ (c / safe[:, None]).T, 1.0)
    return solvers.knn_weights(np.clip(d, 0, 2), k, beta), c
