"""Retrieval pipelines over clouds, for all queries at once.

Candidates are found by a scan that shuffles k rows a query and task, their clouds
are fetched by an equi-join, and each query's few hundred candidates are solved in
one group. Results are ``query_id, doc_id, score, rank``; ties rank by doc_id.
A candidate without a cloud sends its whole query back to the coarse order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions.vectors import SubspaceSpec, similarity_of_distance
from vectide.operators import fusion, graph, quantize, solvers
from vectide.operators.clouds import arrow_clouds, long_form
from vectide.operators.kernels import METRICS, far_points, sub_distances
from vectide.functions.vectors import PLAIN
from vectide.operators.scan import pair_values, scan, top_k


@dataclass
class Corpus:
    """``docs`` (doc_id, points) and ``queries`` (query_id BIGINT, points); a query's
    single vector is its first point. ``fine`` are the same documents at the finer
    granularity, ``docs`` itself where there is one only."""

    docs: DataFrame
    queries: DataFrame
    spec: SubspaceSpec
    fine: DataFrame | None = None

    @property
    def tokens(self) -> DataFrame:
        return self.fine if self.fine is not None else self.docs


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores.select("query_id", "doc_id", "score"), k, "score", ascending=False)


def cosine_rank(c: Corpus, k: int) -> DataFrame:
    """Centroid cosine; score 1 - distance."""
    return scan(c.queries, c.docs, "centroid_cosine", c.spec, k).select("query_id", "doc_id", (1 - F.col("value")).alias("score"), "rank")


def full_scan(c: Corpus, k: int, exclude: DataFrame | None = None) -> DataFrame:
    """Pair-first Chamfer over all documents; score 1 - distance, which may be negative."""
    return scan(c.queries, c.docs, "scan_pair_first", c.spec, k, exclude).select("query_id", "doc_id", (1 - F.col("value")).alias("score"), "rank")


def token_rank(c: Corpus, k: int) -> DataFrame:
    return scan(c.queries, c.tokens, "subspace_first", c.spec, k).select("query_id", "doc_id", similarity_of_distance(F.col("value")).alias("score"), "rank")


def rerank(c: Corpus, pairs: DataFrame, k: int, metric: str = "subspace_first", **options) -> DataFrame:
    """Listed documents by a set distance; unknown ids drop out; score exp(-2 d)."""
    values = pair_values(pairs, c.queries, c.tokens, metric, c.spec, **options)
    return _ranked(values.withColumn("score", similarity_of_distance(F.col("value"))), k)


def coarse(c: Corpus, n: int) -> DataFrame:
    """Cloud-to-centroid candidates."""
    return scan(c.queries, c.tokens, "cloud_to_centroid", c.spec, n)


def two_stage(c: Corpus, n: int, k: int, metric: str = "subspace_first", **options) -> DataFrame:
    return rerank(c, coarse(c, n), k, metric, **options)


@dataclass
class Prepared:
    """What a corpus is prepared with, once, as tables: every document's centroid and
    far-point mean (each a cloud of one point), its codes and its posting counts."""

    centroids: DataFrame
    far: DataFrame
    codes: DataFrame
    counts: DataFrame
    book: DataFrame

    def save(self, folder: str) -> None:
        """Its tables under a folder, for later sessions."""
        for name in PARTS:
            getattr(self, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Prepared:
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in PARTS))


#: The tables of a prepared corpus.
PARTS = ("centroids", "far", "codes", "counts", "book")


def prepare(c: Corpus, book: DataFrame, far: int = 3) -> Prepared:
    """Writes the derived tables of a corpus; the lookup, inverted and probe pipelines read
    them and touch no document vector in their first stages."""
    from vectide.shared import stored

    kind = dict(c.tokens.dtypes)["doc_id"]

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, starts = arrow_clouds(batch.column(1))
                parts = np.split(p, starts[1:])
                made = ([x.mean(axis=0)[None] for x in parts], [far_points(x, far)[None] for x in parts])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m.tolist() for m in side], pa.list_(pa.list_(pa.float64()))) for side in made)], names=["doc_id", "centroid", "far"])

    rows = c.tokens.where("doc_id is not null and size(points) > 0").select("doc_id", "points")
    ends = stored(rows.mapInArrow(points, f"doc_id {kind}, centroid array<array<double>>, far array<array<double>>"), "prepared-points")
    codes = stored(quantize.encode_clouds(rows, book, c.spec), "prepared-codes")
    counts = stored(quantize.posting_counts(codes), "prepared-counts")
    one = lambda name: ends.select("doc_id", F.col(name).alias("points"))
    return Prepared(one("centroid"), one("far"), codes, counts, book)


def prepared_coarse(c: Corpus, made: Prepared, n: int) -> DataFrame:
    """``coarse`` on the stored centroids."""
    return scan(c.queries, made.centroids, "cloud_to_centroid", c.spec, n)


def reconstructed_two_stage(c: Corpus, book: DataFrame, n: int, k: int, made: Prepared | None = None) -> DataFrame:
    """Second stage on documents rebuilt from their codes."""
    made = made or prepare(c, book)
    cands = prepared_coarse(c, made, n)
    rebuilt = quantize.rebuilt_clouds(made.codes.join(cands.select("doc_id").distinct(), "doc_id", "left_semi"), book, c.spec)
    return rerank(Corpus(rebuilt, c.queries, c.spec), cands, k)


def _query_points(c: Corpus) -> DataFrame:
    return long_form(c.queries.withColumnRenamed("query_id", "doc_id"))


def lookup_two_stage(c: Corpus, book: DataFrame, n: int, k: int, made: Prepared | None = None) -> DataFrame:
    """Second stage from the lookup table and codes of the candidates."""
    made = made or prepare(c, book)
    values = quantize.lookup_values(prepared_coarse(c, made, n), c.queries, made.codes, book, c.spec)
    return _ranked(values.withColumn("score", similarity_of_distance(F.col("value"))), k)


def inverted_candidates(c: Corpus, book: DataFrame, n: int, probes: int = 1, made: Prepared | None = None) -> DataFrame:
    made = made or prepare(c, book)
    hits = quantize.hits_of_counts(_query_points(c), made.counts, book, c.spec, probes)
    return top_k(hits.withColumn("value", F.col("hits").cast("double")), n, "value", ascending=False)


def inverted_two_stage(c: Corpus, book: DataFrame, n: int, k: int, probes: int = 1, made: Prepared | None = None) -> DataFrame:
    return rerank(c, inverted_candidates(c, book, n, probes, made), k)


def late_interaction(c: Corpus, book: DataFrame, n: int, k: int, probes: int = 2, made: Prepared | None = None) -> DataFrame:
    """Candidates by the stored postings under each query point's nearest centroids, then
    the sum of largest products on their vectors; score is that sum."""
    cands = inverted_candidates(c, book, n, probes, made)
    values = pair_values(cands, c.queries, c.tokens, "max_sim", c.spec)
    return _ranked(values.withColumnRenamed("value", "score"), k)


# -- several probes --------------------------------------------------------------
def probes(c: Corpus, book: DataFrame, n: int, n_probe: int = 1, made: Prepared | None = None) -> DataFrame:
    """``query_id, probe, doc_id, score`` of the centroid, far-point and inverted probes."""
    made = made or prepare(c, book)
    centre = prepared_coarse(c, made, n).select("query_id", F.lit("centroid").alias("probe"), "doc_id", (1 - F.col("value")).alias("score"))
    far = scan(c.queries, made.far, "max_point_cosine", c.spec, n).select("query_id", F.lit("max_token").alias("probe"), "doc_id", F.col("value").alias("score"))
    inv = inverted_candidates(c, book, n, n_probe, made)
    size = F.count("*").over(Window.partitionBy("query_id"))
    inv = inv.select("query_id", F.lit("inverted").alias("probe"), "doc_id", ((size - (F.col("rank") - 1)) / size).alias("score"))
    return centre.unionByName(far).unionByName(inv)


MERGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rrf": lambda lists: fusion.reciprocal_rank(lists, 60.0, base=0),
    "max": fusion.max_score,
    "hit": fusion.hit_max,
}


def multi_probe(c: Corpus, book: DataFrame, per_probe: int, merged: int, strategy: str = "rrf", n_probe: int = 1, made: Prepared | None = None) -> DataFrame:
    if strategy not in MERGES:
        raise ValueError(f"strategy is one of {sorted(MERGES)}")
    return _ranked(MERGES[strategy](probes(c, book, per_probe, n_probe, made)), merged)


def multi_probe_two_stage(c: Corpus, book: DataFrame, per_probe: int, merged: int, k: int, strategy: str = "rrf", made: Prepared | None = None) -> DataFrame:
    return rerank(c, multi_probe(c, book, per_probe, merged, strategy, made=made), k)


# -- graph pipelines -------------------------------------------------------------
def known(c: Corpus, pairs: DataFrame) -> DataFrame:
    """The pairs, if every query and document of them has a cloud; a ``KeyError`` naming one that has none else."""
    for side, name in ((c.queries, "query_id"), (c.docs, "doc_id")):
        lost = pairs.select(name).distinct().join(side.where("size(points) > 0").select(name), name, "left_anti").limit(1).collect()
        if lost:
            raise KeyError(f"no cloud for {name} {lost[0][0]}")
    return pairs


def query_distances(c: Corpus, pairs: DataFrame) -> DataFrame:
    """``query_id, doc_id, value`` of listed pairs, by the query's first vector; an unknown id raises."""
    return pair_values(known(c, pairs), c.queries, c.docs, "query_to_cloud", c.spec)


def distance_matrix(c: Corpus, pairs: DataFrame) -> DataFrame:
    """``query_id, src, dst, d`` among each query's listed documents; an unknown id raises."""
    return graph.pair_distances(known(c, pairs).select("query_id", "doc_id").distinct().join(c.docs, "doc_id"), c.spec)


def fetch(c: Corpus, cands: DataFrame, c0: DataFrame | None = None) -> DataFrame:
    """Candidates with their clouds, the query's vector and the start field."""
    rows = cands.select("query_id", "doc_id").join(c.docs, "doc_id").join(c.queries.select("query_id", F.get("points", F.lit(0)).alias("q"), F.col("points").alias("qp")), "query_id")
    return rows.join(c0, ["query_id", "doc_id"], "left") if c0 is not None else rows


def _field(c: Corpus, cands: DataFrame) -> DataFrame:
    """exp(-2 d) of the query's vector and each candidate's cloud."""
    return pair_values(cands, c.queries, c.docs, "query_to_cloud", c.spec).select("query_id", "doc_id", similarity_of_distance(F.col("value")).alias("c0"))


def _with_fallback(solved: DataFrame, cands: DataFrame, docs: DataFrame) -> DataFrame:
    """Queries with a candidate that has no cloud keep the coarse scores."""
    bad = cands.join(docs.select("doc_id").where("size(points) > 0"), "doc_id", "left_anti").select("query_id").distinct()
    kept = cands.join(bad, "query_id", "left_semi").select("query_id", "doc_id", (1 - F.col("value")).alias("score"))
    return solved.join(bad, "query_id", "left_anti").unionByName(kept)


def graph_pipeline(c: Corpus, k: int, n: int, solver: Callable[[dict, np.ndarray], np.ndarray], neighbours: int = 3, extra: DataFrame | None = None, extra_cols: tuple[str, ...] = ()) -> DataFrame:
    """Cosine candidates, their cloud graph, a solver on the start field."""
    cands = scan(c.queries, c.docs, "centroid_cosine", c.spec, n)
    rows = fetch(c, cands, _field(c, cands))
    if extra is not None:
        rows = rows.join(extra, ["query_id", "doc_id"], "left").fillna(0.0, list(extra_cols))
    spec = c.spec
    solved = graph.solve_by_query(rows, lambda f: solver(f, graph.graph_of(f, spec, neighbours)), extra_cols)
    return _ranked(_with_fallback(solved, cands, c.docs), k)


def shape_advection(c: Corpus, k: int, n: int, alpha: float = 0.3, diffusion: float = 0.15, most: int = 50, eps: float = 1e-3) -> DataFrame:
    def solve(f: dict, w: np.ndarray) -> np.ndarray:
        u = solvers.advection_field(f["q"], np.stack([p.mean(axis=0) for p in f["points"]]), w, alpha)
        return solvers.advection_diffusion(f["c0"], w, u, diffusion, most, eps)

    return graph_pipeline(c, k, n, solve)


def shape_laplacian(c: Corpus, k: int, n: int, alpha: float = 0.02, steps: int = 20) -> DataFrame:
    return graph_pipeline(c, k, n, lambda f, w: solvers.laplacian(f["c0"], w, alpha, steps))


def shape_rerank(c: Corpus, pairs: DataFrame, k: int, query_metric: str = "query_to_cloud", doc_metric: str = "subspace_first", alpha: float = 0.3, diffusion: float = 0.15) -> DataFrame:
    """Listed documents (query_id, doc_id) by advection on their graph; ``query_metric`` gives
    the start field, ``doc_metric`` the graph. Unknown ids drop out."""
    field = pair_values(pairs, c.queries, c.docs, query_metric, c.spec).select("query_id", "doc_id", similarity_of_distance(F.col("value")).alias("c0"))
    spec = c.spec

    def solve(f: dict) -> np.ndarray:
        w = graph.graph_of(f, spec, 3, doc_metric)
        u = solvers.advection_field(f["q"], np.stack([p.mean(axis=0) for p in f["points"]]), w, alpha)
        return solvers.advection_diffusion(f["c0"], w, u, diffusion)

    return _ranked(graph.solve_by_query(fetch(c, field.select("query_id", "doc_id"), field), solve), k)


def laplacian_sweep(c: Corpus, n: int, steps: tuple[int, ...], alpha: float = 0.15) -> DataFrame:
    """``steps, query_id, doc_id, score`` for several numbers of steps: one graph a query, one run."""
    cands = scan(c.queries, c.docs, "centroid_cosine", c.spec, n)
    rows = fetch(c, cands, _field(c, cands))
    spec, kind = c.spec, dict(rows.dtypes)["doc_id"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        w = graph.graph_of({"points": [np.asarray(p, float) for p in table.column("points").to_pylist()]}, spec, 3)
        field, parts = np.array([x or 0.0 for x in table.column("c0").to_pylist()]), []
        done = 0
        for t in sorted(set(steps)):
            field, done = solvers.laplacian(field, w, alpha, t - done), t
            parts.append(pa.table({"steps": pa.array([t] * table.num_rows, pa.int32()), "query_id": table.column("query_id"), "doc_id": table.column("doc_id"), "score": field}))
        return pa.concat_tables(parts)

    return rows.select("query_id", "doc_id", "c0", "points").groupBy("query_id").applyInArrow(run, f"steps int, query_id bigint, doc_id {kind}, score double")


def shape_allen_cahn(c: Corpus, k: int, n: int, alpha: float = 0.02, gamma: float = 0.5, steps: int = 30) -> DataFrame:
    return graph_pipeline(c, k, n, lambda f, w: solvers.allen_cahn(f["c0"], w, alpha, gamma, steps))


def token_gradient(c: Corpus, k: int, n: int, beta: float = 1.0) -> DataFrame:
    """Token scores as the potential; a document without tokens has 0."""
    cands = scan(c.queries, c.docs, "centroid_cosine", c.spec, n)
    potential = pair_values(cands, c.queries, c.tokens, "subspace_first", c.spec).select("query_id", "doc_id", similarity_of_distance(F.col("value")).alias("phi"))
    return graph_pipeline(c, k, n, lambda f, w: solvers.token_gradient(f["c0"], w, f["phi"], beta), extra=potential, extra_cols=("phi",))


def token_advection(c: Corpus, k: int, n: int, diffusion: float = 0.15, alpha: float = 0.3, sample: int | None = None) -> DataFrame:
    """Token candidates, sentence graph (or a graph of sampled tokens), advection along the query's centroid."""
    cands = scan(c.queries, c.tokens, "subspace_first", c.spec, n) if sample is None else rerank(c, coarse(c, 100), n).withColumn("value", -F.log("score") / 2)
    c0 = cands.select("query_id", "doc_id", similarity_of_distance(F.col("value")).alias("c0"))
    rows = fetch(c, cands, c0)
    spec = c.spec

    def solve(f: dict) -> np.ndarray:
        pick = lambda x: x[np.unique(np.minimum((np.arange(sample) * len(x)) // sample, len(x) - 1))] if sample and len(x) > sample else x
        w = graph.graph_of({"points": [pick(p) for p in f["points"]]}, spec, 3)
        u = solvers.advection_field(f["q"], np.stack([p.mean(axis=0) for p in f["points"]]), w, alpha)
        return solvers.advection_diffusion(f["c0"], w, u, diffusion)

    from vectide.operators.clouds import mean_of

    rows = rows.withColumn("q", mean_of(F.col("qp"), spec.dim))
    return _ranked(_with_fallback(graph.solve_by_query(rows, solve), cands, c.docs), k)


def helmholtz_kalman(c: Corpus, k: int, n: int, beta: float = 1.0) -> DataFrame:
    """Two-stage candidates; graph scores corrected against token scores."""
    cands = two_stage(c, 100, n).select("query_id", "doc_id", F.col("score").alias("c0"))
    rows = fetch(c, cands, cands)
    spec = c.spec
    kind = dict(rows.dtypes)["doc_id"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        points = [np.asarray(p, float) for p in table.column("points").to_pylist()]
        q = np.asarray(table.column("qp")[0].as_py(), float)
        w = graph.graph_of({"points": points}, spec, 3)
        token = np.asarray(table.column("c0").to_pylist(), float)
        smooth = solvers.laplacian(np.exp(-2 * np.array([METRICS["query_to_cloud"](q, p, np.zeros(1, int), spec)[0] for p in points])), w)
        variance = np.array([token_variance(q, p, spec) for p in points])
        return pa.table({"query_id": table.column("query_id"), "doc_id": table.column("doc_id"), "score": solvers.helmholtz_kalman(token, smooth, w, variance, beta)})

    solved = rows.select("query_id", "doc_id", "c0", "points", "qp").groupBy("query_id").applyInArrow(run, f"query_id bigint, doc_id {kind}, score double")
    return _ranked(solved, k)


def token_variance(q: np.ndarray, p: np.ndarray, spec: SubspaceSpec) -> float:
    """Population variance over the document's points of their largest mean subspace cosine with the query; zero sub-vectors count 0."""
    return float(((1 - sub_distances(q, p, spec, PLAIN)).mean(axis=0)).max(axis=0).var())


# -- several indices -------------------------------------------------------------
def cascade(queries: DataFrame, indices: dict[str, DataFrame], refs: DataFrame | None, sizes: dict[str, int], boost: float = 1.5) -> DataFrame:
    """``query_id, source, doc_id, score, rank`` over statute, case, judgment and literature.

    ``indices`` map a name to (doc_id, points); a missing one gives no rows. Cases
    that cite a found statute (``refs``: case_id, statute_id) get their score times
    ``boost`` among the first 2k, and are cut to k."""
    out = []
    first = queries.where("size(points) > 0").select(F.size(F.get("points", F.lit(0))).alias("n")).first()
    dim = first.n if first else 1

    def search(name: str, k: int) -> DataFrame | None:
        docs = indices.get(name)
        if docs is None or k <= 0:
            return None
        hits = scan(queries, docs, "centroid_cosine", SubspaceSpec(1, dim), k)
        return hits.select("query_id", "doc_id", (1 - F.col("value")).alias("score"))

    statutes = search("statute", sizes.get("statute", 0))
    if statutes is not None:
        out.append(("statute", statutes, sizes["statute"]))
    cases = search("case", 2 * sizes.get("case", 0))
    if cases is not None:
        if statutes is not None and refs is not None:
            cited = refs.join(statutes.select("query_id", F.col("doc_id").alias("statute_id")), "statute_id").select("query_id", F.col("case_id").alias("doc_id")).distinct().withColumn("anchored", F.lit(True))
            cases = cases.join(cited, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.when(F.col("anchored"), F.col("score") * boost).otherwise(F.col("score")).alias("score"))
        out.append(("case", cases, sizes["case"]))
    for name in ("judgment", "literature"):
        hits = search(name, sizes.get(name, 0))
        if hits is not None:
            out.append((name, hits, sizes[name]))
    parts = [_ranked(hits, k).select("query_id", F.lit(name).alias("source"), "doc_id", "score", "rank") for name, hits, k in out]
    if not parts:
        return queries.select("query_id", F.lit("").alias("source"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank")).where("false")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union
