"""Product quantization: codebooks, codes, posting lists, lookup-table distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import LOOKUP, PLAIN, SubspaceSpec, cosine_similarity, kernel_distance, l2_squared, sub_vectors
from vectide.operators.clouds import arrow_clouds
from vectide.operators.kernels import sub_distances


def sub_rows(points: DataFrame, spec: SubspaceSpec) -> DataFrame:
    """``doc_id, point_idx, subspace, sv``."""
    return points.select("doc_id", "point_idx", F.posexplode(sub_vectors(F.col("vec"), spec)).alias("subspace", "sv"))


def _small(book: DataFrame) -> DataFrame:
    """A codebook is parts x centroids rows, at most 65,536 by its one- or two-byte codes; checked here."""
    if book.limit(65_537).count() > 65_536:
        raise ValueError("a codebook has at most 65,536 centroids")
    return F.broadcast(book)


class Codebook:
    """A codebook in numpy, for tasks: per subspace the centroids' numbers, ascending, and
    their vectors. At most 65,536 rows (one- or two-byte codes), checked here."""

    def __init__(self, book: DataFrame, spec: SubspaceSpec) -> None:
        rows = book.where(F.size("vec") == spec.width).select("subspace", "centroid", "vec").limit(65_537).collect()
        if len(rows) > 65_536:
            raise ValueError("a codebook has at most 65,536 centroids")
        self.spec, self.ids, self.vecs = spec, [], []
        for part in range(spec.parts):
            mine = sorted((r.centroid, r.vec) for r in rows if r.subspace == part)
            if not mine:
                raise ValueError(f"subspace {part} has no centroid")
            self.ids.append(np.array([c for c, _ in mine], np.int32))
            self.vecs.append(np.array([v for _, v in mine], np.float64))

    def nearest(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """points x subspaces x n: the nearest centroids by squared distance, of equals the smaller number."""
        out = np.empty((len(x), self.spec.parts, n), np.int32)
        for part, (ids, c) in enumerate(zip(self.ids, self.vecs)):
            y = x[:, part * self.spec.width : (part + 1) * self.spec.width]
            for at in range(0, len(y), max(1, (1 << 22) // c.size)):
                d = ((y[at : at + max(1, (1 << 22) // c.size), None, :] - c[None]) ** 2).sum(axis=2)
                best = d.argmin(axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
                out[at : at + len(d), part, : best.shape[1]] = ids[best]
        return out

    def rebuilt(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([v[np.searchsorted(i, codes[:, s])] for s, (i, v) in enumerate(zip(self.ids, self.vecs))], axis=1)

    def lookup(self, q: np.ndarray) -> list[np.ndarray]:
        """Per subspace query points x centroids: the distances, not below 0."""
        w = self.spec.width
        return [sub_distances(q[:, s * w : (s + 1) * w], v, SubspaceSpec(1, w), LOOKUP)[0] for s, v in enumerate(self.vecs)]


def _nearest_rows(points: DataFrame, book: Codebook, n: int) -> DataFrame:
    """``doc_id, point_idx, codes ARRAY<ARRAY<INT>>`` (subspaces x n); rows are worked on where they lie."""
    kinds = dict(points.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            codes = book.nearest(x, n)
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, n, dtype=np.int32)), pa.array(codes.ravel()))
            outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, book.spec.parts, dtype=np.int32)), inner)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), outer], names=["doc_id", "point_idx", "codes"])

    rows = points.where(F.size("vec") == book.spec.dim).select("doc_id", "point_idx", "vec")
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, point_idx {kinds['point_idx']}, codes array<array<int>>")


def encode(points: DataFrame, book: DataFrame, spec: SubspaceSpec) -> DataFrame:
    """``doc_id, point_idx, subspace, code``: the nearest centroid by squared distance, of
    equals the smaller. No shuffle: the codebook goes to the points."""
    near = _nearest_rows(points, Codebook(book, spec), 1)
    return near.select("doc_id", "point_idx", F.posexplode("codes").alias("subspace", "c")).select("doc_id", "point_idx", "subspace", F.get("c", F.lit(0)).alias("code"))


def encode_clouds(docs: DataFrame, book: DataFrame, spec: SubspaceSpec) -> DataFrame:
    """``doc_id, codes``: points x subspaces of every nested cloud."""
    b, kind = Codebook(book, spec), dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, starts = arrow_clouds(batch.column(1))
            codes = b.nearest(p)[:, :, 0]
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, spec.parts, dtype=np.int32)), pa.array(codes.ravel()))
            outer = pa.ListArray.from_arrays(pa.array(np.append(starts, len(p)).astype(np.int32)), inner)
            yield pa.RecordBatch.from_arrays([batch.column(0), outer], names=["doc_id", "codes"])

    return docs.where("size(points) > 0").select("doc_id", "points").mapInArrow(run, f"doc_id {kind}, codes array<array<int>>")


def packed_codes(codes: DataFrame) -> DataFrame:
    """``doc_id, point_idx, codes ARRAY<INT>`` in order of subspace."""
    p = codes.groupBy("doc_id", "point_idx").agg(F.array_sort(F.collect_list(F.struct("subspace", "code"))).alias("p"))
    return p.select("doc_id", "point_idx", F.transform("p", lambda x: x["code"]).alias("codes"))


def reconstruct(codes: DataFrame, book: DataFrame) -> DataFrame:
    """``doc_id, point_idx, vec`` from the centroids of the codes."""
    rows = codes.join(_small(book.select("subspace", F.col("centroid").alias("code"), F.col("vec").alias("cv"))), ["subspace", "code"])
    p = rows.groupBy("doc_id", "point_idx").agg(F.array_sort(F.collect_list(F.struct("subspace", "cv"))).alias("p"))
    return p.select("doc_id", "point_idx", F.flatten(F.transform("p", lambda x: x["cv"])).alias("vec"))


def quality(points: DataFrame, book: DataFrame, spec: SubspaceSpec) -> DataFrame:
    """One row: mean squared error, cosine of the rebuilding (mean, p10, p50, p90) and compression."""
    both = points.join(reconstruct(encode(points, book, spec), book).withColumnRenamed("vec", "rv"), ["doc_id", "point_idx"])
    cos, mse = cosine_similarity(F.col("vec"), F.col("rv")), l2_squared(F.col("vec"), F.col("rv")) / spec.dim
    rows = both.select(cos.alias("c"), mse.alias("e"))
    return rows.agg(
        F.count("*").alias("n"), F.avg("e").alias("mse"), F.avg("c").alias("cos_mean"), F.percentile("c", F.lit(0.1)).alias("cos_p10"), F.percentile("c", F.lit(0.5)).alias("cos_p50"),
        F.percentile("c", F.lit(0.9)).alias("cos_p90"), F.lit(float(4 * spec.dim / spec.parts)).alias("compression"),
    )


def postings(points: DataFrame, book: DataFrame, spec: SubspaceSpec) -> DataFrame:
    """``subspace, centroid, doc_id, point_idx``: one posting per point and subspace."""
    return encode(points, book, spec).select("subspace", F.col("code").alias("centroid"), "doc_id", "point_idx")


def rebuilt_clouds(codes: DataFrame, book: DataFrame, spec: SubspaceSpec) -> DataFrame:
    """``doc_id, points`` from nested codes."""
    b, kind = Codebook(book, spec), dict(codes.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c, starts = arrow_clouds(batch.column(1))
            x = b.rebuilt(c.astype(int))
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, spec.dim, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)).astype(np.int32)), inner)], names=["doc_id", "points"])

    return codes.where("size(codes) > 0").select("doc_id", "codes").mapInArrow(run, f"doc_id {kind}, points array<array<double>>")


def posting_counts(codes: DataFrame) -> DataFrame:
    """``subspace, centroid, doc_id, n`` of nested codes: how many of a document's points lie under each centroid."""
    points = codes.select("doc_id", F.explode("codes").alias("c")).select("doc_id", F.posexplode("c").alias("subspace", "centroid"))
    return points.groupBy("subspace", "centroid", "doc_id").agg(F.count("*").alias("n"))


def hits_of_counts(query_points: DataFrame, counts: DataFrame, book: DataFrame, spec: SubspaceSpec, probes: int = 1) -> DataFrame:
    """``query_id, doc_id, hits``: every posting under the ``probes`` nearest centroids of
    each query point and subspace counts. Posting counts are joined, not postings, so a
    hot list costs one row a document."""
    near = _nearest_rows(query_points, Codebook(book, spec), probes).select(F.col("doc_id").alias("query_id"), F.posexplode("codes").alias("subspace", "c"))
    asked = near.select("query_id", "subspace", F.explode("c").alias("centroid")).groupBy("query_id", "subspace", "centroid").agg(F.count("*").alias("times"))
    return counts.join(asked, ["subspace", "centroid"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * F.col("n")).alias("hits"))


def posting_hits(query_points: DataFrame, posted: DataFrame, book: DataFrame, spec: SubspaceSpec, probes: int = 1) -> DataFrame:
    """The same from single postings."""
    return hits_of_counts(query_points, posted.groupBy("subspace", "centroid", "doc_id").agg(F.count("*").alias("n")), book, spec, probes)


def lookup_values(pairs: DataFrame, queries: DataFrame, codes: DataFrame, book: DataFrame, spec: SubspaceSpec) -> DataFrame:
    """``query_id, doc_id, value`` of listed pairs: Chamfer from a lookup table of each query
    and the documents' stored codes; no vector of a document is read."""
    b, kind = Codebook(book, spec), dict(codes.dtypes)["doc_id"]
    rows = pairs.select("query_id", "doc_id").join(queries.select("query_id", F.col("points").alias("qp")), "query_id").join(codes, "doc_id").where("size(qp) > 0 and size(codes) > 0").select("query_id", "doc_id", "qp", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, table = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            q, qs = arrow_clouds(batch.column(2))
            c, cs = arrow_clouds(batch.column(3))
            ids = batch.column(0).to_pylist()
            out = []
            for i, x, y in zip(ids, np.split(q, qs[1:]), np.split(c.astype(int), cs[1:])):
                if i != last:
                    last, table = i, b.lookup(x)
                parts = [t[:, np.searchsorted(n, y[:, s])] for s, (t, n) in enumerate(zip(table, b.ids))]
                out.append(float(np.mean([d.min(axis=1).mean() + d.min(axis=0).mean() for d in parts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["query_id", "doc_id", "value"])

    return rows.sortWithinPartitions("query_id").mapInArrow(run, f"query_id bigint, doc_id {kind}, value double")


def lookup_table(query_points: DataFrame, book: DataFrame, spec: SubspaceSpec) -> DataFrame:
    """``query_id, qi, subspace, code, d``: distances of query points to every centroid, not below 0."""
    rows = sub_rows(query_points, spec).join(_small(book.select("subspace", F.col("centroid").alias("code"), F.col("vec").alias("cv"))), "subspace")
    return rows.select(F.col("doc_id").alias("query_id"), F.col("point_idx").alias("qi"), "subspace", "code", kernel_distance(F.col("sv"), F.col("cv"), LOOKUP).alias("d"))


def _two_sided(pairs: DataFrame) -> DataFrame:
    """``query_id, doc_id, value`` of rows (query_id, doc_id, s, qi, di, d): subspace-first Chamfer."""
    there = pairs.groupBy("query_id", "doc_id", "s", "qi").agg(F.min("d").alias("m")).groupBy("query_id", "doc_id", "s").agg(F.avg("m").alias("x"))
    back = pairs.groupBy("query_id", "doc_id", "s", "di").agg(F.min("d").alias("m")).groupBy("query_id", "doc_id", "s").agg(F.avg("m").alias("y"))
    return there.join(back, ["query_id", "doc_id", "s"]).groupBy("query_id", "doc_id").agg(F.avg(F.col("x") + F.col("y")).alias("value"))


def lookup_chamfer(query_points: DataFrame, codes: DataFrame, book: DataFrame, spec: SubspaceSpec) -> DataFrame:
    """Chamfer from the lookup table and the documents' codes alone."""
    table = lookup_table(query_points, book, spec)
    return _two_sided(codes.join(table, ["subspace", "code"]).select("query_id", "doc_id", F.col("subspace").alias("s"), "qi", F.col("point_idx").alias("di"), "d"))


def relational_chamfer(query_points: DataFrame, points: DataFrame, spec: SubspaceSpec, kernel=PLAIN) -> DataFrame:
    """The relational form of the subspace-first distance: joined by subspace, two
    minima and means. The query side must be a stated small set."""
    q = sub_rows(query_points, spec).select(F.col("doc_id").alias("query_id"), F.col("point_idx").alias("qi"), F.col("subspace").alias("s"), F.col("sv").alias("a"))
    d = sub_rows(points, spec).select("doc_id", F.col("point_idx").alias("di"), F.col("subspace").alias("s"), F.col("sv").alias("b"))
    return _two_sided(d.join(q, "s").select("query_id", "doc_id", "s", "qi", "di", kernel_distance(F.col("a"), F.col("b"), kernel).alias("d")))


def train(points: DataFrame, spec: SubspaceSpec, k: int | list[int], rounds: int = 20, sample: int = 65_536, seed: int = 0) -> DataFrame:
    """``subspace, centroid, vec``: k-means in every subspace, one task each; ``k`` may
    differ by subspace.

    Started on evenly spaced rows in order of (doc_id, point_idx); an empty cluster
    keeps its centre; with fewer rows than k, rows are used again in turn. Fitted on
    at most ``sample`` points, the smallest by a hash of their key; all points are
    encoded with the result.
    """
    picked = points.orderBy(F.xxhash64("doc_id", "point_idx", F.lit(seed))).limit(sample)
    sizes = [k] * spec.parts if isinstance(k, int) else list(k)
    if len(sizes) != spec.parts:
        raise ValueError("a number of centroids for every subspace")

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        k = sizes[int(f.subspace.iloc[0])]
        f = f.sort_values(["doc_id", "point_idx"])
        x = np.stack(f.sv.to_list()).astype(np.float64)
        n = len(x)
        c = x[(np.arange(k) * (n // k)) if n >= k else np.arange(k) % n].copy()
        for _ in range(rounds):
            a = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(axis=1)
            count = np.bincount(a, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, a, x)
            c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        return pd.DataFrame({"subspace": int(f.subspace.iloc[0]), "centroid": np.arange(k), "vec": list(c)})

    return sub_rows(picked, spec).groupBy("subspace").applyInPandas(fit, "subspace int, centroid int, vec array<double>")


def subspace_variance(points: DataFrame, spec: SubspaceSpec) -> DataFrame:
    """``subspace, variance``: mean of the dimensions' population variances."""
    parts = points.select(F.posexplode("vec").alias("i", "x"))
    v = parts.groupBy("i").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    return v.groupBy(F.floor(F.col("i") / spec.width).cast("int").alias("subspace")).agg(F.avg("v").alias("variance"))


def allocate_bits(variances: list[float], total: int, least: int = 4, most: int = 12, slope: float = 1.5, inverse: bool = False) -> list[int]:
    """Bits per subspace: 8 + ``slope`` * log2(variance / mean variance), rounded and within
    bounds, then made to add to ``total`` one at a time, from the largest variance down
    where bits are missing and from the smallest up where there are too many, over and
    over within the bounds. ``inverse``: the control that gives bits to small variances."""
    v = np.maximum(np.asarray(variances, float), 1e-30)
    if inverse:
        v = 1.0 / (v + 1e-9)
    bits = np.clip(np.round(8 + slope * np.log2(v / v.mean())), least, most).astype(int)
    gap = int(total - bits.sum())
    step, order = (1 if gap > 0 else -1), np.argsort(-v if gap > 0 else v, kind="stable")
    while gap:
        before = gap
        for s in order:
            if gap and least <= bits[s] + step <= most:
                bits[s] += step
                gap -= step
        if gap == before:
            break  # the bounds allow no more
    return bits.tolist()
