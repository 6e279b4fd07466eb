"""Every query cloud against every document cloud, with a bounded result.

The documents stay where they are: each task holds a block of queries (checked
to be at most ``BLOCK_BYTES``; more queries make more blocks, one pass each) and
keeps the k best documents of each query while its partition streams by. Only
those, partitions x queries x k rows, are shuffled.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.vectors import SubspaceSpec
from vectide.operators.clouds import arrow_clouds
from vectide.operators.kernels import METRICS, ROWS, SIMILARITIES, TOGETHER, TOLERANCE, subspace_first_pieces, subspace_minima, unit_distances, unit_groups, units
from vectide.shared import stored

BLOCK_BYTES = 64 << 20
#: Distances that are held at once.
PIECE = 1 << 22


def query_blocks(queries: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(query id, points) in blocks of bounded size; the driver holds one block."""
    block, size = [], 0
    for row in queries.select("query_id", "points").where("query_id is not null and size(points) > 0").toLocalIterator(prefetchPartitions=True):
        points = np.asarray(row.points, dtype=np.float64)
        if block and size + points.nbytes > limit:
            yield block
            block, size = [], 0
        block.append((row.query_id, points))
        size += points.nbytes
    if block:
        yield block


def _scan_block(docs: DataFrame, block: list, metric: str, spec: SubspaceSpec, k: int | None, options: dict) -> DataFrame:
    sign = -1.0 if metric in SIMILARITIES else 1.0
    kind = dict(docs.dtypes)["doc_id"]

    together = TOGETHER.get(metric) if not options else None

    def measured(p: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first query, queries x documents), in pieces of bounded size."""
        if together is None:
            for j, (_, q) in enumerate(block):
                yield j, METRICS[metric](q, p, starts, spec, **options)[None]
            return
        room, at = max(1, PIECE // max(1, len(p) * spec.parts)), 0
        while at < len(block):
            end, n = at + 1, len(block[at][1])
            while end < len(block) and n + len(block[end][1]) <= room:
                n += len(block[end][1])
                end += 1
            qs = np.cumsum([0, *[len(q) for _, q in block[at : end - 1]]])
            yield at, together(np.concatenate([q for _, q in block[at:end]]), qs, p, starts, spec)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=object)) for _ in block]
        edge = np.full(len(block), np.inf)  # of each query the k-th value so far
        for batch in batches:
            if not batch.num_rows:
                continue
            p, starts = arrow_clouds(batch.column(1))
            ids = np.asarray(batch.column(0).to_pylist(), dtype=object)
            for first, values in measured(p, starts):
                values = sign * values
                near = values <= edge[first : first + len(values), None]
                for r in np.flatnonzero(near.any(axis=1)):
                    j, cols = first + r, np.flatnonzero(near[r])
                    d, i = np.concatenate([best[j][0], values[r, cols]]), np.concatenate([best[j][1], ids[cols]])
                    if k is not None and len(d) >= k:
                        edge[j] = np.partition(d, k - 1)[k - 1]
                        rows = np.flatnonzero(d <= edge[j])
                        rows = rows[np.lexsort((i[rows], d[rows]))[:k]]
                        d, i = d[rows], i[rows]
                    best[j] = (d, i)
        out_q = np.concatenate([np.full(len(d), b[0]) for b, (d, _) in zip(block, best)]) if block else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_q, pa.int64()), pa.array(np.concatenate([i for _, i in best]).tolist(), _arrow(kind)), pa.array(sign * np.concatenate([d for d, _ in best]))],
            names=["query_id", "doc_id", "value"],
        )

    return docs.select("doc_id", "points").where("doc_id is not null and size(points) > 0").mapInArrow(run, f"query_id bigint, doc_id {kind}, value double")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def scan(queries: DataFrame, docs: DataFrame, metric: str, spec: SubspaceSpec, k: int | None = None, exclude: DataFrame | None = None, **options) -> DataFrame:
    """``query_id, doc_id, value, rank``: the k best documents of each query (all, if k
    is None), ties by document. ``queries`` has (query_id BIGINT, points), ``docs``
    (doc_id, points); empty clouds are skipped; ``exclude`` lists doc_ids to leave out.
    k = 0 and empty sides give no rows."""
    if exclude is not None:
        docs = docs.join(exclude.select("doc_id").distinct(), "doc_id", "left_anti")
    if k is not None and k <= 0:
        return docs.select(F.lit(0).cast("bigint").alias("query_id"), "doc_id", F.lit(0.0).alias("value"), F.lit(0).cast("bigint").alias("rank")).where("false")
    out = None
    for block in query_blocks(queries):
        one = _scan_block(docs, block, metric, spec, k, options)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return scan(queries, docs, metric, spec, 0)
    order = F.desc("value") if metric in SIMILARITIES else F.col("value")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "doc_id")).cast("bigint"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _candidates(block: list, spec: SubspaceSpec, k: int):
    """Of a partition of clouds the documents that may be among a query's k nearest: all within
    twice the tolerance of the k-th fast distance. Of clouds that are equal the k smallest ids
    at least remain; no more of them can be among the k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, odd_queries = unit_groups([q for _, q in block], spec)
        edge = np.full(len(block), np.inf)
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        found, waiting, kept = [none], 0, 0
        equal: dict[bytes, list[int]] = {}

        def take(js: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
            """``values``: documents x queries."""
            nonlocal waiting
            r, c = np.nonzero(values <= edge[js])
            if len(r):
                found.append((js[c], ids[r], values[r, c]))
                waiting += len(r)
                if waiting > max(1 << 18, kept):
                    settle()

        def settle() -> None:
            nonlocal found, waiting, kept
            j, i, d = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((d, j))
            j, i, d = j[order], i[order], d[order]
            first = np.searchsorted(j, np.arange(len(block)))
            full = np.flatnonzero(np.diff(np.append(first, len(j))) >= k)
            edge[full] = d[first[full] + k - 1] + 2 * TOLERANCE
            near = d <= edge[j]
            found, waiting, kept = [(j[near], i[near], d[near])], 0, int(near.sum())

        for batch in batches:
            if not batch.num_rows:
                continue
            p, starts = arrow_clouds(batch.column(1))
            ids, sizes = batch.column(0).to_numpy(), np.diff(np.append(starts, len(p)))
            ask = np.ones(len(ids), dtype=bool)
            for x in np.argsort(ids):
                same = equal.setdefault(blake2b(p[starts[x] : starts[x] + sizes[x]].tobytes(), digest_size=16).digest(), [])
                ask[x] = len(same) < k or ids[x] < same[k - 1]
                if ask[x]:
                    insort(same, int(ids[x]))
            unit, odd = units(p, spec)
            odd = np.logical_or.reduceat(odd, starts)
            for n in np.unique(sizes[ask & ~odd]):
                own = np.flatnonzero(ask & ~odd & (sizes == n))
                for at in range(0, len(own), max(1, ROWS // n)):
                    xs = own[at : at + max(1, ROWS // n)]
                    docs = np.ascontiguousarray(unit[(starts[xs] + np.arange(n)[:, None]).ravel()].transpose(1, 0, 2))
                    for g in groups:
                        take(g[0], ids[xs], unit_distances(docs, int(n), g))
            for x in np.flatnonzero(ask & odd):
                doc, one = p[starts[x] : starts[x] + sizes[x]], np.zeros(1, dtype=np.int64)
                for j, (_, q) in enumerate(block):
                    take(np.array([j]), ids[x : x + 1], subspace_first_pieces(q, doc, one, spec)[:, None])
            plain = np.flatnonzero(ask & ~odd)
            for j in odd_queries if len(plain) else ():
                take(np.array([j]), ids[plain], subspace_first_pieces(block[j][1], p, starts, spec)[plain, None])
        settle()
        j, i, d = found[0]
        names = np.array([b[0] for b in block], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names[j], pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "doc_id", "value"])

    return run


def _listed(block: list, spec: SubspaceSpec):
    """``subspace_first`` of each document (doc_id, points, asked) with the queries it lists."""
    clouds = dict(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.zeros(1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            p, starts = arrow_clouds(batch.column(1))
            asked = batch.column(2).to_pylist()
            out = [subspace_first_pieces(clouds[j], x, one, spec)[0] for x, js in zip(np.split(p, starts[1:]), asked) for j in js]
            ids = np.repeat(batch.column(0).to_numpy(), [len(js) for js in asked])
            yield pa.RecordBatch.from_arrays([pa.array([j for js in asked for j in js], pa.int64()), pa.array(ids, pa.int64()), pa.array(out, pa.float64())], names=["query_id", "doc_id", "value"])

    return run


def _backs(block: list, spec: SubspaceSpec):
    """Of points (doc_id, vec): for every query and document the sum of the points' least
    distances to the query, and their number. Points and queries of small norms count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, _ = unit_groups([q for _, q in block], spec)
        sums: dict[int, np.ndarray] = {}
        seen: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1)
            p, docs = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1), batch.column(0).to_numpy()
            unit, odd = units(p, spec)
            for doc in np.unique(docs):
                total = sums.setdefault(int(doc), np.zeros(len(block)))
                seen[int(doc)] = seen.get(int(doc), 0) + int((docs == doc).sum())
                own = np.flatnonzero((docs == doc) & ~odd)
                for at in range(0, len(own), ROWS):
                    x = np.ascontiguousarray(unit[own[at : at + ROWS]].transpose(1, 0, 2))
                    for g in groups:
                        total[g[0]] += unit_distances(x, x.shape[1], g, back_only=True)[0] * x.shape[1]
        names = [b[0] for b in block]
        for doc, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([doc] * len(names), pa.int64()), pa.array(total), pa.array([seen[doc]] * len(names), pa.int64())], names=["query_id", "doc_id", "total", "n"])

    return run


def _block_part(asked: list, spec: SubspaceSpec):
    """Of a block of one document's points: for every query the least distances and their sum."""

    def run(table: pa.Table) -> pa.Table:
        p = np.asarray(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(table.num_rows, -1)
        ids, least, total = [], [], []
        for query_id, q in asked:
            near, back = subspace_minima(q, p, np.zeros(1, dtype=np.int64), spec)
            ids.append(query_id)
            least.append(near[:, :, 0].tobytes())
            total.append(float(back.mean(axis=0).sum()))
        n = len(ids)
        doc = table.column("doc_id")[0].as_py()
        return pa.table({"query_id": pa.array(ids, pa.int64()), "doc_id": pa.array([doc] * n, pa.int64()), "least": pa.array(least, pa.binary()), "total": pa.array(total, pa.float64()), "n": pa.array([table.num_rows] * n, pa.int64())})

    return run


def _merge_blocks(table: pa.Table) -> pa.Table:
    least = np.min([np.frombuffer(b, dtype=float) for b in table.column("least").to_pylist()], axis=0)
    value = least.mean() + sum(table.column("total").to_pylist()) / sum(table.column("n").to_pylist())
    return pa.table({"query_id": table.column("query_id").slice(0, 1), "doc_id": table.column("doc_id").slice(0, 1), "value": [float(value)]})


def scan_points(queries: DataFrame, points: DataFrame, spec: SubspaceSpec, k: int, cap: int = 8192) -> DataFrame:
    """``scan`` with the subspace-first distance on long points (doc_id BIGINT, point_idx, vec),
    for documents of any size.

    Documents of at most ``cap`` points are nested and measured with all queries in single
    precision, whose error is bounded; what may be among the k nearest by that is measured
    again in double, and this alone counts. A larger document is never held by a task: the
    mean of its points' least distances, a sum over its points, is at most its distance, and
    only for queries where that is within the k-th of the others its blocks of about ``cap``
    points are measured and their minima and sums merged exactly. Query clouds of any size
    are compared in pieces of points; a task holds a block of queries, never its distances
    to a batch. Null vectors and ids drop out. ``points`` is read several times.
    """
    from vectide.operators.clouds import nested

    rows = points.where(F.col("doc_id").isNotNull() & (F.size("vec") == spec.dim)).select("doc_id", "point_idx", "vec")
    if k <= 0:
        return scan(queries, nested(rows), "subspace_first", spec, 0)
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > cap).select("doc_id", F.ceil(F.col("n") / cap).cast("int").alias("blocks"))
    spark = rows.sparkSession
    # small rows with long work: a number of partitions that Spark does not merge; at the session's own it takes those of the join, merged
    room = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    cold = nested(rows.join(hot.select("doc_id"), "doc_id", "left_anti").repartition(room, "doc_id"))
    some_hot = not hot.isEmpty()
    parts = None
    for block in query_blocks(queries):
        w = Window.partitionBy("query_id")
        fast = cold.mapInArrow(_candidates(block, spec, k), "query_id bigint, doc_id bigint, value double")
        ranked = fast.withColumn("r", F.row_number().over(w.orderBy("value", "doc_id"))).withColumn("edge", F.max(F.when(F.col("r") <= k, F.col("value"))).over(w))
        pairs = ranked.where(F.col("value") <= F.col("edge") + 2 * TOLERANCE).groupBy("doc_id").agg(F.collect_list("query_id").alias("asked"))
        near = cold.join(stored(pairs, "scan_pairs"), "doc_id").select("doc_id", "points", "asked").mapInArrow(_listed(block, spec), "query_id bigint, doc_id bigint, value double")
        near = stored(top_k(near, k), "scan_near")
        parts = near.drop("rank") if parts is None else parts.unionByName(near.drop("rank"))
        if some_hot:
            least = rows.join(hot.select("doc_id"), "doc_id").select("doc_id", F.col("vec").cast("array<double>").alias("vec")).repartition(room)
            least = least.mapInArrow(_backs(block, spec), "query_id bigint, doc_id bigint, total double, n bigint").groupBy("query_id", "doc_id").agg((F.sum("total") / F.sum("n")).alias("least"))
            last = near.where(F.col("rank") == k).select("query_id", F.col("value").alias("edge"))
            open_ = {r.query_id for r in least.join(last, "query_id", "left").where(F.col("edge").isNull() | (F.col("least") - TOLERANCE <= F.col("edge"))).select("query_id").distinct().toLocalIterator()}
            asked = [x for x in block if x[0] in open_]
            if asked:
                blocks = rows.join(hot, "doc_id").select("doc_id", F.pmod(F.xxhash64("point_idx", F.lit(5)), "blocks").cast("int").alias("block"), F.col("vec").cast("array<double>").alias("vec"))
                partial = blocks.repartition(room, "doc_id", "block").groupBy("doc_id", "block").applyInArrow(_block_part(asked, spec), "query_id bigint, doc_id bigint, least binary, total double, n bigint")
                parts = parts.unionByName(partial.groupBy("query_id", "doc_id").applyInArrow(_merge_blocks, "query_id bigint, doc_id bigint, value double"))
    return scan(queries, nested(rows), "subspace_first", spec, 0) if parts is None else top_k(parts, k)


def pair_values(pairs: DataFrame, queries: DataFrame, docs: DataFrame, metric: str, spec: SubspaceSpec, **options) -> DataFrame:
    """``query_id, doc_id, value`` of listed pairs: two equi-joins, then the kernel on
    each row. Pairs whose query or document is unknown or empty drop out."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = (
        pairs.select("query_id", "doc_id")
        .join(queries.select("query_id", F.col("points").alias("qp")), "query_id")
        .join(docs.select("doc_id", F.col("points").alias("dp")), "doc_id")
        .where("size(qp) > 0 and size(dp) > 0")
        .select("query_id", "doc_id", "qp", "dp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = METRICS[metric]
        for batch in batches:
            if not batch.num_rows:
                continue
            q, qs = arrow_clouds(batch.column(2))
            p, ps = arrow_clouds(batch.column(3))
            one = np.zeros(1, dtype=np.int64)
            out = [measure(a, b, one, spec, **options)[0] for a, b in zip(np.split(q, qs[1:]), np.split(p, ps[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["query_id", "doc_id", "value"])

    return rows.mapInArrow(run, f"query_id bigint, doc_id {kind}, value double")


def top_k(scores: DataFrame, k: int, value: str = "value", ascending: bool = True, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The k best rows of each group with their rank from 1; nulls and NaN drop out."""
    order = F.col(value) if ascending else F.desc(value)
    rows = scores.where(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, item)).cast("bigint")).where(F.col("rank") <= k)
