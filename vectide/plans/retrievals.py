"""Queries of the retrieval pipelines; every cloud whose id is divisible by 20 asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from vectide.operators import expansion, fusion, graph, index, metrics, retrieval, scan
from vectide.operators.clouds import centroids, nested
from vectide.plans import base
from vectide.plans.base import BOOK, PTS, SPEC, SUB, chamfer_sql, top_sql
from vectide.plans.vectors import ADC, CENTROID_SCAN, FAR, NEAR_PROBE
from vectide.plans.vectors import ORACLES as ORACLES_OF_CLOUDS

QUERIES, ORACLES = {}, {}
K, N = 10, 20


def _out(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "doc_id", (F.round("score", 6) + 0.0).alias("score"), "rank")


def _prepared(name: str, f, sql: str) -> None:
    """A pipeline on the prepared tables of the folder."""

    def run(spark, folder):
        c, made = base.prepared(spark, folder)
        return _out(f(c, made))

    QUERIES[name], ORACLES[name] = run, sql


def _add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: _out(f(base.corpus(spark, folder), spark, folder))
    if sql:
        ORACLES[name] = sql


COS = ", cham as (select query_id, doc_id, greatest(0.0, least(2.0, 1 - list_dot_product(qv, c) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(c, c))))) as value from q, cent where qi = 0)"
_add("cosine_rank", lambda c, *_: retrieval.cosine_rank(c, K), "with " + PTS + COS + top_sql("value", "cham", K, out="1 - value"))
_add("full_scan", lambda c, *_: retrieval.full_scan(c, K), "with " + SUB + chamfer_sql("sdist", subspace_first=False) + top_sql("value", "cham", K, out="1 - value"))
_add(
    "full_scan_excluding",
    lambda c, *_: retrieval.full_scan(c, K, exclude=c.queries.select(F.col("query_id").alias("doc_id"))),
    "with " + SUB + chamfer_sql("sdist", subspace_first=False) + ", kept as (select * from cham where doc_id % 20 <> 0)" + top_sql("value", "kept", K, out="1 - value"),
)
_add("token_rank", lambda c, *_: retrieval.token_rank(c, K), "with " + SUB + chamfer_sql() + top_sql("value", "cham", K, out="exp(-2 * value)"))

COARSE = CENTROID_SCAN.replace("cham as", "cen as") + ", cand as (select query_id, doc_id, value as cv from (select *, row_number() over (partition by query_id order by value, doc_id) as r from cen) where r <= {n})"
STAGED = SUB + COARSE.format(n=N) + chamfer_sql() + ", kept as (select cham.* from cham join cand using (query_id, doc_id))"
_add("two_stage", lambda c, *_: retrieval.two_stage(c, N, K), "with " + STAGED + top_sql("value", "kept", K, out="exp(-2 * value)"))
_add("two_stage_density", lambda c, *_: retrieval.two_stage(c, N, K, "density_chamfer", near=3, weight_query=True),
     ORACLES_OF_CLOUDS["cloud_density_weights"].split("select doc_id, point_idx, round(")[0]
     + """, wt as (select doc_id, point_idx as di, (1 / (m + 1e-8)) / sum(1 / (m + 1e-8)) over (partition by doc_id) as w from near),
    t1 as (select m.query_id, m.doc_id, s, sum(m * w) as x from (select query_id, doc_id, s, qi, min(dist) as m from psd group by all) m join wt on wt.doc_id = m.query_id and wt.di = m.qi group by all),
    t2 as (select query_id, doc_id, s, sum(m * w) as y from (select query_id, doc_id, s, di, min(dist) as m from psd group by all) join wt using (doc_id, di) group by all),
    cham as (select query_id, doc_id, avg(x + y) as value from t1 join t2 using (query_id, doc_id, s) group by all)"""
     + COARSE.format(n=N) + ", kept as (select cham.* from cham join cand using (query_id, doc_id))" + top_sql("value", "kept", K, out="exp(-2 * value)"))
_prepared("two_stage_reconstructed", lambda c, m: retrieval.reconstructed_two_stage(c, m.book, N, K, m),
     "with " + SUB + COARSE.format(n=N) + BOOK + """, rec as (select a.doc_id as query_id, a.point_idx as qi, e.doc_id, e.point_idx as di, a.s,
       case when a.n * b.cn < 1e-16 then 1.0 else 1 - list_dot_product(a.v, b.cv) / (a.n * b.cn + 1e-8) end as dist
       from sn a join enc e on a.s = e.subspace join book b on b.subspace = e.subspace and b.centroid = e.code where a.doc_id % 20 = 0)"""
     + chamfer_sql("dist", "rec") + ", kept as (select cham.* from cham join cand using (query_id, doc_id))" + top_sql("value", "kept", K, out="exp(-2 * value)"))
_prepared("two_stage_lookup", lambda c, m: retrieval.lookup_two_stage(c, m.book, N, K, m),
     "with " + SUB + COARSE.format(n=N) + BOOK + ADC + chamfer_sql("dist", "adc") + ", kept as (select cham.* from cham join cand using (query_id, doc_id))" + top_sql("value", "kept", K, out="exp(-2 * value)"))
INVERTED = BOOK + NEAR_PROBE + ", inv as (select query_id, doc_id, hits, row_number() over (partition by query_id order by hits desc, doc_id) as r from hits)"
for _p, _name in ((1, "two_stage_inverted_fast"), (2, "two_stage_inverted")):
    _prepared(_name, lambda c, m, p=_p: retrieval.inverted_two_stage(c, m.book, N, K, p, m),
         "with " + SUB + INVERTED.format(probes=_p) + chamfer_sql() + f", kept as (select cham.* from cham join inv using (query_id, doc_id) where r <= {N})" + top_sql("value", "kept", K, out="exp(-2 * value)"))

_prepared("late_interaction", lambda c, m: retrieval.late_interaction(c, m.book, N, K, 2, m),
     "with " + SUB + INVERTED.format(probes=2) + f""", ip as (select query_id, doc_id, sum(m) as value from (select q.query_id, d.doc_id, qi, max(list_dot_product(qv, dv)) as m from q join inv on inv.query_id = q.query_id and r <= {N} join d on d.doc_id = inv.doc_id group by all) group by all)"""
     + top_sql("value", "ip", K, asc=False))

PROBES = (
    SUB + COARSE.format(n=N) + FAR + """, rs as (select doc_id, s, rv[8*s+1:8*s+8] as v from rep, range(0, 8) t(s)),
  fp as (select query_id, doc_id, max(x) as value from (select a.doc_id as query_id, a.point_idx, b.doc_id, avg(1 - case when a.n * sqrt(list_dot_product(b.v, b.v)) < 1e-16 then 1.0 else 1.0 - list_dot_product(a.v, b.v) / (a.n * sqrt(list_dot_product(b.v, b.v)) + 1e-8) end) as x
    from sn a join rs b on a.s = b.s where a.doc_id % 20 = 0 group by all) group by all)"""
    + INVERTED.format(probes=1)
    + f""", probes as (select query_id, 'centroid' as probe, doc_id, 1 - cv as score from cand
  union all select query_id, 'max_token', doc_id, value from (select *, row_number() over (partition by query_id order by value desc, doc_id) as r from fp) where r <= {N}
  union all select query_id, 'inverted', doc_id, (n - r + 1)::double / n from (select *, count(*) over (partition by query_id) as n from inv where r <= {N})),
  pr as (select *, row_number() over (partition by query_id, probe order by score desc, doc_id) - 1 as r0, min(score) over (partition by query_id, probe) as lo, max(score) over (partition by query_id, probe) as hi from probes),
  pn as (select *, case when hi - lo < 1e-8 then 0.5 else (score - lo) / (hi - lo) end as ns from pr)"""
)
for _strategy, _agg in (("rrf", "sum(1 / (60.0 + r0))"), ("max", "max(ns)"), ("hit", "count(*) * max(ns)")):
    _prepared(f"multi_probe_{_strategy}", lambda c, m, how=_strategy: retrieval.multi_probe(c, m.book, N, K, how, made=m), "with " + PROBES + f", mg as (select query_id, doc_id, {_agg} as value from pn group by all)" + top_sql("value", "mg", K, asc=False))
_prepared("multi_probe_two_stage", lambda c, m: retrieval.multi_probe_two_stage(c, m.book, N, N, K, made=m),
     "with " + PROBES + f", mg as (select query_id, doc_id, sum(1 / (60.0 + r0)) as value from pn group by all), mt as (select * from (select *, row_number() over (partition by query_id order by value desc, doc_id) as r from mg) where r <= {N})" + chamfer_sql()
     + ", kept as (select cham.* from cham join mt using (query_id, doc_id))" + top_sql("value", "kept", K, out="exp(-2 * value)"))


def multi_probe_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Per query the ids of each probe and of the merged list, best first."""
    c, made = base.prepared(spark, folder)
    lists = retrieval.probes(c, made.book, N, made=made)
    merged = scan.top_k(retrieval.MERGES["rrf"](lists).withColumn("probe", F.lit("merged")), N, "score", False).drop("rank")
    every = lists.unionByName(merged).groupBy("query_id", "probe").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "doc_id"))).alias("l"))
    return every.select("query_id", "probe", F.size("l").cast("bigint").alias("n"), F.array_join(F.transform("l", lambda x: x["doc_id"].cast("string")), ",").alias("ids"))


QUERIES["multi_probe_recall"] = multi_probe_recall
ORACLES["multi_probe_recall"] = (
    "with " + PROBES + f", mg as (select query_id, doc_id, sum(1 / (60.0 + r0)) as value from pn group by all), mt as (select * from (select *, row_number() over (partition by query_id order by value desc, doc_id) as r from mg) where r <= {N}),"
    " al as (select query_id, probe, doc_id, score from probes union all select query_id, 'merged', doc_id, value from mt) select query_id, probe, count(*) as n, string_agg(doc_id::varchar, ',' order by round(score, 9) desc, doc_id) as ids from al group by all"
)

# -- graph ---------------------------------------------------------------------------
#: Cosine candidates, their distances, kNN edges and the start field, as CTEs.
GRAPH = (
    SUB + COS.replace("cham as", "cosd as") + f""", cands as (select query_id, doc_id from (select *, row_number() over (partition by query_id order by value, doc_id) as r from cosd) where r <= {N}),
  dp as (select c1.query_id, c1.doc_id as src, c2.doc_id as dst, a.s, a.point_idx as i, b.point_idx as j, case when a.n * b.n < 1e-16 then 1.0 else 1.0 - list_dot_product(a.v, b.v) / (a.n * b.n + 1e-8) end as dist
    from cands c1 join cands c2 on c1.query_id = c2.query_id and c1.doc_id <> c2.doc_id join sn a on a.doc_id = c1.doc_id join sn b on b.doc_id = c2.doc_id and a.s = b.s),
  g1 as (select query_id, src, dst, s, avg(m) as x from (select query_id, src, dst, s, i, min(dist) as m from dp group by all) group by all),
  g2 as (select query_id, src, dst, s, avg(m) as y from (select query_id, src, dst, s, j, min(dist) as m from dp group by all) group by all),
  dd as (select g1.query_id, g1.src, g1.dst, avg(x + y) as d from g1 join g2 using (query_id, src, dst, s) group by all),
  nn as (select query_id, src, dst, exp(-2 * d) as w from (select *, row_number() over (partition by query_id, src order by d, dst) as r from dd) where r <= 3),
  edges as (select * from nn union all select query_id, dst, src, w from nn a where not exists (select 1 from nn b where b.query_id = a.query_id and b.src = a.dst and b.dst = a.src)),
  c0 as (select cands.query_id, cands.doc_id, exp(-2 * value) as c from cands join (select query_id, doc_id, avg(x) as value from (select query_id, doc_id, s, min(dist) + avg(dist) as x from psd where qi = 0 group by all) group by all) z
    on z.query_id = cands.query_id and z.doc_id = cands.doc_id)"""
)


def _steps(alpha: float, steps: int) -> str:
    out = ""
    for t in range(1, steps + 1):
        out += f""", c{t} as (select f.query_id, f.doc_id, greatest(0.0, f.c + {alpha} * coalesce(p.wc / p.ws - f.c, 0.0)) as c from c{t - 1} f left join
          (select e.query_id, e.src as doc_id, sum(e.w * g.c) as wc, sum(e.w) as ws from edges e join c{t - 1} g on g.query_id = e.query_id and g.doc_id = e.dst group by all) p on p.query_id = f.query_id and p.doc_id = f.doc_id)"""
    return out


_add("shape_laplacian", lambda c, *_: retrieval.shape_laplacian(c, K, N, 0.15, 5), "with " + GRAPH + _steps(0.15, 5) + top_sql("c", "c5", K, asc=False, out="c"))





_add("helmholtz_kalman", lambda c, *_: retrieval.helmholtz_kalman(c, K, N))


def _cands(spark, folder):
    c = base.corpus(spark, folder)
    return c, retrieval.fetch(c, scan.scan(c.queries, c.docs, "centroid_cosine", SPEC, N))


def graph_distances(spark, folder):
    """Pair distances of each query's candidates, relational."""
    _, rows = _cands(spark, folder)
    return graph.pair_distances(rows, SPEC).select("query_id", "src", "dst", (F.round("d", 6) + 0.0).alias("d"))


def graph_edges(spark, folder):
    _, rows = _cands(spark, folder)
    return graph.knn_edges(graph.pair_distances(rows, SPEC), 3).select("query_id", "src", "dst", (F.round("w", 6) + 0.0).alias("w"))


def graph_advection(spark, folder):
    c, rows = _cands(spark, folder)
    edges = graph.knn_edges(graph.pair_distances(rows, SPEC), 3)
    u = graph.advection_edges(edges, centroids(base.points(spark, folder)), c.queries.select("query_id", F.get("points", F.lit(0)).alias("q")))
    return u.select("query_id", "src", "dst", (F.round("u", 6) + 0.0).alias("u"))


def graph_smoothing(spark, folder):
    """Five Laplacian steps as joins and aggregates."""
    c, rows = _cands(spark, folder)
    edges = graph.knn_edges(graph.pair_distances(rows, SPEC), 3)
    field = retrieval._field(c, rows.select("query_id", "doc_id")).withColumnRenamed("c0", "c")
    from vectide.shared import stored

    edges = stored(edges, "edges")
    for _ in range(5):
        field = stored(graph.smooth_step(field, edges, 0.15), "field")
    return field.select("query_id", "doc_id", (F.round("c", 6) + 0.0).alias("c"))


QUERIES |= {"graph_distances": graph_distances, "graph_edges": graph_edges, "graph_advection": graph_advection, "graph_smoothing": graph_smoothing}
ORACLES |= {
    "graph_distances": "with " + GRAPH + " select query_id, src, dst, round(d, 6) + 0.0 as d from dd",
    "graph_edges": "with " + GRAPH + " select query_id, src, dst, round(w, 6) + 0.0 as w from edges",
    "graph_smoothing": "with " + GRAPH + _steps(0.15, 5) + " select query_id, doc_id, round(c, 6) + 0.0 as c from c5",
    "graph_advection": "with " + GRAPH + """ select e.query_id, src, dst, round(0.3 * list_dot_product(list_transform(range(1, 65), lambda i: b.c[i] - a.c[i]), qv) / (sqrt(list_dot_product(qv, qv)) + 1e-8)
      / (sqrt(list_sum(list_transform(range(1, 65), lambda i: (b.c[i] - a.c[i]) * (b.c[i] - a.c[i])))) + 1e-8), 6) + 0.0 as u from edges e join cent a on a.doc_id = src join cent b on b.doc_id = dst join q on q.query_id = e.query_id and qi = 0""",
}


_add("stefan_expansion", lambda c, *_: expansion.stefan(c, K, first=15, budget=30))
_add("stefan_clouds", lambda c, *_: expansion.stefan_clouds(c, K, first=15, budget=30))
_add("adjoint_prefetch", lambda c, *_: expansion.adjoint_prefetch(c, K, first=15, total=25))
_add("adjoint_aligned", lambda c, *_: expansion.adjoint_prefetch(c, K, first=15, total=25, metric="subspace_first"))
_add("multigrid", lambda c, *_: expansion.multigrid(c, K, N))


# -- several indices over the star schema -------------------------------------------------
def anchor_cases(spark, folder):
    """Orders that cite a found part, found being every part whose key is divisible by 20: a semi-join by reference."""
    refs = base.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("statute_id"))
    hits = base.table(spark, folder, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("statute_id"))
    return refs.join(hits, "statute_id", "left_semi").select("case_id").distinct()


def cascade(spark, folder):
    """Four indices over the clouds; case d cites statutes d + 1 and d + 7."""
    c = base.corpus(spark, folder)
    refs = c.docs.select(F.col("doc_id").alias("case_id"), F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 7)).alias("statute_id"))
    hits = retrieval.cascade(c.queries, {n: c.docs for n in ("statute", "case", "literature")}, refs, {"statute": 5, "case": 5, "judgment": 3, "literature": 3})
    return hits.select("query_id", "source", "doc_id", (F.round("score", 6) + 0.0).alias("score"), "rank")


QUERIES |= {"anchor_cases": anchor_cases, "cascade": cascade}
ORACLES |= {
    "anchor_cases": "select distinct l_orderkey as case_id from lineitem where l_partkey in (select p_partkey from part where p_partkey % 20 = 0)",
    "cascade": "with " + PTS + COS + """, st as (select * from (select query_id, doc_id, 1 - value as score, row_number() over (partition by query_id order by value, doc_id) as r from cham) where r <= 10),
      anch as (select distinct s.query_id, c.doc_id from st s, (select distinct doc_id from pts) c where s.r <= 5 and s.doc_id in (c.doc_id + 1, c.doc_id + 7)),
      cs as (select query_id, doc_id, case when anch.doc_id is null then score else score * 1.5 end as score from st left join anch using (query_id, doc_id)),
      al as (select query_id, 'statute' as source, doc_id, score, r as rank from st where r <= 5 union all select query_id, 'literature', doc_id, score, r from st where r <= 3
        union all select * from (select query_id, 'case', doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as r from cs) where r <= 5)
      select query_id, source, doc_id, round(score, 6) + 0.0 as score, rank from al""",
}


def index_search(spark, folder):
    """The nearest vectors by the graphs of an index, after rows were added to it and others removed."""
    e = base.table(spark, folder, "embeddings").select(F.col("vec_id").cast("bigint").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"))
    m = index.IndexManager(spark, SPEC.dim)
    m.create("literature", e.where("doc_id % 50 != 7"))
    m.add("literature", e.where("doc_id % 50 = 7"))
    m.remove("literature", e.where("doc_id % 50 = 9"))
    asked = e.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array("vec").alias("points"))
    return _out(m.search("literature", asked, K))


QUERIES["index_search"] = index_search
ORACLES["index_search"] = (
    "with e as (select vec_id as id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),"
    " c as (select a.id as query_id, b.id as doc_id, list_dot_product(a.v, b.v) / (a.n * b.n) as value from e a, e b where a.id % 20 = 0 and b.id % 50 <> 9)" + top_sql("round(value, 6)", "c", K, asc=False)
)


def chunk_clouds(spark, folder):
    """Chunk clouds, whatever their size: every file whose id is divisible by 20 asks with
    all its points, all files answer."""
    from vectide.shared import stored
    from vectide.sources.blobs import decoded, usable

    rows = decoded(base.table(spark, folder, "chunks").select("id", "file_id", "vector"), "vector", 64).where(usable(F.col("vec")))
    rows = rows.groupBy("id").agg(F.min("file_id").alias("doc_id"), F.min_by("vec", "file_id").alias("vec")).withColumn("point_idx", F.col("id"))
    rows = stored(rows.select("doc_id", "point_idx", "vec"), "chunk_points")
    asked = nested(rows.where("doc_id % 20 = 0")).withColumnRenamed("doc_id", "query_id")
    hits = scan.scan_points(asked, rows, SPEC, K, cap=1024)
    return hits.select("query_id", "doc_id", (F.round("value", 5) + 0.0).alias("score"), "rank")


QUERIES["chunk_clouds"] = chunk_clouds


# -- the flagship: two stages, smoothing, fusion, evaluation -------------------------------
def _sides(spark, folder):
    c = base.corpus(spark, folder)
    return retrieval.two_stage(c, N, N), retrieval.shape_laplacian(c, N, N, 0.15, 5)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Token two-stage and smoothed cosine lists of every query, fused at 0.7."""
    token, smooth = _sides(spark, folder)
    return _out(retrieval._ranked(fusion.weighted_pair(smooth, token, 0.7), K))


def fusion_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Mean NDCG@10 for every fusion weight of the grid."""
    token, smooth = _sides(spark, folder)
    runs = fusion.lambda_sweep(smooth, token, [0.0, 0.3, 0.5, 0.7, 1.0])
    scores = metrics.ndcg(runs, base.labels(spark, folder), 10, keys=("lam", "query_id"))
    return scores.groupBy("lam").agg((F.round(F.avg("ndcg"), 6) + 0.0).alias("ndcg"), F.count("*").alias("queries"))


FUSED = (
    "with " + GRAPH + _steps(0.15, 5) + COARSE.format(n=N) + chamfer_sql() + """, tk as (select cham.query_id, cham.doc_id, exp(-2 * value) as score from cham join cand using (query_id, doc_id)),
  sm as (select query_id, doc_id, c as score from c5),
  tn as (select query_id, doc_id, (score - min(score) over w) / case when max(score) over w = min(score) over w then 1e-8 else max(score) over w - min(score) over w end as b from tk window w as (partition by query_id)),
  gn as (select query_id, doc_id, (score - min(score) over w) / case when max(score) over w = min(score) over w then 1e-8 else max(score) over w - min(score) over w end as a from sm window w as (partition by query_id)),
  both_ as (select query_id, doc_id, coalesce(a, 0.0) as a, coalesce(b, 0.0) as b from gn full join tn using (query_id, doc_id))"""
)
QUERIES |= {"flagship": flagship, "fusion_evaluation": fusion_evaluation}
ORACLES["multigrid"] = (
    FUSED + """, ra as (select query_id, doc_id, row_number() over (partition by query_id order by c desc, doc_id) as a from c5), rb as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as b from tk),
  hd as (select query_id, doc_id from (select *, row_number() over (partition by query_id order by abs(a - b) desc, doc_id) as r from ra join rb using (query_id, doc_id)) where r <= 5),
  nr as (select query_id, doc_id from (select h.query_id, y.doc_id, row_number() over (partition by h.query_id, h.doc_id order by greatest(0.0, least(2.0, 1 - list_dot_product(x.c, y.c) / (sqrt(list_dot_product(x.c, x.c)) * sqrt(list_dot_product(y.c, y.c))))), y.doc_id) as r
    from hd h join cent x on x.doc_id = h.doc_id, cent y) where r <= 5),
  pl as (select query_id, doc_id from tk union select query_id, doc_id from nr), kept as (select cham.* from cham join pl using (query_id, doc_id))""" + top_sql("value", "kept", K, out="exp(-2 * value)")
)
ORACLES |= {
    "flagship": FUSED + ", fz as (select query_id, doc_id, 0.7 * a + 0.3 * b as value from both_)" + top_sql("value", "fz", K, asc=False),
    "fusion_evaluation": FUSED + """, fz as (select lam::double as lam, query_id, doc_id, row_number() over (partition by lam, query_id order by lam::double * a + (1 - lam::double) * b desc, doc_id) as r from both_, (select unnest([0.0, 0.3, 0.5, 0.7, 1.0]) as lam)),
      lb as (select cast(vec_id / 5 as bigint) as doc_id, label from embeddings where vec_id % 5 = 0), qr as (select a.doc_id as query_id, b.doc_id from lb a join lb b using (label) where a.doc_id % 20 = 0),
      idc as (select query_id, sum(1 / log2(r + 1)) as idcg from (select query_id, row_number() over (partition by query_id order by doc_id) as r from qr) where r <= 10 group by 1),
      nd as (select fz.lam, fz.query_id, coalesce(sum(case when qr.doc_id is not null then 1 / log2(r + 1) end), 0) / any_value(idcg) as ndcg from fz left join qr on qr.query_id = fz.query_id and qr.doc_id = fz.doc_id join idc on idc.query_id = fz.query_id where r <= 10 group by 1, 2)
      select lam, round(avg(ndcg), 6) + 0.0 as ndcg, count(*) as queries from nd group by 1""",
}
