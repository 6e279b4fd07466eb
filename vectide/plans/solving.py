"""Queries of the iterative solvers, each with its iteration written out in SQL.

The SQL holds one row a query: the field and the dense weights of its candidates are
lists in order of document, and a recursive CTE takes the steps until none of the
field's numbers moves by ``eps`` or the steps are used up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vectide.functions.vectors import SubspaceSpec
from vectide.operators import adaptive, expansion, fusion, graph, metrics, retrieval, scan, solvers
from vectide.plans import base
from vectide.plans.base import PTS, SPEC, SUB, chamfer_sql, top_sql
from vectide.plans.retrievals import COARSE, COS, FUSED, GRAPH, K, N, _out

QUERIES, ORACLES = {}, {}

#: Cosines of the candidates' centroids.
_CANDS = f", cands as (select query_id, doc_id from (select *, row_number() over (partition by query_id order by value, doc_id) as r from cosd) where r <= {N})"
_CENTRES = _CANDS + """,
  cn as (select doc_id, c as v, sqrt(list_dot_product(c, c)) as n from cent),
  cc as (select x.query_id, x.doc_id as src, y.doc_id as dst, least(2.0, greatest(0.0, 1 - list_dot_product(a.v, b.v) / (a.n * b.n))) as d
    from cands x join cands y on x.query_id = y.query_id and x.doc_id <> y.doc_id join cn a on a.doc_id = x.doc_id join cn b on b.doc_id = y.doc_id)"""
_FIELD = """, c0 as (select cands.query_id, cands.doc_id, exp(-2 * value) as c from cands join (select query_id, doc_id, avg(x) as value from (select query_id, doc_id, s, min(dist) + avg(dist) as x from psd where qi = 0 group by all) group by all) z
    on z.query_id = cands.query_id and z.doc_id = cands.doc_id)"""
_COSINE = """, c0 as (select cands.query_id, cands.doc_id, 1 - value as c from cands join cosd using (query_id, doc_id))"""


def _edges(k: int, source: str = "cc", weight: str = "exp(-2 * d)", back: bool = True) -> str:
    """CTE ``edges``: the k nearest of every candidate, and missing reverse edges."""
    out = f", nn as (select query_id, src, dst, {weight} as w from (select *, row_number() over (partition by query_id, src order by d, dst) as r from {source}) where r <= {k})"
    if not back:
        return out + ", edges as (select * from nn)"
    return out + ", edges as (select * from nn union all select query_id, dst, src, w from nn a where not exists (select 1 from nn b where b.query_id = a.query_id and b.src = a.dst and b.dst = a.src))"


def _centre_head(k: int, field: str = _FIELD, back: bool = True) -> str:
    return SUB + COS.replace("cham as", "cosd as") + _CENTRES + field + _edges(k, back=back)


#: Flow along the query's first vector on edges.
_ADVECTION = """, adv as (select e.query_id, e.src, e.dst, {strength} * (list_dot_product(b.c, qq.qv) - list_dot_product(a.c, qq.qv)) / (sqrt(list_dot_product(qq.qv, qq.qv)) + 1e-8)
  / (sqrt(list_sum(list_transform(range(1, 65), lambda i: (b.c[i] - a.c[i]) * (b.c[i] - a.c[i])))) + 1e-8) as u from edges e join cent a on a.doc_id = e.src join cent b on b.doc_id = e.dst join {query} qq on qq.query_id = e.query_id)"""
_FIRST = "(select query_id, qv from q where qi = 0)"
_MEAN = "(select doc_id as query_id, c as qv from cent where doc_id % 20 = 0)"
W, U, C, CJ = "s.w[(i - 1) * s.n + j]", "s.u[(i - 1) * s.n + j]", "it.c[i]", "it.c[j]"


def _sum(term: str) -> str:
    return f"list_sum(list_transform(range(1, s.n + 1), lambda j: {term}))"


_LAP = _sum(f"{W} * ({CJ} - {C})")
_DEGREE = _sum(W)
_REACT = f"0.5 * {C} * (1 - {C}) * ({C} - list_avg(it.c))"
_UPWIND = _sum(f"{W} * (0.15 * ({CJ} - {C}) + greatest(-{U}, 0.0) * {CJ} - greatest({U}, 0.0) * {C})")
_LINKS = "list_max(list_transform(range(1, n + 1), lambda i: len(list_filter(range(1, n + 1), lambda j: w[(i - 1) * n + j] > 0))))"


def _clip(x: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"least({high}, greatest({low}, {x}))"


def iterated(head: str, new: str, steps: int, eps: float = -1.0, u: str | None = None, extra: str = "1 as one", start: str = "c0", u_table: str = "adv") -> str:
    """Oracle of a solver: its last field, ranked; see ``iteration``."""
    return iteration(head, new, steps, eps, u, extra, start, u_table) + """,
  fin as (select query_id, arg_max(c, t) as c from it group by 1),
  solved as (select query_id, unnest(ids) as doc_id, unnest(fin.c) as value from fin join nodes using (query_id))""" + top_sql("value", "solved", K, asc=False)


def iteration(head: str, new: str, steps: int, eps: float = -1.0, u: str | None = None, extra: str = "1 as one", start: str = "c0", u_table: str = "adv", field: str = "c0", edges: str = "edges") -> str:
    """CTE ``it`` (query_id, t, c): ``head`` gives ``field`` (query_id, doc_id, c) and ``edges``;
    ``new`` is the new number of node i; ``extra`` are columns of a query's row (names of ``s``)."""
    flow = f"left join {u_table} v on v.query_id = a.query_id and v.src = a.doc_id and v.dst = b.doc_id" if u else ""
    return (
        "with recursive " + head + f""", nodes as (select query_id, list(c order by doc_id) as c0, list(doc_id order by doc_id) as ids, count(*)::int as n from {field} group by 1),
  dense as (select a.query_id, list(coalesce(e.w, 0.0) order by a.doc_id, b.doc_id) as w, list({u or '0.0'} order by a.doc_id, b.doc_id) as u
    from {field} a join {field} b on a.query_id = b.query_id left join {edges} e on e.query_id = a.query_id and e.src = a.doc_id and e.dst = b.doc_id {flow} group by 1),
  st0 as (select *, {_LINKS} as links from nodes join dense using (query_id)),
  st as (select *, {extra} from st0),
  it as (select query_id, 0 as t, {start} as c, 1e9::double as moved from st
    union all select query_id, t + 1, nc, list_max(list_transform(range(1, n + 1), lambda i: abs(nc[i] - c[i]))) from (
      select it.query_id, it.t, it.c, s.n, list_transform(range(1, s.n + 1), lambda i: {new}) as nc from it join st s on it.query_id = s.query_id where it.t < {steps} and it.moved >= {eps}) z)"""
    )


def _add(name: str, f, sql: str) -> None:
    QUERIES.setdefault(name, lambda spark, folder: _out(f(base.corpus(spark, folder))))
    ORACLES[name] = sql


def _by_graph(name: str, solve, sql: str) -> None:
    """``solve`` gets a query's cosine candidates with the start field of its first vector."""

    def run(spark, folder):
        c = base.corpus(spark, folder)
        rows = retrieval.fetch(c, scan.scan(c.queries, c.docs, "centroid_cosine", SPEC, N))
        rows = rows.join(retrieval._field(c, rows.select("query_id", "doc_id")), ["query_id", "doc_id"])
        return _out(retrieval._ranked(graph.solve_by_query(rows, solve), K))

    QUERIES[name] = run
    ORACLES[name] = sql


# -- pipelines of ``retrieval`` ----------------------------------------------------------
_DT = "least(0.1, 0.8 / links) as dt"
_FLOW = GRAPH + _ADVECTION.format(strength=0.3, query=_FIRST)
_STEP = f"greatest(0.0, {C} + s.dt * {_UPWIND})"
_add("shape_advection", lambda c: retrieval.shape_advection(c, K, N), iterated(_FLOW, _STEP, 50, 1e-3, "coalesce(v.u, 0.0)", _DT))
_add("shape_allen_cahn", lambda c: retrieval.shape_allen_cahn(c, K, N), iterated(GRAPH, _clip(f"{C} + 0.02 * (coalesce({_LAP} / nullif({_DEGREE}, 0), 0.0) + {_REACT})"), 30, 1e-3))
_PHI = chamfer_sql() + ", phi as (select query_id, doc_id, exp(-2 * value) as p from cham), pu as (select a.query_id, a.doc_id as src, b.doc_id as dst, b.p - a.p as u from phi a join phi b using (query_id))"
_BOUND = "list_max(list_transform(range(1, n + 1), lambda i: list_sum(list_transform(range(1, n + 1), lambda j: abs(u[(i - 1) * n + j]) * w[(i - 1) * n + j])))) + 0.15 * list_max(list_transform(range(1, n + 1), lambda i: list_sum(list_transform(range(1, n + 1), lambda j: w[(i - 1) * n + j]))))"
_add(
    "token_gradient",
    lambda c: retrieval.token_gradient(c, K, N),
    iterated(GRAPH + _PHI, _clip(f"{C} + s.dt * ({_UPWIND} + {_REACT})"), 50, 1e-3, "coalesce(v.u, 0.0)", f"least(0.1, 0.8 / ({_BOUND})) as dt", u_table="pu"),
)
#: Candidates of the token scan, their own start field, and flow along the query's centroid.
_TOKEN = (
    SUB + chamfer_sql() + f""", cands as (select query_id, doc_id, value from (select *, row_number() over (partition by query_id order by value, doc_id) as r from cham) where r <= {N}),
  c0 as (select query_id, doc_id, exp(-2 * value) as c from cands), dp as (select"""
    + GRAPH.split(" dp as (select")[1].split(" nn as (")[0].rstrip().rstrip(",")
    + _edges(3, "dd")
)
for _name, _d, _a in (("token_advection", 0.15, 0.3), ("token_advection_weak", 0.01, 0.01)):
    _add(
        _name,
        lambda c, d=_d, a=_a: retrieval.token_advection(c, K, N, diffusion=d, alpha=a),
        iterated(_TOKEN + _ADVECTION.format(strength=_a, query=_MEAN), _STEP.replace("0.15 *", f"{_d} *"), 50, 1e-3, "coalesce(v.u, 0.0)", _DT),
    )


_PICKED = _TOKEN.split(" dp as (select")
_add(
    "token_advection_sampled",
    lambda c: retrieval.token_advection(c, K, N, sample=3),
    iterated(
        SUB + COARSE.format(n=100) + chamfer_sql() + f""", cands as (select query_id, doc_id, value from (select cham.query_id, cham.doc_id, cham.value, row_number() over (partition by cham.query_id order by cham.value, cham.doc_id) as r from cham join cand using (query_id, doc_id)) where r <= {N}),
  c0 as (select query_id, doc_id, exp(-2 * value) as c from cands), dp as (select""" + _PICKED[1].replace("and a.s = b.s)", "and a.s = b.s and a.point_idx in (0, 1, 3) and b.point_idx in (0, 1, 3))") + _ADVECTION.format(strength=0.3, query=_MEAN),
        _STEP, 50, 1e-3, "coalesce(v.u, 0.0)", _DT,
    ),
)


# -- grids of steps and weights -----------------------------------------------------------
#: Numbers of smoothing steps that are compared.
STEPS = (1, 3, 5, 7, 10, 15, 20)


def smoothing_grid(spark, folder):
    """Mean NDCG@10 of the smoothed list for every number of steps."""
    c = base.corpus(spark, folder)
    runs = retrieval.laplacian_sweep(c, N, STEPS, 0.15)
    scores = metrics.ndcg(runs, base.labels(spark, folder), 10, keys=("steps", "query_id"))
    return scores.groupBy("steps").agg((F.round(F.avg("ndcg"), 6) + 0.0).alias("ndcg"), F.count("*").alias("queries"))


def fusion_grid(spark, folder):
    """Mean NDCG@10 of every fusion weight at five steps; the smoothed side has its first ten only, others count 0."""
    c = base.corpus(spark, folder)
    token, smooth = retrieval.two_stage(c, N, N), retrieval.shape_laplacian(c, K, N, 0.15, 5)
    runs = fusion.lambda_sweep(smooth, token, adaptive.GRID)
    scores = metrics.ndcg(runs, base.labels(spark, folder), 10, keys=("lam", "query_id"))
    return scores.groupBy("lam").agg((F.round(F.avg("ndcg"), 6) + 0.0).alias("ndcg"), F.count("*").alias("queries"))


_NDCG = """, lb as (select cast(vec_id / 5 as bigint) as doc_id, label from embeddings where vec_id % 5 = 0), qr as (select a.doc_id as query_id, b.doc_id from lb a join lb b using (label) where a.doc_id % 20 = 0),
  idc as (select query_id, sum(1 / log2(r + 1)) as idcg from (select query_id, row_number() over (partition by query_id order by doc_id) as r from qr) where r <= 10 group by 1),
  nd as (select fz.{key}, fz.query_id, coalesce(sum(case when qr.doc_id is not null then 1 / log2(r + 1) end), 0) / any_value(idcg) as ndcg from fz left join qr on qr.query_id = fz.query_id and qr.doc_id = fz.doc_id join idc on idc.query_id = fz.query_id where r <= 10 group by 1, 2)
  select {key}, round(avg(ndcg), 6) + 0.0 as ndcg, count(*) as queries from nd group by 1"""
QUERIES |= {"smoothing_grid": smoothing_grid, "fusion_grid": fusion_grid}
ORACLES["smoothing_grid"] = (
    iteration(GRAPH, f"greatest(0.0, {C} + 0.15 * coalesce({_LAP} / nullif({_DEGREE}, 0), 0.0))", max(STEPS))
    + f""", solved as (select t as steps, query_id, unnest(ids) as doc_id, unnest(it.c) as value from it join nodes using (query_id) where t in {STEPS}),
  fz as (select steps, query_id, doc_id, row_number() over (partition by steps, query_id order by value desc, doc_id) as r from solved)""" + _NDCG.format(key="steps")
)
ORACLES["fusion_grid"] = (
    FUSED.replace("sm as (select query_id, doc_id, c as score from c5)", f"sm as (select query_id, doc_id, c as score from (select *, row_number() over (partition by query_id order by c desc, doc_id) as r from c5) where r <= {K})")
    + """, fz as (select lam, query_id, doc_id, row_number() over (partition by lam, query_id order by lam * a + (1 - lam) * b desc, doc_id) as r from both_, (select i / 10.0 as lam from range(0, 11) t(i)))""" + _NDCG.format(key="lam")
)


# -- solvers on a candidate graph --------------------------------------------------------
def _unnormalised(f):
    return solvers.unnormalised(f["c0"], graph.centre_graph(f, 3)[0])


def _directed(f):
    """Out-edges only: the three nearest of each node."""
    w = graph.centre_graph(f, 3)[0]
    keep = np.zeros_like(w, dtype=bool)
    near = np.argsort(-w, axis=1, kind="stable")[:, :3]
    keep[np.arange(len(w))[:, None], near] = True
    return solvers.directed(f["c0"], np.where(keep, w, 0.0))


def _potential(f):
    c = np.stack([p.mean(axis=0) for p in f["points"]])
    return (c @ f["q"]) / np.maximum(np.linalg.norm(c, axis=1) * np.linalg.norm(f["q"]), 1e-30)


def _cloud_flow(f):
    w = graph.graph_of(f, SPEC, 3)
    return w, solvers.advection_field(f["q"], np.stack([p.mean(axis=0) for p in f["points"]]), w, 0.3)


_by_graph("smooth_unnormalised", _unnormalised, iterated(_centre_head(3), f"{C} + 0.15 * {_LAP}", 5))
_by_graph("smooth_directed", _directed, iterated(_centre_head(3, back=False), f"case when {_DEGREE} > 0 then 0.85 * {C} + 0.15 * {_sum(f'{W} * {CJ}')} / {_DEGREE} else {C} end", 5))
_MAXSIM = """, mx as (select query_id, src, dst, sum(m) as s from (select x.query_id, x.doc_id as src, y.doc_id as dst, a.point_idx, max(list_dot_product(a.vec, b.vec)) as m
    from cands x join cands y on x.query_id = y.query_id and x.doc_id <> y.doc_id join pts a on a.doc_id = x.doc_id join pts b on b.doc_id = y.doc_id group by all) group by all),
  ms as (select a.query_id, a.src, a.dst, (a.s + b.s) / 2 as sim, -(a.s + b.s) / 2 as d from mx a join mx b on a.query_id = b.query_id and a.src = b.dst and a.dst = b.src)"""
_by_graph(
    "smooth_convex",
    lambda f: solvers.convex_mix(f["c0"], graph.max_sim_graph(f, 10)),
    iterated(SUB + COS.replace("cham as", "cosd as") + _CANDS + _FIELD + _MAXSIM + _edges(10, "ms", "sim"), f"case when {_DEGREE} > 0 then 0.85 * s.c0[i] + 0.15 * {_sum(f'{W} * {CJ}')} / {_DEGREE} else 0.85 * s.c0[i] end", 1),
)
_T = "s.w[(j - 1) * s.n + i] * exp((s.c0[i] - s.c0[j]) / 0.2)"
_TO = f"{W} * exp((s.c0[j] - s.c0[i]) / 0.2)"
_by_graph(
    "reaction_diffusion",
    lambda f: solvers.reaction_diffusion(graph.centre_graph(f, 5)[0], _potential(f)),
    iterated(
        _centre_head(5, _COSINE),
        _clip(f"{C} + s.dt * (0.2 * {_sum(f'{_T} * {CJ} - {_TO} * {C}')} + 0.5 * {C} * (1 - {C}) * ({C} - s.theta))"),
        20,
        1e-3,
        extra="list_transform(c0, lambda x: (x - list_min(c0)) / (list_max(c0) - list_min(c0))) as f0, list_median(list_transform(c0, lambda x: (x - list_min(c0)) / (list_max(c0) - list_min(c0)))) as theta,"
        " 0.9 / (0.2 * list_max(list_transform(range(1, n + 1), lambda i: list_sum(list_transform(range(1, n + 1), lambda j: w[(i - 1) * n + j] * exp((c0[j] - c0[i]) / 0.2))))) + 0.5 + 1e-8) as dt",
        start="f0",
    ),
)
_by_graph("pde4", lambda f: solvers.advection_diffusion(f["c0"], *_cloud_flow(f)), iterated(_FLOW, _STEP, 50, 1e-3, "coalesce(v.u, 0.0)", _DT))
_SPLIT = "(k / n::double) * (1 - k / n::double) * pow(list_avg(list_sort(c0)[1:k]) - list_avg(list_sort(c0)[k + 1:n]), 2)"
_OTSU = f"(select (list_sort(c0)[b] + list_sort(c0)[b + 1]) / 2 from (select list_position(list_transform(range(1, n), lambda k: {_SPLIT}), list_max(list_transform(range(1, n), lambda k: {_SPLIT}))) as b))"
_by_graph(
    "pde52",
    lambda f: solvers.bounded_reaction(f["c0"], *_cloud_flow(f)),
    iterated(
        _FLOW,
        _clip(f"{C} + s.dt * ({_UPWIND} + ({C} - s.lo) * (s.hi - {C}) * ({C} - s.theta) / pow(s.hi - s.lo + 1e-6, 2))", "s.lo", "s.hi"),
        80,
        5e-3,
        "coalesce(v.u, 0.0)",
        f"list_min(c0) as lo, list_max(c0) as hi, least(0.05, 0.8 / links) as dt, {_OTSU} as theta",
    ),
)
_AD = SUB + COS.replace("cham as", "cosd as") + _CENTRES + ", c0 as (select cands.query_id, cands.doc_id, list_dot_product(qv, c) / ((sqrt(list_dot_product(qv, qv)) + 1e-8) * (sqrt(list_dot_product(c, c)) + 1e-8)) as c from cands join cent using (doc_id) join q on q.query_id = cands.query_id and qi = 0)" + _edges(3)
_by_graph("ad_rank", expansion.ad_rank, iterated(_AD + _ADVECTION.format(strength=0.3, query=_FIRST), _clip(f"{C} + s.dt * {_UPWIND}"), 50, 1e-3, "coalesce(v.u, 0.0)", _DT))


# -- the field of whole clouds -------------------------------------------------------------
_PLAIN = f""", pcd as (select x.query_id, x.doc_id as src, y.doc_id as dst, a.point_idx as i, b.point_idx as j, greatest(0.0, 1 - list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)))) as x
    from cands x join cands y on x.query_id = y.query_id and x.doc_id <> y.doc_id join pts a on a.doc_id = x.doc_id join pts b on b.doc_id = y.doc_id),
  cc as (select query_id, src, dst, x + y as d from (select query_id, src, dst, avg(m) as x from (select query_id, src, dst, i, min(x) as m from pcd group by all) group by all) join (select query_id, src, dst, avg(m) as y from (select query_id, src, dst, j, min(x) as m from pcd group by all) group by all) using (query_id, src, dst)),
  ms as (select query_id, doc_id, avg(m) as d from (select q.query_id, d.doc_id, qi, min(greatest(0.0, 1 - list_dot_product(qv, dv) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(dv, dv))))) as m from q join cands using (query_id) join d on d.doc_id = cands.doc_id group by all) group by all),
  c0 as (select query_id, doc_id, exp(-2 * d) as c from ms)"""
_CUT = """, gaps as (select e.query_id, e.src, e.dst, list_sum(list_transform(range(1, 65), lambda i: (b.c[i] - a.c[i]) * (b.c[i] - a.c[i]))) as g from edges e join cent a on a.doc_id = e.src join cent b on b.doc_id = e.dst),
  cut as (select query_id, list_sort(list(g))[floor(count(*) * 0.05)::int + 1] as least from gaps where src < dst and g > 0 group by 1),
  kept as (select adv.query_id, adv.src, adv.dst, case when g < least then 0.0 else u end as u from adv join gaps using (query_id, src, dst) join cut using (query_id))"""
_V5_HEAD = PTS + COS.replace("cham as", "cosd as") + _CANDS + _PLAIN + _edges(3) + _ADVECTION.format(strength=0.1, query=_MEAN) + _CUT
_by_graph(
    "shape_v5",
    expansion.shape_v5,
    iterated(_V5_HEAD, _clip(f"{C} + s.dt * ({_UPWIND} + 0.5 * {C} * (1 - {C}) * ({C} - s.theta))"), 80, 5e-3, "coalesce(v.u, 0.0)", "least(0.05, 0.8 / links) as dt, list_avg(c0) as theta", u_table="kept"),
)


def shape_v5_report(spark, folder):
    """Scores, kinds of nodes and the flow's numbers of the full setting."""
    c = base.corpus(spark, folder)
    rows = retrieval.fetch(c, scan.scan(c.queries, c.docs, "centroid_cosine", SPEC, N))
    out = expansion.shape_report(rows)
    return out.select("query_id", "doc_id", *[(F.round(x, 6) + 0.0).alias(x) for x in ("score", "reynolds", "peclet", "damkohler")], "topology", "iterations", "converged", "kind")


def score_diagnosis(spark, folder):
    """How each query's token scores part at their mean."""
    hits = retrieval.token_rank(base.corpus(spark, folder), N)
    rows = hits.join(hits.groupBy("query_id").agg(F.avg("score").alias("theta")), "query_id")
    return expansion.diagnosis(rows).select("query_id", "above", "below", (F.round("gap", 6) + 0.0).alias("gap"), "type")


QUERIES |= {"shape_v5_report": shape_v5_report, "score_diagnosis": score_diagnosis}
ORACLES["score_diagnosis"] = (
    "with " + SUB + chamfer_sql() + f""", h as (select query_id, exp(-2 * value) as s from (select *, row_number() over (partition by query_id order by value, doc_id) as r from cham) where r <= {N}),
  t as (select query_id, s, avg(s) over (partition by query_id) as th from h),
  g as (select query_id, any_value(th) as th, count(*) filter (s >= th) as above, count(*) filter (s < th) as below, min(s) filter (s >= th) as a0, max(s) filter (s >= th) as a1, min(s) filter (s < th) as b0, max(s) filter (s < th) as b1 from t group by 1),
  x as (select *, coalesce(a0, th) - coalesce(b1, th) as gap, greatest(coalesce(a1 - a0, 0), coalesce(b1 - b0, 0)) as wide from g)
  select query_id, above, below, round(gap, 6) + 0.0 as gap, case when gap > 0.02 and gap > 0.3 * wide then 'C-type' when gap > 0.1 then 'A-type' else 'smooth' end as type from x"""
)
_by_graph("shape_v5_ensemble", expansion.shape_v5_ensemble, "")


def _parts_sql(vectors: str) -> str:
    """AD-rank in 8 views of the vectors at once: ``vectors`` gives CTE ``pv`` (doc_id, g, v)
    and ``pq`` (query_id, g, v); a query's number is times 8, plus the view's."""
    head = SUB + COS.replace("cham as", "cosd as") + _CANDS + vectors + """, vn as (select *, sqrt(list_dot_product(v, v)) as n from pv), qn as (select *, sqrt(list_dot_product(v, v)) as n from pq),
  fp as (select c.query_id * 8 + d.g as query_id, c.doc_id, list_dot_product(q.v, d.v) / ((q.n + 1e-8) * (d.n + 1e-8)) as c from cands c join vn d on d.doc_id = c.doc_id join qn q on q.query_id = c.query_id and q.g = d.g),
  pd as (select x.query_id * 8 + a.g as query_id, x.doc_id as src, y.doc_id as dst, 1 - list_dot_product(a.v, b.v) / ((a.n + 1e-8) * (b.n + 1e-8)) as d
    from cands x join cands y on x.query_id = y.query_id and x.doc_id <> y.doc_id join vn a on a.doc_id = x.doc_id join vn b on b.doc_id = y.doc_id and b.g = a.g)""" + _edges(3, "pd") + """,
  up as (select e.query_id, e.src, e.dst, 0.3 * (list_dot_product(b.v, q.v) - list_dot_product(a.v, q.v)) / (q.n + 1e-8) / (sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (b.v[i] - a.v[i]) * (b.v[i] - a.v[i])))) + 1e-8) as u
    from edges e join vn a on a.doc_id = e.src and a.g = e.query_id % 8 join vn b on b.doc_id = e.dst and b.g = e.query_id % 8 join qn q on q.query_id = e.query_id // 8 and q.g = e.query_id % 8)"""
    return (
        iteration(head, _clip(f"{C} + s.dt * {_UPWIND}"), 50, 1e-3, "coalesce(v.u, 0.0)", _DT, u_table="up", field="fp")
        + """, runs as (select query_id, arg_max(c, t) as c from it group by 1),
  each as (select r.query_id // 8 as query_id, unnest(ids) as doc_id, unnest(r.c) as c, q.n from runs r join nodes using (query_id) join qn q on q.query_id = r.query_id // 8 and q.g = r.query_id % 8),
  solved as (select query_id, doc_id, sum(n * c) / sum(n) as value from each group by all)"""
        + top_sql("value", "solved", K, asc=False)
    )


_by_graph("ad_rank_blocks", expansion.ad_rank_blocks, _parts_sql(", pv as (select doc_id, g, c[8*g+1:8*g+8] as v from cent, range(0, 8) t(g)), pq as (select query_id, g, qv[8*g+1:8*g+8] as v from q, range(0, 8) t(g) where qi = 0)"))
#: The generator of the projections, step by step.
_UNIFORM = """, lcg as (select 1 as k, (42::bigint * 1664525 + 1013904223) % 4294967296 as s union all select k + 1, (s * 1664525 + 1013904223) % 4294967296 from lcg where k < 16384),
  pr as (select (k - 1) // 2048 as g, (k - 1) // 64 % 32 as r, list(s / 4294967295.0::double - 0.5 order by k) as row from lcg group by all),
  pu as (select g, r, list_transform(row, lambda x: x / (sqrt(list_dot_product(row, row)) + 1e-8)) as row from pr),
  pv as (select doc_id, g, list(list_dot_product(c, row) order by r) as v from cent, pu group by all), pq as (select query_id, g, list(list_dot_product(qv, row) order by r) as v from q, pu where qi = 0 group by all)"""
_by_graph("ad_rank_projections", expansion.ad_rank_projected, _parts_sql(_UNIFORM))
#: All three settings at once: a query's number is times 4, plus the setting's.
_THREE = _V5_HEAD + """, gs(g, dif, str, gam) as (values (0, 0.2, 0.05, 0.2), (1, 0.15, 0.1, 0.5), (2, 0.1, 0.15, 0.8)), f3 as (select query_id * 4 + g as query_id, doc_id, c from c0, gs),
  e3 as (select query_id * 4 + g as query_id, src, dst, w from edges, gs), u3 as (select query_id * 4 + g as query_id, src, dst, u * str / 0.1 as u from kept, gs)"""
ORACLES["shape_v5_ensemble"] = (
    iteration(
        _THREE, _clip(f"{C} + s.dt * ({_UPWIND.replace('0.15 *', 's.dif *')} + s.gam * {C} * (1 - {C}) * ({C} - s.theta))"), 80, 5e-3, "coalesce(v.u, 0.0)",
        "least(0.05, 0.8 / links) as dt, list_avg(c0) as theta, [0.2, 0.15, 0.1][query_id % 4 + 1]::double as dif, [0.2, 0.5, 0.8][query_id % 4 + 1]::double as gam", u_table="u3", field="f3", edges="e3",
    )
    + """, runs as (select query_id // 4 as query_id, query_id % 4 as g, arg_max(c, t) as c, arg_max(moved, t) < 5e-3 as settled from it group by all),
  best as (select query_id, coalesce(arg_max(c, list_max(c) - list_min(c) - g * 1e-13) filter (settled), max(c) filter (g = 1)) as c from runs group by 1),
  solved as (select b.query_id, unnest(ids) as doc_id, unnest(b.c) as value from best b join nodes n on n.query_id = b.query_id * 4)"""
    + top_sql("value", "solved", K, asc=False)
)


def graph_unaligned(spark, folder):
    """Distances of candidates in which any sub-vector may meet any other."""
    c = base.corpus(spark, folder)
    rows = retrieval.fetch(c, scan.scan(c.queries, c.docs, "centroid_cosine", SPEC, 10))
    pairs = graph.metric_distances(rows, SPEC, "unaligned")
    return pairs.select("query_id", "src", "dst", (F.round("d", 6) + 0.0).alias("d"))


QUERIES["graph_unaligned"] = graph_unaligned
ORACLES["graph_unaligned"] = "with " + SUB + COS.replace("cham as", "cosd as") + """, cands as (select query_id, doc_id from (select *, row_number() over (partition by query_id order by value, doc_id) as r from cosd) where r <= 10),
  up as (select x.query_id, x.doc_id as src, y.doc_id as dst, a.point_idx * 8 + a.s as i, b.point_idx * 8 + b.s as j, case when a.n * b.n < 1e-16 then 1.0 else 1.0 - list_dot_product(a.v, b.v) / (a.n * b.n + 1e-8) end as x
    from cands x join cands y on x.query_id = y.query_id and x.doc_id <> y.doc_id join sn a on a.doc_id = x.doc_id join sn b on b.doc_id = y.doc_id),
  ta as (select query_id, src, dst, avg(m) as a from (select query_id, src, dst, i, min(x) as m from up group by all) group by all), tb as (select query_id, src, dst, avg(m) as b from (select query_id, src, dst, j, min(x) as m from up group by all) group by all)
  select query_id, src, dst, round(a + b, 6) + 0.0 as d from ta join tb using (query_id, src, dst)"""


def shape_advection_whole(spark, folder):
    """The cloud pipeline with one subspace: plain cosine everywhere."""
    c = base.corpus(spark, folder)
    return _out(retrieval.shape_advection(retrieval.Corpus(c.docs, c.queries, SubspaceSpec(1, SPEC.dim)), K, N))


def shape_rerank(spark, folder):
    """Listed documents, here the centroid's, on a graph of a distance of one's choice."""
    c = base.corpus(spark, folder)
    pairs = scan.scan(c.queries, c.docs, "centroid_cosine", SPEC, N).select("query_id", "doc_id")
    return _out(retrieval.shape_rerank(c, pairs, K, "query_to_cloud", "plain_chamfer"))


QUERIES |= {"shape_advection_whole": shape_advection_whole, "shape_rerank": shape_rerank}
_WHOLE = GRAPH.replace("vec[8 * s + 1 : 8 * s + 8] as v from pts, range(0, 8) t(s)", "vec as v from pts, range(0, 1) t(s)")
ORACLES["shape_advection_whole"] = iterated(_WHOLE + _ADVECTION.format(strength=0.3, query=_FIRST), _STEP, 50, 1e-3, "coalesce(v.u, 0.0)", _DT)
ORACLES["shape_rerank"] = iterated(
    SUB + COS.replace("cham as", "cosd as") + _CANDS + _FIELD + _PLAIN.split(",\n  ms as")[0] + _edges(3) + _ADVECTION.format(strength=0.3, query=_FIRST), _STEP, 50, 1e-3, "coalesce(v.u, 0.0)", _DT
)
