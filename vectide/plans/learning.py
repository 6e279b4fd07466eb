"""Queries on learned fusion weights, sequential replays, SVD and residuals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vectide.operators import adaptive, clouds, fusion, linalg, metrics, quantize
from vectide.plans import base
from vectide.plans.base import PTS, SPEC
from vectide.plans.rankings import _PAIRS, WA, _runs
from vectide.sources.blobs import decoded, usable

QUERIES, ORACLES = {}, {}


def _q(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _r(c, name):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


#: Features of two rankings' first ten, and their agreement, as CTE ``ft``.
_FEATURES = WA + """, a10 as (select * from a where r <= 10), b10 as (select * from b where r <= 10),
  sa as (select query_id, max(score) as top, max(score) - coalesce(max(score) filter (r = 2), max(score)) as gap, avg(score) as mean, stddev_pop(score) as std from a10 group by 1),
  sb as (select query_id, max(score) as top, max(score) - coalesce(max(score) filter (r = 2), max(score)) as gap, avg(score) as mean, stddev_pop(score) as std from b10 group by 1),
  jc as (select coalesce(x.query_id, y.query_id) as query_id, sum((x.doc_id is not null and y.doc_id is not null)::int) / count(*)::double as overlap from a10 x full join b10 y on x.query_id = y.query_id and x.doc_id = y.doc_id group by 1)""" + _PAIRS.removeprefix(WA) + """,
  kt as (select query_id, (c - d) / sqrt((c + d + tx)::double * (c + d + ty)) as tau from c),
  ft as (select sa.query_id, sa.top as a_top, sa.gap as a_gap, sa.mean as a_mean, sa.std as a_std, sb.top as b_top, sb.gap as b_gap, sb.mean as b_mean, sb.std as b_std, coalesce(overlap, 0.0) as overlap, coalesce(tau, 0.0) as tau, 0.0 as words
    from sa join sb using (query_id) left join jc using (query_id) left join kt using (query_id))"""
_SHOWN = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in adaptive.FREE)


@_q("lambda_features", _FEATURES + f" select query_id, {_SHOWN} from ft")
def lambda_features(spark, folder):
    return adaptive.features(*_runs(spark, folder)).select("query_id", *[_r(F.col(c), c) for c in adaptive.FREE])


def _scores(spark, folder):
    """The value of each query's fused list at every weight of the grid, and both rankings."""
    a, b = _runs(spark, folder)
    runs = fusion.lambda_sweep(a, b, adaptive.GRID)
    return a, b, metrics.ndcg(runs, base.labels(spark, folder), 10, keys=("lam", "query_id")).withColumnRenamed("ndcg", "value")


#: Values (lam, query_id, value) of the fused lists as CTE ``vl``.
_VALUES = """, an as (select *, (score - min(score) over w) / case when max(score) over w = min(score) over w then 1e-8 else max(score) over w - min(score) over w end as x from a window w as (partition by query_id)),
  bn as (select *, (score - min(score) over w) / case when max(score) over w = min(score) over w then 1e-8 else max(score) over w - min(score) over w end as y from b window w as (partition by query_id)),
  fu as (select coalesce(an.query_id, bn.query_id) as query_id, coalesce(an.doc_id, bn.doc_id) as doc_id, coalesce(x, 0.0) as x, coalesce(y, 0.0) as y from an full join bn on an.query_id = bn.query_id and an.doc_id = bn.doc_id),
  fr as (select lam, query_id, doc_id, row_number() over (partition by lam, query_id order by lam * x + (1 - lam) * y desc, doc_id) as r from fu, (select i / 10.0 as lam from range(0, 11) t(i))),
  idc as (select query_id, sum(1 / log2(r + 1)) as idcg from (select query_id, row_number() over (partition by query_id order by doc_id) as r from qrels) where r <= 10 group by 1),
  vl as (select fr.lam, fr.query_id, coalesce(sum(case when rel is not null then 1 / log2(r + 1) end), 0) / any_value(idcg) as value from fr left join qrels q on q.query_id = fr.query_id and q.doc_id = fr.doc_id join idc on idc.query_id = fr.query_id where r <= 10 group by 1, 2)"""


@_q("lambda_values", WA + _VALUES + " select lam::double as lam, query_id, round(value, 6) + 0.0 as value from vl")
def lambda_values(spark, folder):
    return _scores(spark, folder)[2].select("lam", "query_id", _r(F.col("value"), "value"))


@_q("lambda_targets", WA + _VALUES + " select query_id, lam::double as target from (select *, row_number() over (partition by query_id order by round(value, 9) desc, lam) as r from vl) where r = 1")
def lambda_targets(spark, folder):
    """The best weight of each query, of equals the smallest."""
    scores = _scores(spark, folder)[2].withColumn("value", F.round("value", 9))
    return adaptive.best_lambda(scores).select("query_id", "target")


def _training(spark, folder):
    """Every query's features and best weight; five corpora by the query's number."""
    from vectide.shared import stored

    a, b, scores = _scores(spark, folder)
    rows = adaptive.features(a, b).join(adaptive.best_lambda(scores.withColumn("value", F.round("value", 9))), "query_id")
    return stored(rows.withColumn("corpus", (F.col("query_id") / 20 % 5).cast("int").cast("string")), "lambda-rows")


COLS = adaptive.FREE[:-1]  # no query has a text here


@_q("lambda_ridge")
def lambda_ridge(spark, folder):
    t = _training(spark, folder)
    return adaptive.predict(adaptive.fit_ridge(t, COLS, 0.01), t, COLS).select("query_id", "lam")


@_q("lambda_trees")
def lambda_trees(spark, folder):
    t = _training(spark, folder)
    return adaptive.predict(adaptive.fit_trees(t, COLS), t, COLS).select("query_id", "lam")


@_q("lambda_transfer")
def lambda_transfer(spark, folder):
    """Each corpus by boosted trees of the others, whole rows at every tree."""
    fit = lambda rows, columns: adaptive.fit_trees(rows, columns, trees=50, sampled=1.0)
    return adaptive.leave_one_corpus_out(_training(spark, folder), COLS, [str(i) for i in range(5)], fit).select("query_id", "corpus", "lam")


@_q("lambda_feature_ablation")
def lambda_feature_ablation(spark, folder):
    e = adaptive.leave_one_feature_out(_training(spark, folder), COLS)
    return spark.createDataFrame(sorted((k, None if v is None else float(v)) for k, v in e.items()), "left_out string, mse double")


def _accounts(spark, folder):
    """Customers as a stream with a target on the grid."""
    c = base.table(spark, folder, "customer")
    x = c.select(F.col("c_custkey").cast("bigint").alias("query_id"), (F.col("c_nationkey") % 5).cast("string").alias("corpus"), (F.col("c_acctbal") / 10000).alias("f1"), ((F.col("c_custkey") % 17) / 17.0).alias("f2"), ((F.col("c_custkey") % 29) / 29.0).alias("f3"))
    return x.withColumn("target", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 + 0.4 * F.col("f1") + 0.2 * F.col("f2"))))


STREAM = ["f1", "f2", "f3"]


@_q(
    "lambda_best",
    """with t as (select c_custkey::bigint as query_id, greatest(0.0, least(1.0, 0.3 + 0.4 * (c_acctbal / 10000) + 0.2 * ((c_custkey % 17) / 17.0))) as target from customer),
    v as (select query_id, i / 10.0 as lam, -abs(target - i / 10.0) as v from t, range(0, 11) r(i)) select query_id, round(lam, 6) as target from (select *, row_number() over (partition by query_id order by v desc, lam) as r from v) where r = 1""",
)
def lambda_best(spark, folder):
    t = _accounts(spark, folder).select("query_id", "target", F.explode(F.array(*[F.lit(g) for g in adaptive.GRID])).alias("lam"))
    return adaptive.best_lambda(t.withColumn("value", -F.abs(F.col("target") - F.col("lam")))).select("query_id", F.round("target", 6).alias("target"))


def _hartree_sql(settings: str) -> str:
    """CTEs of the damped steps of every setting (first, gain), each up to its own last one, as ``hs``."""
    return f""", st(first, gain) as (select * from ({settings})),
  h as (select first, gain, query_id, tok, lap, 0 as t, first::double as lam from st, tl
    union all select first, gain, query_id, tok, lap, t + 1, 0.5 * lam + 0.5 * greatest(0.0, least(1.0, first + gain * pow((1 - lam) * tok + lam * lap, 2))) from h where t < 50),
  mv as (select first, gain, t, max(abs(lam - prev)) as m from (select *, lag(lam) over (partition by first, gain, query_id order by t) as prev from h) where t > 0 group by all),
  sp as (select first, gain, coalesce(min(t) filter (m < 0.01), 50) as steps from mv group by all),
  hs as (select h.first, h.gain, query_id, lam, list_reduce([i / 10.0 for i in range(0, 11)], lambda x, y: case when abs(y - lam) < abs(x - lam) then y else x end) as snapped from h join sp on h.first = sp.first and h.gain = sp.gain and h.t = sp.steps)"""


_SIDES = "with recursive tl as (select o_custkey::bigint as query_id, avg((o_orderkey % 7)::double) / 7 as tok, avg((o_orderkey % 5)::double) / 5 as lap from orders group by 1)"


def _sides(spark, folder):
    """Two values of every customer with orders."""
    o = base.table(spark, folder, "orders").groupBy(F.col("o_custkey").cast("bigint").alias("query_id"))
    return o.agg((F.avg((F.col("o_orderkey") % 7).cast("double")) / 7).alias("tok"), (F.avg((F.col("o_orderkey") % 5).cast("double")) / 5).alias("lap"))


@_q("lambda_fixed_point", _SIDES + _hartree_sql("values (0.3::double, 0.8::double)") + " select query_id, round(lam, 6) + 0.0 as lam, snapped::double as snapped from hs")
def lambda_fixed_point(spark, folder):
    return adaptive.hartree(_sides(spark, folder), 0.3, 0.8).select("query_id", _r(F.col("lam"), "lam"), "snapped")


#: The grid of both parameters.
FIRSTS, GAINS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], [0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0]


@_q(
    "lambda_fixed_point_grid",
    "with recursive " + (WA + _VALUES).removeprefix("with ") + ", tl as (select query_id, max(value) filter (lam = 0) as tok, max(value) filter (lam = 1) as lap from vl group by 1)"
    + _hartree_sql(f"select a::double as first, b::double as gain from (select unnest({FIRSTS}) as a), (select unnest({GAINS}) as b)")
    + " select first, gain, round(avg(value), 6) + 0.0 as value from hs join vl on vl.query_id = hs.query_id and abs(vl.lam - snapped) < 1e-6 group by all",
)
def lambda_fixed_point_grid(spark, folder):
    """Mean value at the self-consistent weights for every pair of parameters."""
    scores = _scores(spark, folder)[2]
    side = lambda g: F.max(F.when(F.round("lam", 1) == g, F.col("value")))
    rows = scores.groupBy("query_id").agg(side(0.0).alias("tok"), side(1.0).alias("lap"))
    return adaptive.best_hartree(rows, scores, FIRSTS, GAINS).select("first", "gain", _r(F.col("value"), "value"))


def _stream_rows(spark, folder):
    return _accounts(spark, folder).withColumn("step", F.col("query_id"))


@_q("bandit_replay")
def bandit_replay(spark, folder):
    t = _stream_rows(spark, folder)
    for k, g in enumerate((0.2, 0.5, 0.8)):
        t = t.withColumn(f"arm{k}", 1 - F.abs(F.col("target") - g))
    return adaptive.linucb_replay(t, STREAM, ["arm0", "arm1", "arm2"])


@_q(
    "online_lambda",
    """with recursive t as (select (c_nationkey % 5)::varchar as corpus, c_custkey::bigint as step, [c_acctbal / 10000, (c_custkey % 17) / 17.0, (c_custkey % 29) / 29.0, 1.0]::double[] as x,
    greatest(0.0, least(1.0, 0.3 + 0.4 * (c_acctbal / 10000) + 0.2 * ((c_custkey % 17) / 17.0)))::double as y from customer),
  o as (select *, row_number() over (partition by corpus order by step) as n from t),
  r as (select corpus, step, n, 0.0::double as p, y as residual, list_transform(x, lambda v: 0.05 * y * v / (1 + list_dot_product(x, x))) as w from o where n = 1
    union all select o.corpus, o.step, o.n, least(1.0, greatest(0.0, list_dot_product(r.w, o.x))), o.y - least(1.0, greatest(0.0, list_dot_product(r.w, o.x))),
      list_transform(range(1, 5), lambda i: r.w[i] + 0.05 * (o.y - list_dot_product(r.w, o.x)) * o.x[i] / (1 + list_dot_product(o.x, o.x))) from r join o on o.corpus = r.corpus and o.n = r.n + 1)
  select corpus, step, round(p, 6) + 0.0 as prediction, round(residual, 6) + 0.0 as residual from r""",
)
def online_lambda(spark, folder):
    return adaptive.online_lambda(_stream_rows(spark, folder), STREAM).select("corpus", "step", _r(F.col("prediction"), "prediction"), _r(F.col("residual"), "residual"))


@_q(
    "drift_alarms",
    """with recursive e as (select event_type, event_id, (value - 50) / 50 as x, row_number() over (partition by event_type order by event_id) as n from events where value is not null),
  r as (select event_type, event_id, n, x as ema, greatest(0.0, x - 0.05) > 1 or greatest(0.0, -x - 0.05) > 1 as alarm, greatest(0.0, x - 0.05) as up, greatest(0.0, -x - 0.05) as down from e where n = 1
    union all select event_type, event_id, n, ema, up > 1 or down > 1, case when up > 1 or down > 1 then 0.0 else up end, case when up > 1 or down > 1 then 0.0 else down end from (
      select e.event_type, e.event_id, e.n, 0.9 * r.ema + 0.1 * e.x as ema, greatest(0.0, (case when r.n = 1 and r.alarm then 0.0 else r.up end) + e.x - 0.05) as up, greatest(0.0, (case when r.n = 1 and r.alarm then 0.0 else r.down end) - e.x - 0.05) as down
      from r join e on e.event_type = r.event_type and e.n = r.n + 1) z)
  select event_type, event_id, round(ema, 6) + 0.0 as ema, alarm from r""",
)
def drift_alarms(spark, folder):
    e = base.table(spark, folder, "events").withColumn("x", (F.col("value") - 50) / 50)
    return adaptive.drift_replay(e, "event_type", "event_id", "x").select("event_type", "event_id", _r(F.col("ema"), "ema"), "alarm")


@_q("svd_spectrum")
def svd_spectrum(spark, folder):
    values, _ = linalg.svd(base.points(spark, folder), 8)
    return spark.createDataFrame([(k, float(round(v, 6))) for k, v in enumerate(values)], "k int, value double")


@_q("svd_energy", "select round(sum(list_dot_product(embedding::double[], embedding::double[])), 4) as energy, count(*) as n from embeddings")
def svd_energy(spark, folder):
    """The squared singular values add up to the squared length of all vectors."""
    p = base.points(spark, folder)
    values, _ = linalg.svd(p, SPEC.dim)
    return p.agg(F.count("*").alias("n")).select(F.lit(float(np.round((values**2).sum(), 4))).alias("energy"), "n")


@_q("chunk_residuals")
def chunk_residuals(spark, folder):
    """Intrinsic residuals of all usable chunk vectors."""
    c = decoded(base.table(spark, folder, "chunks").select("id", "file_id", "vector"), "vector", 64).where(usable(F.col("vec")))
    return linalg.intrinsic_residuals(c, 64)


#: The seeded generator and the matrix of the random projection, number by number.
_MATRIX = """with recursive u as (select k, (42 + (k + 1) * 1831565813) % 4294967296 as z from range(0, 2048) t(k)),
  v as (select k, (xor(z, z >> 15) * (z | 1)) % 4294967296 as t, z from (select k, z::ubigint as z from u)),
  w as (select k, xor(t, (t + (xor(t, t >> 7) * (t | 61)) % 4294967296) % 4294967296) as t from v),
  g as (select k, xor(t, t >> 14) / 4294967296.0::double as x from w),
  m as (select a.k // 2 as i, sqrt(-2 * ln(a.x + 1e-10)) * cos(2 * pi() * b.x) / 4.0 as x from g a join g b on b.k = a.k + 1 where a.k % 2 = 0),
  rw as (select i // 64 as r, list(x order by i) as row from m group by 1)"""


@_q(
    "random_projection",
    _MATRIX + ", " + PTS + """, y as (select doc_id, point_idx, r, list_dot_product(vec, row) as y from pts, rw), n as (select doc_id, point_idx, sqrt(sum(y * y)) + 1e-8 as n from y group by all)
  select doc_id, point_idx, r::bigint as i, round(y / n, 6) + 0.0 as value from y join n using (doc_id, point_idx)""",
)
def random_projection(spark, folder):
    """All coordinates."""
    p = linalg.random_projection(base.points(spark, folder), 64, 16)
    return p.select("doc_id", "point_idx", F.posexplode("projected").alias("i", "value")).select("doc_id", "point_idx", F.col("i").cast("bigint").alias("i"), _r(F.col("value"), "value"))


@_q(
    "bit_allocation",
    "with " + PTS + """, v as (select cast(floor((i - 1) / 8) as int) as subspace, avg(v) as v from (select i, var_pop(vec[i]) as v from pts, range(1, 65) t(i) group by 1) group by 1),
  b as (select *, least(12, greatest(4, round(8 + 1.5 * log2(v / (select avg(v) from v)))))::int as bits from v), g as (select 64 - sum(bits) as gap from b),
  o as (select *, row_number() over (order by case when gap > 0 then -v else v end, subspace) as r from b, g)
  select subspace, bits + case when r <= abs(gap) then sign(gap)::int else 0 end as bits from o""",
)
def bit_allocation(spark, folder):
    v = quantize.subspace_variance(base.points(spark, folder), SPEC).orderBy("subspace").collect()  # one row a subspace
    bits = quantize.allocate_bits([r.variance for r in v], 8 * len(v))
    return spark.createDataFrame([(r.subspace, b) for r, b in zip(v, bits)], "subspace int, bits int")


@_q("pq_variable_codes")
def pq_variable_codes(spark, folder):
    """Quality of codes whose subspaces have sizes of their own, 2 to the allocated bits (less 4)."""
    p = base.points(spark, folder)
    v = quantize.subspace_variance(p, SPEC).orderBy("subspace").collect()  # one row a subspace
    sizes = [2 ** max(1, b - 4) for b in quantize.allocate_bits([r.variance for r in v], 8 * len(v))]
    return quantize.quality(p, quantize.train(p, SPEC, sizes), SPEC)


@_q("sample_points", "select vec_id from embeddings order by md5(vec_id::varchar || ':42'), vec_id limit 50")
def sample_points(spark, folder):
    """A seeded random sample of 50."""
    return clouds.sampled(base.table(spark, folder, "embeddings"), ["vec_id"], 50, 42).select("vec_id")


@_q(
    "header_points",
    "with " + PTS + """, n as (select *, row_number() over (partition by doc_id order by sqrt(list_dot_product(vec, vec)) desc, point_idx) as a, row_number() over (partition by doc_id order by md5(doc_id::varchar || ':' || point_idx::varchar || ':7'), point_idx) as b, count(*) over (partition by doc_id) as n from pts)
  select how, doc_id, point_idx from (select 'max_norm' as how, doc_id, point_idx from n where a <= 2 union all select 'random', doc_id, point_idx from n where b <= 2 union all select 'first', doc_id, point_idx from n where point_idx < 2
    union all select 'uniform', doc_id, point_idx from n where n <= 2 or list_contains([floor(i * n / 2)::int for i in range(0, 2)], point_idx))""",
)
def header_points(spark, folder):
    """Two header points of every document under each selector."""
    p, out = base.points(spark, folder), None
    for how in clouds.SELECTORS:
        one = clouds.header(p, 2, how, 7).select(F.lit(how).alias("how"), "doc_id", "point_idx")
        out = one if out is None else out.unionByName(one)
    return out


@_q("lambda_evaluation")
def lambda_evaluation(spark, folder):
    """Value of each query's fused list at the weight chosen from its features alone."""
    a, b = _runs(spark, folder)
    runs = fusion.lambda_sweep(a, b, adaptive.GRID)
    scores = metrics.ndcg(runs, base.labels(spark, folder), 10, keys=("lam", "query_id")).withColumnRenamed("ndcg", "value")
    rows = adaptive.features(a, b).join(adaptive.best_lambda(scores), "query_id")
    chosen = adaptive.predict(adaptive.fit_ridge(rows, adaptive.FREE, 0.1), rows, adaptive.FREE).select("query_id", "lam")
    picked = chosen.join(scores.withColumn("lam", F.round("lam", 1)), ["query_id", "lam"])
    return picked.select("query_id", "lam", _r(F.col("value"), "ndcg"))
