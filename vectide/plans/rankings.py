"""Queries on fusion, ranking metrics and significance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import fusion, metrics, scan, stats
from vectide.plans import base
from vectide.plans.base import PTS, SPEC, SUB, chamfer_sql

QUERIES, ORACLES = {}, {}


def _r(c, name):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def _runs(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Two rankings of the same queries: centroid cosine and the first subspace-first distance, 20 each."""
    c = base.corpus(spark, folder)
    a = scan.scan(c.queries, c.docs, "centroid_cosine", SPEC, 20).select("query_id", "doc_id", (1 - F.col("value")).alias("score"))
    b = scan.scan(c.queries, c.docs, "subspace_first", SPEC, 20).select("query_id", "doc_id", F.exp(-2 * F.col("value")).alias("score"))
    return a, b


RUNS = (
    SUB + chamfer_sql() + """, cosd as (select query_id, doc_id, greatest(0.0, least(2.0, 1 - list_dot_product(qv, c) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(c, c))))) as value from q, cent where qi = 0),
  a as (select query_id, doc_id, 1 - value as score, r from (select *, row_number() over (partition by query_id order by value, doc_id) as r from cosd) where r <= 20),
  b as (select query_id, doc_id, exp(-2 * value) as score, r from (select *, row_number() over (partition by query_id order by value, doc_id) as r from cham) where r <= 20),
  lb as (select cast(vec_id / 5 as bigint) as doc_id, label from embeddings where vec_id % 5 = 0), qrels as (select x.doc_id as query_id, y.doc_id, 1 as rel from lb x join lb y using (label) where x.doc_id % 20 = 0)"""
)
WA = "with " + RUNS


def _q(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@_q("rrf_weighted", WA + " select query_id, doc_id, round(sum(w / (60.0 + r)), 6) + 0.0 as score from (select *, 0.7 as w from a union all select *, 0.3 from b) group by all")
def rrf_weighted(spark, folder):
    a, b = _runs(spark, folder)
    lists = a.withColumn("probe", F.lit("a")).unionByName(b.withColumn("probe", F.lit("b")))
    return fusion.reciprocal_rank(lists, 60.0, 1, {"a": 0.7, "b": 0.3}).select("query_id", "doc_id", _r(F.col("score"), "score"))


@_q(
    "search_results_rrf",
    """with l as (select query_id, channel, id as doc_id, max(case when channel = 'fts5' then -score else score end + 0.0) as v from search_results where score is not null and not isnan(score) group by all),
    r as (select *, row_number() over (partition by query_id, channel order by v desc, doc_id) as r from l), f as (select query_id, doc_id, sum(1 / (60.0 + r)) as s from r group by all)
    select query_id, doc_id, round(s, 6) + 0.0 as score from f""",
)
def search_results_rrf(spark, folder):
    """Reciprocal rank fusion of all stored result lists."""
    rows = base.table(spark, folder, "search_results")
    lists = rows.select("query_id", F.col("channel").alias("probe"), F.col("id").alias("doc_id"), (F.when(F.col("channel") == "fts5", -F.col("score")).otherwise(F.col("score")) + 0.0).alias("score"))
    return fusion.reciprocal_rank(lists, 60.0, 1).select("query_id", "doc_id", _r(F.col("score"), "score"))


@_q("rank_normalised", WA + " select query_id, doc_id, round(1 - (r - 1) / 19.0, 6) + 0.0 as score from a")
def rank_normalised(spark, folder):
    return fusion.rank_normalised(_runs(spark, folder)[0]).select("query_id", "doc_id", _r(F.col("score"), "score"))


@_q("min_max_half", WA + ", m as (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from a) select query_id, doc_id, round(case when hi - lo < 1e-12 then 0.5 else (score - lo) / (hi - lo) end, 6) + 0.0 as score from m")
def min_max_half(spark, folder):
    a = _runs(spark, folder)[0].withColumn("probe", F.lit("a"))
    return fusion.normalised(a, 0.5, 1e-12).select("query_id", "doc_id", _r(F.col("score"), "score"))


@_q(
    "softmax_allocation",
    """with s as (select c_custkey as query_id, t.i as index_name, (c_custkey * (t.n + 3) % 11) / 10.0 as sim from customer, (values ('case', 0), ('literature', 1), ('statute', 2)) t(i, n)),
    e as (select *, exp((sim - max(sim) over (partition by query_id)) / 0.5) as e from s), k as (select *, greatest(1, floor(e / sum(e) over (partition by query_id) * 20 + 0.5))::bigint as k from e),
    x as (select *, sum(k) over (partition by query_id) - 20 as ex, row_number() over (partition by query_id order by k desc, index_name desc) as p from k)
    select query_id, index_name, cast(case when p = 1 and ex > 0 and k > ex then k - ex else k end as bigint) as k from x""",
)
def softmax_allocation(spark, folder):
    c = base.table(spark, folder, "customer").select(F.col("c_custkey").cast("bigint").alias("query_id"))
    names = F.array(*[F.struct(F.lit(n).alias("i"), F.lit(k).alias("n")) for k, n in enumerate(("case", "literature", "statute"))])
    sims = c.withColumn("x", F.explode(names)).select("query_id", F.col("x.i").alias("index_name"), ((F.col("query_id") * (F.col("x.n") + 3) % 11) / 10.0).alias("sim"))
    return fusion.softmax_allocation(sims, 20, 0.5)


# -- metrics ----------------------------------------------------------------------
_IDEAL = ", idc as (select query_id, sum(1 / log2(r + 1)) as idcg from (select query_id, row_number() over (partition by query_id order by doc_id) as r from qrels) where r <= 10 group by 1)"
_NDCG = WA + _IDEAL + " select a.query_id, round(coalesce(sum(case when rel is not null then 1 / log2(r + 1) end), 0) / any_value(idcg), 6) + 0.0 as ndcg from a left join qrels on a.query_id = qrels.query_id and a.doc_id = qrels.doc_id join idc on idc.query_id = a.query_id where r <= 10 group by 1"
for _name, _exp in (("ndcg_exponential", True), ("ndcg_linear", False)):
    QUERIES[_name] = lambda spark, folder, e=_exp: metrics.ndcg(_runs(spark, folder)[0], base.labels(spark, folder), 10, e).select("query_id", _r(F.col("ndcg"), "ndcg"))
    ORACLES[_name] = _NDCG


@_q("ndcg_retrieved", WA + """, h as (select a.query_id, r, case when rel is null then 0 else 1 end as hit from a left join qrels on a.query_id = qrels.query_id and a.doc_id = qrels.doc_id where r <= 10),
  s as (select query_id, sum(hit / log2(r + 1)) as dcg, sum(hit) as n from h group by 1) select query_id, round(case when n > 0 then dcg / list_sum(list_transform(range(1, n::bigint + 1), lambda i: 1 / log2(i + 1))) else 0 end, 6) + 0.0 as ndcg from s""")  # fmt: skip
def ndcg_retrieved(spark, folder):
    return metrics.ndcg_binary_retrieved(_runs(spark, folder)[0], base.labels(spark, folder)).select("query_id", _r(F.col("ndcg"), "ndcg"))


@_q("mrr_recall", WA + """, h as (select a.query_id, r, rel from a left join qrels on a.query_id = qrels.query_id and a.doc_id = qrels.doc_id where r <= 10), t as (select query_id, count(*) as t from qrels group by 1)
  select h.query_id, round(coalesce(1.0 / min(case when rel > 0 then r end), 0.0), 6) as mrr, round(count(rel) / any_value(t)::double, 6) + 0.0 as recall from h join t using (query_id) group by 1""")  # fmt: skip
def mrr_recall(spark, folder):
    a, qrels = _runs(spark, folder)[0], base.labels(spark, folder)
    both = metrics.reciprocal_rank(a, qrels).join(metrics.recall(a, qrels, 10), "query_id")
    return both.select("query_id", F.round("mrr", 6).alias("mrr"), _r(F.col("recall"), "recall"))


_PAIRS = WA + """, j as (select a.query_id, a.doc_id, a.score as x, b.score as y from a join b on a.query_id = b.query_id and a.doc_id = b.doc_id),
  p as (select l.query_id, sign(l.x - r.x) as dx, sign(l.y - r.y) as dy from j l join j r on l.query_id = r.query_id and l.doc_id < r.doc_id),
  c as (select query_id, sum((dx * dy > 0)::int) as c, sum((dx * dy < 0)::int) as d, sum((dx = 0 and dy <> 0)::int) as tx, sum((dy = 0 and dx <> 0)::int) as ty, count(*) as n from p group by 1)"""  # fmt: skip


@_q("kendall_tau_b", _PAIRS + " select query_id, round((c - d) / sqrt((c + d + tx)::double * (c + d + ty)), 6) + 0.0 as tau from c")
def kendall_tau_b(spark, folder):
    return metrics.kendall(*_runs(spark, folder)).select("query_id", _r(F.col("tau"), "tau"))


@_q("kendall_tau_a", _PAIRS + " select query_id, round((c - d) / n::double, 6) + 0.0 as tau from c")
def kendall_tau_a(spark, folder):
    return metrics.kendall(*_runs(spark, folder), ties=False).select("query_id", _r(F.col("tau"), "tau"))


@_q("spearman_rho", _PAIRS + ", k as (select query_id, row_number() over (partition by query_id order by x desc, doc_id) as rx, row_number() over (partition by query_id order by y desc, doc_id) as ry from j) select query_id, round(corr(rx, ry), 6) + 0.0 as rho from k group by 1")
def spearman_rho(spark, folder):
    return metrics.spearman(*_runs(spark, folder)).select("query_id", _r(F.col("rho"), "rho"))


@_q("jaccard_at_10", WA + ", u as (select coalesce(x.query_id, y.query_id) as query_id, x.doc_id as xd, y.doc_id as yd from (select * from a where r <= 10) x full join (select * from b where r <= 10) y on x.query_id = y.query_id and x.doc_id = y.doc_id) select query_id, round(sum((xd is not null and yd is not null)::int) / count(*)::double, 6) + 0.0 as jaccard from u group by 1")
def jaccard_at_10(spark, folder):
    return metrics.jaccard_at(*_runs(spark, folder), 10).select("query_id", _r(F.col("jaccard"), "jaccard"))


def _values(spark, folder) -> DataFrame:
    """Per-query values: of every customer with orders, the share of urgent orders before and after the middle of the line."""
    o = base.table(spark, folder, "orders")
    return o.groupBy(F.col("o_custkey").cast("bigint").alias("query_id")).agg(F.avg((F.col("o_orderkey") % 7).cast("double")).alias("a"), F.avg((F.col("o_orderkey") % 5).cast("double")).alias("b"))


_VALUES = "with v as (select o_custkey::bigint as query_id, avg((o_orderkey % 7)::double) as a, avg((o_orderkey % 5)::double) as b from orders group by 1)"


@_q("quadrants", _VALUES + " select coalesce(sum((a > 3 and b > 3)::int), 0)::bigint as both, coalesce(sum((a > 3 and b <= 3)::int), 0)::bigint as only_a, coalesce(sum((a <= 3 and b > 3)::int), 0)::bigint as only_b, coalesce(sum((a <= 3 and b <= 3)::int), 0)::bigint as neither from v")
def quadrants(spark, folder):
    v = _values(spark, folder)
    return metrics.quadrants(v.select("query_id", F.col("a").alias("ndcg")), v.select("query_id", F.col("b").alias("ndcg")), threshold=3.0)


@_q("gain_complementarity", _VALUES + ", g as (select a - 3 as x, b - 3 as y from v) select sum((x > 0 and y > 0)::int)::bigint as both_up, sum((x > 0 and y <= 0)::int)::bigint as a_up, sum((x <= 0 and y > 0)::int)::bigint as b_up, sum((x <= 0 and y <= 0)::int)::bigint as none_up, round(corr(x, y), 6) as pearson, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) as cosine from g")
def gain_complementarity(spark, folder):
    r = stats.complementarity(_values(spark, folder).withColumn("base", F.lit(3.0)))
    return r.select("both_up", "a_up", "b_up", "none_up", F.round("pearson", 6).alias("pearson"), F.round("cosine", 6).alias("cosine"))


@_q("summary_by_nation", "select c_nationkey::bigint as nation, count(*) as n, round(avg(c_acctbal), 4) as mean, round(stddev_pop(c_acctbal), 4) as std from customer group by 1")
def summary_by_nation(spark, folder):
    c = base.table(spark, folder, "customer").withColumn("nation", F.col("c_nationkey").cast("bigint"))
    return stats.summary(c, "c_acctbal", ("nation",)).select("nation", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def _boot(rule, seeds):
    return lambda spark, folder: stats.paired_bootstrap(_values(spark, folder), 10_000, seeds, rule)


#: The shifted rule over 51 seeds, the robustness report; the others over one.
for _rule, _seeds in (("shifted", tuple(range(51))), ("one_sided", (42,)), ("percentile", (42,))):
    QUERIES[f"bootstrap_{_rule}"] = _boot(_rule, _seeds)


@_q("upper_median", "with v as (select l_orderkey as k, list_sort(list(l_quantity)) as q from lineitem group by 1) select k, q[(len(q) // 2 + 1)::int]::double as median, case when len(list_filter(q, lambda x: x > 0)) > 0 then q[least(floor(len(q) * 0.9)::int, len(q) - 1) + 1]::double else 0.0 end as p90 from v")
def upper_median(spark, folder):
    v = base.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.col("l_quantity").cast("double")).alias("q"))
    return v.select("k", stats.upper_median(F.col("q")).alias("median"), stats.floor_percentile(F.col("q"), 0.9).alias("p90"))


@_q("running_by_type", "select event_id, round(avg(value) over (partition by event_type order by ts, event_id rows between 50 preceding and current row), 6) as running_mean, round(sum(value) over (partition by event_type order by ts, event_id rows unbounded preceding), 4) as running_sum from events")
def running_by_type(spark, folder):
    e = base.table(spark, folder, "events").withColumn("o", F.struct("ts", "event_id"))
    return stats.running(e, "o", "value", 50, "event_type").select("event_id", F.round("running_mean", 6).alias("running_mean"), F.round("running_sum", 4).alias("running_sum"))


@_q("top_k_events", "select event_type as query_id, event_id as doc_id, value, r as rank from (select *, row_number() over (partition by event_type order by value, event_id) as r from events where value is not null and not isnan(value)) where r <= 10")
def top_k_events(spark, folder):
    e = base.table(spark, folder, "events").select(F.col("event_type").alias("query_id"), F.col("event_id").alias("doc_id"), "value")
    return scan.top_k(e, 10)


def _scattered(spark, folder) -> DataFrame:
    """``id, a, b``: every vector with the one whose number its own is scattered to."""
    e = base.points(spark, folder).select((F.col("doc_id") * 5 + F.col("point_idx")).alias("id"), F.col("vec").alias("a"))
    n = e.count()
    asked = e.withColumn("other", (F.col("id") * 7919 + 104729) % max(n, 1)).where("other != id")
    return asked.join(e.select(F.col("id").alias("other"), F.col("a").alias("b")), "other").select("id", "a", "b")


@_q(
    "sigma_subspace",
    f"with {PTS}, e as (select doc_id * 5 + point_idx as id, vec as v from pts), s as (select a.id, t.s, list_dot_product(a.v[8*s+1:8*s+8], b.v[8*s+1:8*s+8]) / (sqrt(list_dot_product(a.v[8*s+1:8*s+8], a.v[8*s+1:8*s+8])) * sqrt(list_dot_product(b.v[8*s+1:8*s+8], b.v[8*s+1:8*s+8]))) as c from e a join e b on b.id = (a.id * 7919 + 104729) % (select count(*) from e) and b.id <> a.id, range(0, 8) t(s)),"
    " f as (select stddev_pop(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) as sd from e a join e b on b.id = (a.id * 7919 + 104729) % (select count(*) from e) and b.id <> a.id)"
    " select s as subspace, round(stddev_pop(c), 6) as sigma, round(stddev_pop(c) / any_value(sd), 6) as ratio from s, f group by 1",
)
def sigma_subspace(spark, folder):
    """Spread of pairwise cosines in each subspace against that of the whole vectors; every vector meets one other, scattered over all."""
    p = _scattered(spark, folder)
    full = p.agg(F.stddev_pop(V.cosine_similarity(F.col("a"), F.col("b"))).alias("sd"))
    subs = p.select(F.posexplode(F.zip_with(V.sub_vectors(F.col("a"), SPEC), V.sub_vectors(F.col("b"), SPEC), V.cosine_similarity)).alias("s", "c"))
    by = subs.groupBy(F.col("s").cast("bigint").alias("subspace")).agg(F.stddev_pop("c").alias("sigma"))
    return by.join(F.broadcast(full)).select("subspace", F.round("sigma", 6).alias("sigma"), F.round(F.col("sigma") / F.col("sd"), 6).alias("ratio"))  # one row




@_q(
    "sigma_sweep",
    f"with {PTS}, e as (select doc_id * 5 + point_idx as id, vec as v from pts), p as (select a.id, a.v as a, b.v as b from e a join e b on b.id = (a.id * 7919 + 104729) % (select count(*) from e) and b.id <> a.id),"
    " f as (select stddev_pop(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))) as sd from p),"
    " s as (select id, m, s, list_dot_product(a[w*s+1:w*s+w], b[w*s+1:w*s+w]) / (sqrt(list_dot_product(a[w*s+1:w*s+w], a[w*s+1:w*s+w])) * sqrt(list_dot_product(b[w*s+1:w*s+w], b[w*s+1:w*s+w]))) as c"
    "   from p, (values (2, 32), (4, 16), (8, 8), (16, 4)) t(m, w), range(0, 16) r(s) where s < m),"
    " k as (select m, avg(corr) as rho from (select x.m, x.s, y.s, corr(x.c, y.c) as corr from s x join s y on x.m = y.m and x.id = y.id and x.s < y.s group by all) group by m),"
    " g as (select m, avg(sg) as sigma from (select m, s, stddev_pop(c) as sg from s group by all) group by m)"
    " select g.m as parts, round(sigma / sd, 6) as ratio, round(rho, 6) + 0.0 as rho, round(sqrt(g.m / (1 + (g.m - 1) * rho)), 6) as predicted from g join k on g.m = k.m, f",
)
def sigma_sweep(spark, folder):
    """Ratio of subspace to full cosine spread for several numbers of subspaces, and sqrt(M / (1 + (M - 1) rho))."""
    from vectide.functions.vectors import SubspaceSpec

    p = _scattered(spark, folder)
    full = p.agg(F.stddev_pop(V.cosine_similarity(F.col("a"), F.col("b"))).alias("sd"))
    sims = None
    for m in (2, 4, 8, 16):
        spec = SubspaceSpec(m, 64 // m)
        one = p.select("id", F.lit(m).alias("parts"), F.posexplode(F.zip_with(V.sub_vectors(F.col("a"), spec), V.sub_vectors(F.col("b"), spec), V.cosine_similarity)).alias("s", "c"))
        sims = one if sims is None else sims.unionByName(one)
    sigma = sims.groupBy("parts", "s").agg(F.stddev_pop("c").alias("g")).groupBy("parts").agg(F.avg("g").alias("sigma"))
    x, y = sims.alias("x"), sims.alias("y")
    pairs = x.join(y, F.expr("x.parts = y.parts and x.id = y.id and x.s < y.s")).groupBy(F.col("x.parts").alias("parts"), F.col("x.s").alias("s"), F.col("y.s").alias("t")).agg(F.corr("x.c", "y.c").alias("r"))
    rho = pairs.groupBy("parts").agg(F.avg("r").alias("rho"))
    out = sigma.join(rho, "parts").join(F.broadcast(full))  # one row
    predicted = F.sqrt(F.col("parts") / (1 + (F.col("parts") - 1) * F.col("rho")))
    return out.select("parts", F.round(F.col("sigma") / F.col("sd"), 6).alias("ratio"), _r(F.col("rho"), "rho"), F.round(predicted, 6).alias("predicted"))
