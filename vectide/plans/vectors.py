"""Queries on vectors, clouds and set distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import clouds, kernels, quantize, scan
from vectide.plans import base
from vectide.plans.base import BOOK, PTS, SPEC, SUB, chamfer_sql, top_sql

QUERIES, ORACLES = {}, {}
K = 10


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _r(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


# -- scalar vector functions -------------------------------------------------------
@query(
    "vec_distances",
    f"""with {PTS}, e as (select doc_id * 5 + point_idx as id, vec as v from pts),
    p as (select a.id, a.v as a, b.v as b from e a join e b on b.id = a.id + 1),
    n as (select *, sqrt(list_dot_product(a, a)) as na, sqrt(list_dot_product(b, b)) as nb, list_dot_product(a, b) as ab from p),
    s as (select id, avg(case when x < 1e-9 or y < 1e-9 then 1.0 else greatest(0.0, 1 - xy / (x * y)) end) as clamped,
      avg(case when x * y < 1e-16 then 1.0 else 1 - xy / (x * y + 1e-8) end) as plain,
      avg(case when x < 1e-12 or y < 1e-12 then 1.0 else 1 - greatest(-1.0, least(1.0, xy / (x * y))) end) as scan
      from (select id, s, list_dot_product(a[8*s+1:8*s+8], b[8*s+1:8*s+8]) as xy, sqrt(list_dot_product(a[8*s+1:8*s+8], a[8*s+1:8*s+8])) as x,
        sqrt(list_dot_product(b[8*s+1:8*s+8], b[8*s+1:8*s+8])) as y from p, range(0, 8) t(s)) group by id)
    select n.id, round(ab, 6) + 0.0 as dot, round(case when na < 1e-9 or nb < 1e-9 then 0.0 else ab / (na * nb) end, 6) + 0.0 as cosine,
      round(case when na < 1e-9 or nb < 1e-9 then 1.0 else greatest(0.0, least(2.0, 1 - ab / (na * nb))) end, 6) + 0.0 as distance,
      round(ab / (na * nb + 1e-8), 6) + 0.0 as cosine_eps, round(list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i]) * (a[i] - b[i]))), 6) + 0.0 as l2,
      round(clamped, 6) + 0.0 as clamped, round(plain, 6) + 0.0 as plain, round(scan, 6) + 0.0 as scan
    from n join s on n.id = s.id""",
)
def vec_distances(spark: SparkSession, folder: str) -> DataFrame:
    e = base.points(spark, folder).select((F.col("doc_id") * 5 + F.col("point_idx")).alias("id"), F.col("vec").alias("a"))
    p = e.join(e.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    a, b = F.col("a"), F.col("b")
    return p.select(
        "id", _r(V.dot(a, b), "dot"), _r(V.cosine_similarity(a, b), "cosine"), _r(V.cosine_distance(a, b), "distance"), _r(V.cosine_eps(a, b), "cosine_eps"), _r(V.l2_squared(a, b), "l2"),
        _r(V.subspace_distance(a, b, SPEC, V.CLAMPED), "clamped"), _r(V.subspace_distance(a, b, SPEC, V.PLAIN), "plain"), _r(V.subspace_distance(a, b, SPEC, V.SCAN), "scan"),
    )


@query("vec_sub_norms", f"with {SUB} select doc_id, point_idx, s as subspace, round(n, 6) + 0.0 as norm from sn")
def vec_sub_norms(spark, folder):
    p = base.points(spark, folder)
    return p.select("doc_id", "point_idx", F.posexplode(V.sub_norms(F.col("vec"), SPEC)).alias("subspace", "norm")).withColumn("norm", F.round("norm", 6) + 0.0)


@query(
    "vec_normalised",
    f"""with {PTS}, n as (select *, sqrt(list_dot_product(vec, vec)) as n from pts)
    select doc_id, point_idx, round(case when n > 0 then vec[1] / n else vec[1] end, 6) + 0.0 as first, list_bool_and(list_transform(vec, lambda x: x = 0)) as zero from n""",
)
def vec_normalised(spark, folder):
    p = base.points(spark, folder)
    return p.select("doc_id", "point_idx", _r(F.element_at(V.normalised(F.col("vec")), 1), "first"), V.is_zero(F.col("vec")).alias("zero"))


@query(
    "vec_score_transforms",
    """select vec_id, round(exp(-2 * embedding[1]::double), 6) + 0.0 as similarity,
    round((embedding[1]::double - min(embedding[1]::double) over (partition by label)) / case when max(embedding[1]::double) over (partition by label) - min(embedding[1]::double) over (partition by label) = 0
      then 1e-8 else max(embedding[1]::double) over (partition by label) - min(embedding[1]::double) over (partition by label) end, 6) + 0.0 as min_max,
    case when embedding[1]::double <= 0.05 then 0.0 when embedding[1]::double <= 0.15 then 0.1 else 0.2 end as snapped from embeddings""",
)
def vec_score_transforms(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("label")
    x = F.element_at("embedding", 1).cast("double")
    e = base.table(spark, folder, "embeddings").select("vec_id", "label", x.alias("x"))
    snapped = V.snap(F.col("x"), [0.0, 0.1, 0.2])
    return e.select("vec_id", _r(V.similarity_of_distance(F.col("x")), "similarity"), _r(V.min_max(F.col("x"), F.min("x").over(w), F.max("x").over(w)), "min_max"), snapped.alias("snapped"))


@query("vec_zero_rate", "select count(*) as n, coalesce(sum(case when list_bool_and(list_transform(embedding, lambda x: x = 0)) then 1 else 0 end), 0)::bigint as zeros from embeddings")
def vec_zero_rate(spark, folder):
    return base.table(spark, folder, "embeddings").agg(F.count("*").alias("n"), F.coalesce(F.sum(V.is_zero(F.col("embedding")).cast("bigint")), F.lit(0)).alias("zeros"))


# -- clouds -----------------------------------------------------------------------
@query(
    "cloud_points",
    """with u as (select distinct id, file_id from chunks where vector is not null and octet_length(vector) = 256)
    select file_id as doc_id, id, cast(row_number() over (partition by file_id order by id) - 1 as int) as point_idx from u""",
)
def cloud_points(spark, folder):
    """Points of the chunk clouds; null vectors and those of another length are skipped."""
    from pyspark.sql import Window

    c = base.table(spark, folder, "chunks").where("vector is not null and octet_length(vector) = 256").select("id", "file_id").distinct()
    return c.select(F.col("file_id").alias("doc_id"), "id", (F.row_number().over(Window.partitionBy("file_id").orderBy("id")) - 1).cast("int").alias("point_idx"))


@query("cloud_sizes", f"with {PTS} select count(distinct doc_id) as documents, count(*) as points, sum(len(vec) * 4)::bigint as bytes from pts")
def cloud_sizes(spark, folder):
    return clouds.sizes(base.points(spark, folder))


@query("cloud_centroids", f"with {PTS} select doc_id, i - 1 as dim, round(c[i], 6) + 0.0 as mean from cent, range(1, 65) t(i)")
def cloud_centroids(spark, folder):
    c = clouds.centroids(base.points(spark, folder))
    return c.select("doc_id", F.posexplode("centroid").alias("dim", "mean")).select("doc_id", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"))


FAR = """, far as (select doc_id, point_idx, vec, row_number() over (partition by doc_id order by greatest(0.0, 1 - list_dot_product(vec, c) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(c, c)))) desc, point_idx) as r
  from pts join cent using (doc_id)), rep as (select doc_id, list(m order by i) as rv from (select doc_id, i, avg(vec[i]) as m from far, range(1, 65) t(i) where r <= 3 group by 1, 2) group by 1)"""


@query("cloud_far_points", f"with {PTS} {FAR} select doc_id, round(list_sum(rv), 6) + 0.0 as total, round(sqrt(list_dot_product(rv, rv)), 6) + 0.0 as norm from rep")
def cloud_far_points(spark, folder):
    """Mean of the three points farthest from each centroid, as a window top-k and a mean."""
    p = base.points(spark, folder).join(clouds.centroids(base.points(spark, folder)), "doc_id")
    far = scan.top_k(p.withColumn("value", V.cosine_distance(F.col("vec"), F.col("centroid"))), 3, "value", False, "doc_id", "point_idx")
    rep = clouds.centroids(far.select("doc_id", "vec"))
    c = F.col("centroid")
    return rep.select("doc_id", _r(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), "total"), _r(V.norm(c), "norm"))


@query(
    "cloud_density_weights",
    f"""with {SUB}, near as (select doc_id, point_idx, avg(d) as m from (select a.doc_id, a.point_idx, d, row_number() over (partition by a.doc_id, a.point_idx order by d) as r from (
      select a.doc_id, a.point_idx, b.point_idx as o, avg(case when a.n * b.n < 1e-16 then 1.0 else 1.0 - list_dot_product(a.v, b.v) / (a.n * b.n + 1e-8) end) as d
      from sn a join sn b on a.doc_id = b.doc_id and a.s = b.s and a.point_idx <> b.point_idx group by all) a) where r <= 3 group by all)
    select doc_id, point_idx, round((1 / (m + 1e-8)) / sum(1 / (m + 1e-8)) over (partition by doc_id), 6) + 0.0 as weight from near""",
)
def cloud_density_weights(spark, folder):
    from pyspark.sql import Window

    s = quantize.sub_rows(base.points(spark, folder), SPEC)
    a, b = s.alias("a"), s.alias("b")
    d = a.join(b, F.expr("a.doc_id = b.doc_id and a.subspace = b.subspace and a.point_idx != b.point_idx")).select("a.doc_id", "a.point_idx", F.col("b.point_idx").alias("o"), V.kernel_distance(F.col("a.sv"), F.col("b.sv"), V.PLAIN).alias("d"))
    d = d.groupBy("doc_id", "point_idx", "o").agg(F.avg("d").alias("d"))
    near = d.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "point_idx").orderBy("d"))).where("r <= 3").groupBy("doc_id", "point_idx").agg(F.avg("d").alias("m"))
    w = 1 / (F.col("m") + 1e-8)
    return near.select("doc_id", "point_idx", _r(w / F.sum(w).over(Window.partitionBy("doc_id")), "weight"))


# -- set distances: every query cloud against every cloud -------------------------------
def _scan(metric: str, **options):
    def run(spark, folder):
        c = base.corpus(spark, folder)
        hits = scan.scan(c.queries, c.docs, metric, SPEC, K, **options)
        return hits.select("query_id", "doc_id", _r(F.col("value"), "score"), "rank")

    return run


ONE = """, one as (select q.query_id, qi, d.doc_id, di, 0 as s, list_dot_product(qv, dv) as ip,
  greatest(0.0, 1 - list_dot_product(qv, dv) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(dv, dv)))) as dist from q, d)"""
_UNALIGNED = """, una as (select a.doc_id as query_id, a.point_idx * 8 + a.s as qi, b.doc_id, b.point_idx * 8 + b.s as di, 0 as s,
  case when a.n * b.n < 1e-16 then 1.0 else 1.0 - list_dot_product(a.v, b.v) / (a.n * b.n + 1e-8) end as dist from sn a, sn b where a.doc_id % 20 = 0)"""
_CENTRE = """, cs as (select doc_id, s, c[8*s+1:8*s+8] as v, sqrt(list_dot_product(c[8*s+1:8*s+8], c[8*s+1:8*s+8])) as n from cent, range(0, 8) t(s)),
  cd as (select a.doc_id as query_id, a.point_idx as qi, b.doc_id, a.s, case when a.n * b.n < 1e-16 then 1.0 else 1.0 - list_dot_product(a.v, b.v) / (a.n * b.n + 1e-8) end as dist
    from sn a join cs b on a.s = b.s where a.doc_id % 20 = 0)"""
CENTROID_SCAN = _CENTRE + ", cham as (select query_id, doc_id, avg(x) as value from (select query_id, doc_id, s, avg(dist) + min(dist) as x from cd group by all) group by all)"
QUERY_CLOUD = ", cham as (select query_id, doc_id, avg(x) as value from (select query_id, doc_id, s, min(dist) + avg(dist) as x from psd where qi = 0 group by all) group by all)"
#: Of the query's first vector: least and mean distance in each subspace.
BY_SUBSPACE = ", sd as (select query_id, doc_id, s, min(dist) as lo, avg(dist) as mean from psd where qi = 0 group by all)"
SCANS = {
    "chamfer_pair_first": ("pair_first", SUB + chamfer_sql("cdist", subspace_first=False)),
    "chamfer_scan_kernel": ("scan_pair_first", SUB + chamfer_sql("sdist", subspace_first=False)),
    "chamfer_subspace_first": ("subspace_first", SUB + chamfer_sql()),
    "chamfer_query_vector": ("query_to_cloud", SUB + QUERY_CLOUD),
    "chamfer_centroid": ("cloud_to_centroid", SUB + CENTROID_SCAN),
    "chamfer_plain": ("plain_chamfer", PTS + ONE + chamfer_sql("dist", "one")),
    "chamfer_unaligned": ("unaligned", SUB + _UNALIGNED + chamfer_sql("dist", "una")),
    "max_sim": ("max_sim", PTS + ONE + ", cham as (select query_id, doc_id, sum(m) as value from (select query_id, doc_id, qi, max(ip) as m from one group by all) group by all)"),
    "max_sim_distance": ("max_sim_distance", PTS + ONE + ", cham as (select query_id, doc_id, avg(m) as value from (select query_id, doc_id, qi, min(dist) as m from one group by all) group by all)"),
    "max_sim_symmetric": ("symmetric_max_sim_distance", PTS + ONE + chamfer_sql("dist", "one").replace("avg(x + y) as value", "avg(x + y) / 2 as value")),
    "chamfer_header": ("header_chamfer", SUB + ", pp as (select query_id, doc_id, qi, di, avg(cdist) as d from psd group by all), cham as (select query_id, doc_id, avg(m) as value from (select query_id, doc_id, qi, min(d) as m from pp group by all) group by all)"),
    "centroid_cosine": ("centroid_cosine", PTS + ", cham as (select query_id, doc_id, greatest(0.0, least(2.0, 1 - list_dot_product(qv, c) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(c, c))))) as value from q, cent where qi = 0)"),
    "probe_far_points": ("max_point_cosine", SUB + FAR + """, rs as (select doc_id, s, rv[8*s+1:8*s+8] as v from rep, range(0, 8) t(s)),
      cham as (select query_id, doc_id, max(x) as value from (select a.doc_id as query_id, a.point_idx, b.doc_id, avg(1 - case when a.n * sqrt(list_dot_product(b.v, b.v)) < 1e-16 then 1.0 else 1.0 - list_dot_product(a.v, b.v) / (a.n * sqrt(list_dot_product(b.v, b.v)) + 1e-8) end) as x
      from sn a join rs b on a.s = b.s where a.doc_id % 20 = 0 group by all) group by all)"""),
    "chamfer_softmax_dual": ("softmax_dual", SUB + BY_SUBSPACE + """, wm as (select *, exp((1 - lo - max(1 - lo) over (partition by query_id, doc_id)) / 0.1) as w from sd),
      cham as (select query_id, doc_id, sum(w * (lo + mean)) / sum(w) as value from wm group by all)"""),
    "chamfer_hierarchical": ("hierarchical_dual", SUB + BY_SUBSPACE + """, gap as (select a.query_id, a.doc_id, a.s, b.s as t, sum((a.dist - b.dist) * (a.dist - b.dist)) as g from psd a join psd b on a.query_id = b.query_id and a.doc_id = b.doc_id and a.di = b.di and a.qi = 0 and b.qi = 0 and a.s <> b.s group by all),
      near as (select query_id, doc_id, s, t from (select *, row_number() over (partition by query_id, doc_id, s order by g, t) as r from gap) where r <= 8),
      ar as (select n.query_id, n.doc_id, n.s, avg(sd.lo) as around from near n join sd on sd.query_id = n.query_id and sd.doc_id = n.doc_id and sd.s = n.t group by all),
      cham as (select query_id, doc_id, 0.7 * avg(lo + mean) + 0.3 * avg(sqrt(greatest(lo * around, 0.0))) as value from sd join ar using (query_id, doc_id, s) group by all)"""),
    "chamfer_sampled": ("sampled_chamfer", SUB.replace("where a.doc_id % 20 = 0)", "where a.doc_id % 20 = 0 and a.point_idx in (0, 1, 3) and b.point_idx in (0, 1, 3))") + chamfer_sql()),
}
for _name, (_metric, _sql) in SCANS.items():
    QUERIES[_name] = _scan(_metric)
    ORACLES[_name] = "with " + _sql + top_sql("value", "cham", K, asc=_metric not in kernels.SIMILARITIES)
QUERIES["chamfer_density"] = _scan("density_chamfer", near=3)
ORACLES["chamfer_density"] = (
    ORACLES["cloud_density_weights"].split("select doc_id, point_idx, round(")[0]
    + """, wt as (select doc_id, point_idx as di, (1 / (m + 1e-8)) / sum(1 / (m + 1e-8)) over (partition by doc_id) as w from near),
    t1 as (select query_id, doc_id, s, avg(m) as x from (select query_id, doc_id, s, qi, min(dist) as m from psd group by all) group by all),
    t2 as (select query_id, doc_id, s, sum(m * w) as y from (select query_id, doc_id, s, di, min(dist) as m from psd group by all) join wt using (doc_id, di) group by all),
    cham as (select query_id, doc_id, avg(x + y) as value from t1 join t2 using (query_id, doc_id, s) group by all)"""
    + top_sql("value", "cham", K)
)


@query("chamfer_relational", "with " + SUB + chamfer_sql() + top_sql("value", "cham", K))
def chamfer_relational(spark, folder):
    """The same distance in joins and aggregates only, against which the Arrow form is checked."""
    values = quantize.relational_chamfer(base.query_points(spark, folder), base.points(spark, folder), SPEC)
    return scan.top_k(values, K).select("query_id", "doc_id", _r(F.col("value"), "score"), "rank")


_FID = """with {pts}, mv as (select doc_id, list(m order by i) as m, list(v order by i) as v from (select doc_id, i, avg(vec[i]) as m, var_pop(vec[i]) as v from pts, range(1, 65) t(i) group by 1, 2) group by 1),
  cham as (select a.doc_id as query_id, b.doc_id, list_sum(list_transform(range(1, 65), lambda i: (a.m[i] - b.m[i]) * (a.m[i] - b.m[i]) + 0.5 * {term})) as value from mv a, mv b where a.doc_id % 20 = 0)"""


_STD = "(sqrt(a.v[i]) - sqrt(b.v[i])) * (sqrt(a.v[i]) - sqrt(b.v[i]))"
QUERIES["fid"] = _scan("diagonal_fid", spread="std")
ORACLES["fid"] = _FID.format(pts=PTS, term=_STD) + top_sql("value", "cham", K)
QUERIES["fid_doc_only"] = _scan("diagonal_fid_document")
ORACLES["fid_doc_only"] = _FID.format(pts=PTS, term=_STD) + top_sql("value", "cham", K)


@query(
    "fid_variance",
    _FID.split("cham as")[0].format(pts=PTS) + """pr as (select a.doc_id as query_id, b.doc_id, list_sum(list_transform(range(1, 65), lambda i: (a.m[i] - b.m[i]) * (a.m[i] - b.m[i]))) as mu, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) as va from mv a, mv b where a.doc_id % 20 = 0),
  cham as (select query_id, doc_id, mu + 1.0 * (select avg(mu) / avg(va) from pr) * va as value from pr)""" + top_sql("value", "cham", K),
)
def fid_variance(spark, folder):
    """Means and variances at one size: the scale is that of all pairs of a query and a document."""
    c = base.corpus(spark, folder)
    hits = scan.scan(c.queries, c.docs, "diagonal_fid", SPEC, K, weight=1.0, scale=clouds.fid_scale(c.queries, c.docs, SPEC.dim))
    return hits.select("query_id", "doc_id", _r(F.col("value"), "score"), "rank")


@query(
    "shape_boost",
    f"with {PTS}, sims as (select query_id, doc_id, di, list_dot_product(qv, dv) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(dv, dv))) as x from q, d where qi = 0),"
    " t3 as (select query_id, doc_id, avg(x) as t from (select *, row_number() over (partition by query_id, doc_id order by x desc) as r from sims) where r <= 3 group by all),"
    " cc as (select query_id, doc_id, list_dot_product(qv, c) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(c, c))) as y from q, cent where qi = 0),"
    " cham as (select query_id, doc_id, 0.6 * y + 0.4 * (0.5 * m + 0.5 * t) as value, 0.7 * m + 0.3 * a as mixed from cc join t3 using (query_id, doc_id) join (select query_id, doc_id, max(x) as m, avg(x) as a from sims group by all) using (query_id, doc_id))"
    " select query_id, doc_id, round(value, 6) + 0.0 as score, round(mixed, 6) + 0.0 as mixed, rank from (select *, row_number() over (partition by query_id order by value desc, doc_id) as rank from cham) where rank <= 10",
)
def shape_boost(spark, folder):
    """Document cosine with the largest and the three largest point cosines, and the mixed start field of the largest and the mean."""
    c = base.corpus(spark, folder)
    hits = scan.scan(c.queries, c.docs, "shape_boost", SPEC, K)
    mixed = scan.pair_values(hits, c.queries, c.docs, "mixed_field", SPEC).withColumnRenamed("value", "m")
    return hits.join(mixed, ["query_id", "doc_id"]).select("query_id", "doc_id", _r(F.col("value"), "score"), _r(F.col("m"), "mixed"), "rank")


# -- quantization --------------------------------------------------------------------
@query("pq_codes", "with " + SUB + BOOK + " select doc_id, point_idx, subspace, code from enc")
def pq_codes(spark, folder):
    return quantize.encode(base.points(spark, folder), base.codebook(spark, folder), SPEC)


@query(
    "pq_reconstruction",
    "with " + SUB + BOOK + """, er as (select n.doc_id, n.point_idx, sum(list_dot_product(n.v, b.cv)) as ab, sum(list_dot_product(b.cv, b.cv)) as bb, sum(n.n * n.n) as aa
    from sn n join enc e on n.doc_id = e.doc_id and n.point_idx = e.point_idx and n.s = e.subspace join book b on b.subspace = e.subspace and b.centroid = e.code group by all),
    x as (select ab / (sqrt(aa) * sqrt(bb)) as c, (aa + bb - 2 * ab) / 64 as e from er)
    select count(*) as n, round(avg(e), 6) as mse, round(avg(c), 6) as cos_mean, round(quantile_cont(c, 0.1), 6) as cos_p10, round(quantile_cont(c, 0.5), 6) as cos_p50, round(quantile_cont(c, 0.9), 6) as cos_p90, 32.0::double as compression from x""",
)
def pq_reconstruction(spark, folder):
    r = quantize.quality(base.points(spark, folder), base.codebook(spark, folder), SPEC)
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("mse", "cos_mean", "cos_p10", "cos_p50", "cos_p90")], "compression")


NEAR_PROBE = """, np as (select n.doc_id as query_id, n.point_idx as qi, n.s as subspace, b.centroid, row_number() over (partition by n.doc_id, n.point_idx, n.s
  order by list_sum(list_transform(range(1, 9), lambda i: (n.v[i] - b.cv[i]) * (n.v[i] - b.cv[i]))), b.centroid) as r from sn n join book b on n.s = b.subspace where n.doc_id % 20 = 0),
  hits as (select query_id, e.doc_id, count(*) as hits from np join enc e on np.subspace = e.subspace and np.centroid = e.code where r <= {probes} group by all)"""


@query("pq_posting_hits", "with " + SUB + BOOK + NEAR_PROBE.format(probes=2) + " select query_id, doc_id, hits from hits")
def pq_posting_hits(spark, folder):
    book = base.codebook(spark, folder)
    return quantize.posting_hits(base.query_points(spark, folder), quantize.postings(base.points(spark, folder), book, SPEC), book, SPEC, 2)


ADC = """, tab as (select n.doc_id as query_id, n.point_idx as qi, n.s, b.centroid as code, greatest(0.0, case when n.n * b.cn < 1e-16 then 1.0 else 1 - list_dot_product(n.v, b.cv) / (n.n * b.cn + 1e-8) end) as dist
  from sn n join book b on n.s = b.subspace where n.doc_id % 20 = 0), adc as (select t.query_id, t.qi, e.doc_id, e.point_idx as di, t.s, t.dist from tab t join enc e on e.subspace = t.s and e.code = t.code)"""


@query("pq_lookup_chamfer", "with " + SUB + BOOK + ADC + chamfer_sql("dist", "adc") + top_sql("value", "cham", K))
def pq_lookup_chamfer(spark, folder):
    book = base.codebook(spark, folder)
    codes = quantize.encode(base.points(spark, folder), book, SPEC)
    values = quantize.lookup_chamfer(base.query_points(spark, folder), codes, book, SPEC)
    return scan.top_k(values, K).select("query_id", "doc_id", _r(F.col("value"), "score"), "rank")


@query(
    "pq_hamming",
    "with " + SUB + BOOK + """ select query_id, doc_id, round(avg(m), 6) + 0.0 as score from (select a.doc_id as query_id, a.point_idx as qi, b.doc_id, min(d) as m from (
      select a.doc_id, a.point_idx, b.doc_id as bd, b.point_idx as bp, sum(case when a.code <> b.code then 1 else 0 end) as d from enc a join enc b on a.subspace = b.subspace where a.doc_id % 20 = 0 group by all) a(doc_id, point_idx, bd, bp, d), (select distinct doc_id from enc) b where a.bd = b.doc_id group by all) group by all""",
)
def pq_hamming(spark, folder):
    """Mean over query points of the least number of differing codes."""
    book = base.codebook(spark, folder)
    words = quantize.packed_codes(quantize.encode(base.points(spark, folder), book, SPEC)).withColumnRenamed("codes", "vec")
    every = clouds.nested(words.withColumn("vec", F.col("vec").cast("array<double>")))
    hits = scan.scan(every.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), every, "code_difference", SPEC)
    return hits.select("query_id", "doc_id", (F.round("value", 6) + 0.0).alias("score"))


@query("pq_subspace_variance", "with " + PTS + " select cast(floor((i - 1) / 8) as int) as subspace, round(avg(v), 6) + 0.0 as variance from (select i, var_pop(vec[i]) as v from pts, range(1, 65) t(i) group by 1) group by 1")
def pq_subspace_variance(spark, folder):
    return quantize.subspace_variance(base.points(spark, folder), SPEC).select("subspace", _r(F.col("variance"), "variance"))


@query("pq_trained_codes")
def pq_trained_codes(spark, folder):
    """Codes under a codebook trained here."""
    p = base.points(spark, folder)
    return quantize.encode(p, quantize.train(p, SPEC, 16), SPEC)


@query(
    "token_variance",
    "with " + SUB + ", x as (select query_id, doc_id, di, max(m) as m from (select query_id, doc_id, qi, di, avg(1 - dist) as m from psd group by all) group by all) select query_id, doc_id, round(var_pop(m), 6) + 0.0 as variance from x group by all",
)
def token_variance(spark, folder):
    """Variance over a document's points of their best mean subspace cosine with the query."""
    q = quantize.sub_rows(base.query_points(spark, folder), SPEC).select(F.col("doc_id").alias("query_id"), F.col("point_idx").alias("qi"), "subspace", F.col("sv").alias("a"))
    d = quantize.sub_rows(base.points(spark, folder), SPEC)
    x = d.join(q, "subspace").groupBy("query_id", "doc_id", "qi", "point_idx").agg(F.avg(1 - V.kernel_distance(F.col("a"), F.col("sv"), V.PLAIN)).alias("m"))
    return x.groupBy("query_id", "doc_id", "point_idx").agg(F.max("m").alias("m")).groupBy("query_id", "doc_id").agg(_r(F.var_pop("m"), "variance"))
