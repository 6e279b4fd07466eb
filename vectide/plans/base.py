"""Shapes derived from the test tables, as DataFrames and as the CTEs of the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.vectors import SubspaceSpec
from vectide.operators.clouds import nested
from vectide.operators.retrieval import Corpus, Prepared, prepare
from vectide.shared import is_there

SPEC = SubspaceSpec(8, 8)
POINTS_PER_CLOUD = 5
CENTROIDS = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def points(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / POINTS_PER_CLOUD).cast("bigint").alias("doc_id"), (F.col("vec_id") % POINTS_PER_CLOUD).cast("int").alias("point_idx"), F.col("embedding").cast("array<double>").alias("vec")
    )


def query_points(spark: SparkSession, folder: str) -> DataFrame:
    return points(spark, folder).where("doc_id % 20 = 0")


def corpus(spark: SparkSession, folder: str) -> Corpus:
    """All clouds; the stated query set is every cloud whose id is divisible by 20."""
    return Corpus(nested(points(spark, folder)), nested(query_points(spark, folder)).withColumnRenamed("doc_id", "query_id"), SPEC)


def codebook(spark: SparkSession, folder: str) -> DataFrame:
    """A given codebook: the sub-vectors of the first vectors, no training."""
    first = points(spark, folder).withColumn("centroid", (F.col("doc_id") * POINTS_PER_CLOUD + F.col("point_idx")).cast("int")).where(F.col("centroid") < CENTROIDS)
    from vectide.functions.vectors import sub_vectors

    return first.select("centroid", F.posexplode(sub_vectors(F.col("vec"), SPEC)).alias("subspace", "vec"))


_PREPARED: dict[tuple[str, str], tuple[Corpus, Prepared]] = {}


def prepared(spark: SparkSession, folder: str) -> tuple[Corpus, Prepared]:
    """The corpus of a folder and what it is prepared with: written at the first call of a
    session, read by all later ones, as an index is."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _PREPARED or not (is_there(_PREPARED[key][1].codes) and is_there(_PREPARED[key][1].counts)):
        c = corpus(spark, folder)
        _PREPARED[key] = c, prepare(c, codebook(spark, folder))
    return _PREPARED[key]


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements: clouds whose first points carry the same label."""
    e = table(spark, folder, "embeddings").where(F.col("vec_id") % POINTS_PER_CLOUD == 0).select(F.floor(F.col("vec_id") / POINTS_PER_CLOUD).cast("bigint").alias("doc_id"), "label")
    q = e.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "label")
    return q.join(e, "label").select("query_id", "doc_id", F.lit(1).alias("rel"))


PTS = """
pts as (select cast(floor(vec_id / 5) as bigint) as doc_id, cast(vec_id % 5 as int) as point_idx, embedding::double[] as vec from embeddings),
q as (select doc_id as query_id, point_idx as qi, vec as qv from pts where doc_id % 20 = 0),
d as (select doc_id, point_idx as di, vec as dv from pts),
cent as (select doc_id, list(m order by i) as c from (select doc_id, i, avg(vec[i]) as m from pts, range(1, 65) t(i) group by 1, 2) group by 1)
"""

#: Subspace distances of every query point and document point, plain kernel.
SUB = (
    PTS
    + """,
subs as (select doc_id, point_idx, s, vec[8 * s + 1 : 8 * s + 8] as v from pts, range(0, 8) t(s)),
sn as (select *, sqrt(list_dot_product(v, v)) as n from subs),
psd as (select a.doc_id as query_id, a.point_idx as qi, b.doc_id, b.point_idx as di, a.s,
  case when a.n * b.n < 1e-16 then 1.0 else 1.0 - list_dot_product(a.v, b.v) / (a.n * b.n + 1e-8) end as dist,
  case when a.n < 1e-9 or b.n < 1e-9 then 1.0 else greatest(0.0, 1.0 - list_dot_product(a.v, b.v) / (a.n * b.n)) end as cdist,
  case when a.n < 1e-12 or b.n < 1e-12 then 1.0 else 1.0 - greatest(-1.0, least(1.0, list_dot_product(a.v, b.v) / (a.n * b.n))) end as sdist
  from sn a join sn b on a.s = b.s where a.doc_id % 20 = 0)
"""
)
BOOK = """,
book as (select cast(doc_id * 5 + point_idx as int) as centroid, s as subspace, v as cv, n as cn from sn where doc_id * 5 + point_idx < 16),
enc as (select doc_id, point_idx, s as subspace, centroid as code from (
  select n.doc_id, n.point_idx, n.s, b.centroid, row_number() over (partition by n.doc_id, n.point_idx, n.s
    order by list_sum(list_transform(range(1, 9), lambda i: (n.v[i] - b.cv[i]) * (n.v[i] - b.cv[i]))), b.centroid) as r
  from sn n join book b on n.s = b.subspace) where r = 1)
"""


def chamfer_sql(dist: str = "dist", src: str = "psd", subspace_first: bool = True) -> str:
    """CTE ``cham(query_id, doc_id, value)``."""
    if subspace_first:
        return f""",
t1 as (select query_id, doc_id, s, avg(m) as x from (select query_id, doc_id, s, qi, min({dist}) as m from {src} group by all) group by all),
t2 as (select query_id, doc_id, s, avg(m) as y from (select query_id, doc_id, s, di, min({dist}) as m from {src} group by all) group by all),
cham as (select t1.query_id, t1.doc_id, avg(x + y) as value from t1 join t2 using (query_id, doc_id, s) group by all)"""
    return f""",
pp as (select query_id, doc_id, qi, di, avg({dist}) as d from {src} group by all),
t1 as (select query_id, doc_id, avg(m) as x from (select query_id, doc_id, qi, min(d) as m from pp group by all) group by all),
t2 as (select query_id, doc_id, avg(m) as y from (select query_id, doc_id, di, min(d) as m from pp group by all) group by all),
cham as (select t1.query_id, t1.doc_id, x + y as value from t1 join t2 using (query_id, doc_id))"""


def top_sql(value: str, source: str, k: int, asc: bool = True, out: str = "value") -> str:
    order = value if asc else f"{value} desc"
    return f"""
select query_id, doc_id, round({out}, 6) + 0.0 as score, rank from (
  select *, row_number() over (partition by query_id order by {order}, doc_id) as rank from {source}) where rank <= {k}"""
