"""Queries pN_... of the training-data problems, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import clusters, knn, mixing, neardup, rankwalk, split, stuffing, tokens, topn

VALID_DISTANCE = "distance is not null and not isnan(distance) and distance >= 0 and distance <= 4"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# -- problem 1 ---------------------------------------------------------------
#: table: (id, vector, numbers, their type)
VECTORS = {
    "chunks": ("id", "vector", 64, "<f4"),
    "dense_vectors": ("id", "emb_fp16", 64, "<f2"),
    "late_vectors": ("id", "mean_emb", 32, "<f4"),
}


def _similar(spark: SparkSession, folder: str, min_sim: float | None) -> DataFrame:
    out = None
    for name, (key, vector, dim, dtype) in VECTORS.items():
        one = knn.most_similar(table(spark, folder, name), key, vector, dim, dtype, k=5, min_sim=min_sim).withColumn("vec_table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _similar(spark, folder, None)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _similar(spark, folder, 0.98)
    return pairs.select("vec_table", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


# -- problem 2 ---------------------------------------------------------------
DOC_LIMIT, CHUNK_LIMIT, OVERLAP = 1500, 400, 60


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = split.split_oversized(table(spark, folder, "doc_records"), "_id", "text", DOC_LIMIT, OVERLAP)
    chunks = split.split_oversized(table(spark, folder, "chunks"), "id", "chunk_text", CHUNK_LIMIT, OVERLAP)
    return docs.withColumn("item_table", F.lit("doc_records")).unionByName(chunks.withColumn("item_table", F.lit("chunks")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_pieces(spark, folder).where("piece = 0").select("item_table", "item_id", "cut_kind")


# -- problem 3 ---------------------------------------------------------------
def p3_top(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "scan_hits").where(VALID_DISTANCE)
    params = table(spark, folder, "cascade_params").select("params_id", "case_k")
    rows = hits.join(params, "params_id", "left").withColumn("n", F.coalesce("case_k", F.lit(5)))
    return topn.top_n_per_group(rows, "query_id", "doc_id", "distance", F.col("n"), default_n=5)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_top(spark, folder).select("query_id", "doc_id")


P3_SQL = """
with best as (
  select h.query_id, h.doc_id, min(cast(h.distance as double) + 0.0) as d, min(coalesce(p.case_k, 5)) as n
  from scan_hits h left join cascade_params p on h.params_id = p.params_id
  where h.distance is not null and not isnan(h.distance) and h.distance >= 0 and h.distance <= 4
  group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by d, doc_id) as r from best)
"""


# -- problem 4 ---------------------------------------------------------------
def p4_order(spark: SparkSession, folder: str) -> DataFrame:
    """One order of documents per query of ``search_results``; the damping is 1 / (rrf_k + 1)."""
    results = table(spark, folder, "search_results")
    hits = table(spark, folder, "scan_hits")
    params = table(spark, folder, "cascade_params").select("params_id", "rrf_k")
    asked = results.select("query_id").where("query_id is not null").distinct()
    # a smaller fts5 score is better
    lists = results.select("query_id", "channel", F.col("id").alias("doc_id"), F.when(F.col("channel") == "fts5", -F.col("score")).otherwise(F.col("score")).alias("value"))
    near = hits.where(VALID_DISTANCE).join(asked, "query_id", "left_semi")
    near = near.select("query_id", F.lit("distance").alias("channel"), "doc_id", (-F.col("distance").cast("double")).alias("value"))
    damping = hits.groupBy("query_id").agg(F.max("params_id").alias("params_id")).join(params, "params_id").select("query_id", "rrf_k")
    rows = lists.unionByName(near).groupBy("query_id", "channel", "doc_id").agg(F.max(F.when(~F.isnan("value"), F.col("value"))).alias("value"))
    rows = rows.join(damping, "query_id", "left")
    return rankwalk.combine_rankings(rows, "query_id", "channel", "doc_id", "value", "rrf_k")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """From the head of the chain's order, where every such document stands (see
    ``rankwalk``: rank at most 2 * lists + 1), those the exact check confirms."""
    head = p4_order(spark, folder).where("rank <= 2 * lists + 1")
    return head.where("in_lists = lists and worst_rank <= 3").select("query_id", "doc_id")


P4_SQL = """
with lists as (
  select query_id, channel, id as doc_id, max(case when channel = 'fts5' then -score else score end + 0.0) as v
  from search_results where score is not null and not isnan(score) and query_id is not null and channel is not null group by 1, 2, 3
  union all
  select query_id, 'distance', doc_id, max(-cast(distance as double) + 0.0) from scan_hits
  where distance is not null and not isnan(distance) and distance >= 0 and distance <= 4
    and query_id in (select query_id from search_results) group by 1, 2, 3),
ranked as (select *, row_number() over (partition by query_id, channel order by v desc, doc_id) as r from lists),
n as (select query_id, count(distinct channel) as lists from lists group by 1)
select r.query_id, r.doc_id from ranked r join n on r.query_id = n.query_id
group by r.query_id, r.doc_id, n.lists having count(*) = n.lists and max(r.r) <= 3
"""


# -- problem 5 ---------------------------------------------------------------
def _near_duplicates(spark: SparkSession, folder: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, folder, "doc_records"), "_id", ["title", "text"], threshold=0.7)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near_duplicates(spark, folder).pairs()


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _near_duplicates(spark, folder).groups()


# -- problem 6 ---------------------------------------------------------------
def _chunk_clusters(spark: SparkSession, folder: str) -> clusters.BisectingClusters:
    return clusters.BisectingClusters(table(spark, folder, "chunks"), "id", "vector", 64, min_cos=0.68)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    members = _chunk_clusters(spark, folder).members.withColumn("id", F.col("id").cast("bigint"))
    size = members.groupBy("cluster").agg(F.min("id").alias("first_id"), F.count("*").alias("size")).where("size >= 3")
    return members.join(size, "cluster").select("first_id", "id")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters with size, most typical chunks and the error of the stored codebook on them."""
    made = _chunk_clusters(spark, folder)
    return made.report(3)


def p6_codebook(spark: SparkSession, folder: str) -> DataFrame:
    """Per cluster the mean similarity of its chunks with their rebuilding from the
    stored codebook, beside that with the cluster's typical chunk."""
    made = _chunk_clusters(spark, folder)
    # a fixed table of 256 rows
    book = [(r.subspace, r.centroid, bytes(r.vector)) for r in table(spark, folder, "codebook").where("vector is not null").orderBy("subspace", "centroid").collect()]
    rebuilt = clusters.codebook_similarity(made.vecs, book, 64)
    return (
        made.members.join(rebuilt, "id")
        .groupBy("cluster")
        .agg(F.count("*").alias("size"), F.avg("to_typical").alias("to_typical"), F.avg("to_codebook").alias("to_codebook"))
    )


# -- problem 7 ---------------------------------------------------------------
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


# -- problem 8 ---------------------------------------------------------------
def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).report()


def p8_copies(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).copies.withColumnRenamed("id", "doc_id")


# -- problem 9 ---------------------------------------------------------------
def p9_pages(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, folder, "documents"), "doc_id", "text", "portal", "lang").withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_pages(spark, folder).where("stuffed").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_top": p3_top,
    "p4_found": p4_found,
    "p4_order": p4_order,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_codebook": p6_codebook,
    "p7_ids": p7_ids,
    "p8_copies": p8_copies,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_pages": p9_pages,
}

ORACLES: dict[str, str] = {
    "p4_found": P4_SQL,
    "p3_found": P3_SQL + "select query_id, doc_id from ranked where r <= n",
    "p3_top": P3_SQL + "select query_id, doc_id, d as distance, cast(r as int) as rank from ranked where r <= n",
}
