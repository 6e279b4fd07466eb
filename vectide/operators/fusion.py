"""Fusing ranked lists. Lists are rows ``query_id, probe, doc_id, score``; ties are
broken by doc_id; null and NaN scores drop out; a document given twice in a list
counts with its best score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.vectors import min_max


def _clean(lists: DataFrame) -> DataFrame:
    rows = lists.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return rows.groupBy("query_id", "probe", "doc_id").agg(F.max("score").alias("score"))


def ranks(lists: DataFrame, base: int = 1) -> DataFrame:
    w = Window.partitionBy("query_id", "probe").orderBy(F.desc("score"), "doc_id")
    return _clean(lists).withColumn("r", F.row_number().over(w) - 1 + base)


def reciprocal_rank(lists: DataFrame, k: float = 60.0, base: int = 1, weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of weight / (k + rank). ``base`` is the first rank: 0 for merged probes, 1 for weighted lists."""
    weight: Column = F.lit(1.0)
    if weights:
        items = [x for p, v in weights.items() for x in (F.lit(p), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*items)[F.col("probe")], F.lit(1.0))
    return ranks(lists, base).groupBy("query_id", "doc_id").agg(F.sum(weight / (k + F.col("r"))).alias("score"))


def normalised(lists: DataFrame, flat: float | None = 0.5, flat_below: float = 1e-8) -> DataFrame:
    w = Window.partitionBy("query_id", "probe")
    return _clean(lists).withColumn("score", min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w), flat, flat_below))


def max_score(lists: DataFrame) -> DataFrame:
    return normalised(lists).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def hit_max(lists: DataFrame) -> DataFrame:
    """Number of lists times the largest normalised score."""
    return normalised(lists).groupBy("query_id", "doc_id").agg((F.count("*") * F.max("score")).alias("score"))


def weighted_pair(first: DataFrame, second: DataFrame, lam: float | Column) -> DataFrame:
    """lam * first + (1 - lam) * second of min-max normalised scores; a missing one is 0."""
    a = normalised(first.withColumn("probe", F.lit("a")), None, 1e-8).select("query_id", "doc_id", F.col("score").alias("a"))
    b = normalised(second.withColumn("probe", F.lit("b")), None, 1e-8).select("query_id", "doc_id", F.col("score").alias("b"))
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", (lam * F.coalesce("a", F.lit(0.0)) + (1 - lam) * F.coalesce("b", F.lit(0.0))).alias("score"))


def lambda_sweep(first: DataFrame, second: DataFrame, grid: list[float]) -> DataFrame:
    """``lam, query_id, doc_id, score`` for every lambda of a short grid, from one join."""
    a = normalised(first.withColumn("probe", F.lit("a")), None, 1e-8).select("query_id", "doc_id", F.col("score").alias("a"))
    b = normalised(second.withColumn("probe", F.lit("b")), None, 1e-8).select("query_id", "doc_id", F.col("score").alias("b"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("lam", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return both.select("lam", "query_id", "doc_id", (F.col("lam") * F.coalesce("a", F.lit(0.0)) + (1 - F.col("lam")) * F.coalesce("b", F.lit(0.0))).alias("score"))


def rank_normalised(scores: DataFrame) -> DataFrame:
    """1 - (rank - 1) / max(n - 1, 1) by falling score."""
    w = Window.partitionBy("query_id")
    r = F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))
    return scores.select("query_id", "doc_id", (1 - (r - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))).alias("score"))


def softmax_allocation(sims: DataFrame, total: int, temperature: float = 1.0) -> DataFrame:
    """``query_id, index_name, k``: shares of ``total`` by a softmax of ``sim``, rounded
    half up and at least 1; an excess is taken from the largest (of equals the last
    by name) if that is larger than the excess."""
    w = Window.partitionBy("query_id")
    e = F.exp((F.col("sim") - F.max("sim").over(w)) / temperature)
    rows = sims.withColumn("e", e).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("e") / F.sum("e").over(w) * total + 0.5)).cast("bigint"))
    rows = rows.withColumn("excess", F.sum("k").over(w) - total).withColumn("place", F.row_number().over(w.orderBy(F.desc("k"), F.desc("index_name"))))
    cut = (F.col("place") == 1) & (F.col("excess") > 0) & (F.col("k") > F.col("excess"))
    return rows.select("query_id", "index_name", F.when(cut, F.col("k") - F.col("excess")).otherwise(F.col("k")).alias("k"))
