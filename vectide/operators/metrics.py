"""Ranking metrics and rank correlations. Runs are ``query_id, doc_id, score``;
judgements are ``query_id, doc_id, rel``. Ties rank by doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(run: DataFrame, k: int | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    r = run.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")))
    return r if k is None else r.where(F.col("rank") <= k)


def _gain(exponential: bool):
    return (F.pow(F.lit(2.0), F.col("rel")) - 1) if exponential else F.col("rel").cast("double")


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10, exponential: bool = True, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``keys, ndcg``: the ideal order is that of the judgements; 0 where they hold no gain."""
    discount = F.log2(F.col("rank") + 1)
    dcg = ranked(run, k, keys).join(qrels, ["query_id", "doc_id"]).groupBy(*keys).agg(F.sum(_gain(exponential) / discount).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = qrels.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(_gain(exponential) / discount).alias("idcg"))
    every = run.select(*keys).distinct().join(ideal, "query_id", "left").join(dcg, list(keys), "left")
    return every.select(*keys, F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def ndcg_binary_retrieved(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Binary gain; the ideal puts the relevant documents among the retrieved first."""
    top = ranked(run, k).join(qrels, ["query_id", "doc_id"], "left").withColumn("hit", (F.coalesce("rel", F.lit(0)) > 0).cast("int"))
    agg = top.groupBy("query_id").agg(F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("hit").alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("hits").cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return agg.select("query_id", F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def reciprocal_rank(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    first = ranked(run, k).join(qrels.where("rel > 0"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    return run.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("mrr"))


def recall(run: DataFrame, qrels: DataFrame, k: int = 10, only_relevant: bool = True, empty: float = 0.0) -> DataFrame:
    """Share of judged (or only of relevant) documents within the first k; ``empty`` where there are none."""
    judged = qrels.where("rel > 0") if only_relevant else qrels
    found = ranked(run, k).join(judged, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("found"))
    total = judged.groupBy("query_id").agg(F.count("*").alias("total"))
    every = run.select("query_id").distinct().join(total, "query_id", "left").join(found, "query_id", "left")
    return every.select("query_id", F.when(F.col("total") > 0, F.coalesce("found", F.lit(0)) / F.col("total")).otherwise(F.lit(empty)).alias("recall"))


def kendall(a: DataFrame, b: DataFrame, ties: bool = True) -> DataFrame:
    """``query_id, tau`` over common documents. With ``ties`` tau-b (pairs tied in both
    skipped); else (concordant - discordant) / all pairs. Null where undefined."""
    both = a.select("query_id", "doc_id", F.col("score").alias("x")).join(b.select("query_id", "doc_id", F.col("score").alias("y")), ["query_id", "doc_id"])
    l, r = both.alias("l"), both.alias("r")
    pairs = l.join(r, F.expr("l.query_id = r.query_id and l.doc_id < r.doc_id")).select(
        F.col("l.query_id").alias("query_id"), F.signum(F.col("l.x") - F.col("r.x")).alias("dx"), F.signum(F.col("l.y") - F.col("r.y")).alias("dy")
    )
    p = F.col("dx") * F.col("dy")
    s = lambda cond: F.sum(cond.cast("long"))
    c = pairs.groupBy("query_id").agg(
        s(p > 0).alias("c"), s(p < 0).alias("d"), s((F.col("dx") == 0) & (F.col("dy") != 0)).alias("tx"), s((F.col("dy") == 0) & (F.col("dx") != 0)).alias("ty"), F.count("*").alias("n")
    )
    if ties:
        under = F.sqrt((F.col("c") + F.col("d") + F.col("tx")).cast("double") * (F.col("c") + F.col("d") + F.col("ty")).cast("double"))
    else:
        under = F.col("n").cast("double")
    return c.select("query_id", F.when(under > 0, (F.col("c") - F.col("d")) / under).alias("tau"))


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """``query_id, rho`` of ordinal ranks over common documents (ties by doc_id)."""
    both = a.select("query_id", "doc_id", F.col("score").alias("x")).join(b.select("query_id", "doc_id", F.col("score").alias("y")), ["query_id", "doc_id"])
    w = Window.partitionBy("query_id")
    both = both.withColumn("rx", F.row_number().over(w.orderBy(F.desc("x"), "doc_id"))).withColumn("ry", F.row_number().over(w.orderBy(F.desc("y"), "doc_id")))
    return both.groupBy("query_id").agg(F.corr("rx", "ry").alias("rho"))


def jaccard_at(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    x = ranked(a, k).select("query_id", "doc_id").withColumn("a", F.lit(1))
    y = ranked(b, k).select("query_id", "doc_id").withColumn("b", F.lit(1))
    both = x.join(y, ["query_id", "doc_id"], "full_outer").groupBy("query_id")
    return both.agg((F.sum(F.coalesce(F.col("a") * F.col("b"), F.lit(0))) / F.count("*")).alias("jaccard"))


def quadrants(a: DataFrame, b: DataFrame, value: str = "ndcg", threshold: float = 0.0) -> DataFrame:
    """One row: queries that both, only a, only b and neither score above the threshold."""
    both = a.select("query_id", F.col(value).alias("x")).join(b.select("query_id", F.col(value).alias("y")), "query_id")
    s = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    x, y = F.col("x") > threshold, F.col("y") > threshold
    return both.agg(s(x & y).alias("both"), s(x & ~y).alias("only_a"), s(~x & y).alias("only_b"), s(~x & ~y).alias("neither"))
