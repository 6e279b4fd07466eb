"""Interfaces to outside models: judges, cross-encoders and encoders are functions that
the caller passes in. They get batches in Python workers; none is called here."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vectide.operators.scan import top_k


def rerank_listwise(cands: DataFrame, judge: Callable[[str, list[str]], str], k: int) -> DataFrame:
    """``cands`` (query_id, query, doc_id, text, rank): the judge gets query and texts in
    order and answers in free text; unnamed documents follow in order. A failing
    judge leaves the order as it was."""
    from vectide.operators.text import parse_listwise

    kind = dict(cands.dtypes)["doc_id"]

    def ask(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank")
        try:
            answer = judge(f["query"].iloc[0], f["text"].tolist())
        except Exception:
            answer = ""
        return pd.DataFrame({"query_id": [f.query_id.iloc[0]], "answer": [answer], "ids": [f.doc_id.tolist()]})

    said = cands.groupBy("query_id").applyInPandas(ask, f"query_id bigint, answer string, ids array<{kind}>")
    order = said.select("query_id", "ids", F.posexplode(parse_listwise(F.col("answer"), F.size("ids"))).alias("p", "i"))
    return order.select("query_id", F.get("ids", F.col("i") - 1).alias("doc_id"), (F.col("p") + 1).cast("bigint").alias("rank")).where(F.col("rank") <= k)


def score_pairs(pairs: DataFrame, score: Callable[[list[str], list[str]], list[float]], batch: int = 64) -> DataFrame:
    """Cross-encoder: ``query_id, doc_id, score`` of (query_id, doc_id, query, text); a
    failing batch gives null scores."""
    kind = dict(pairs.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got: list[float | None] = []
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                try:
                    got += list(score(part["query"].tolist(), part["text"].tolist()))
                except Exception:
                    got += [None] * len(part)
            yield pd.DataFrame({"query_id": f.query_id, "doc_id": f.doc_id, "score": pd.array(got, dtype="Float64").to_numpy(dtype=float, na_value=float("nan"))})

    return pairs.select("query_id", "doc_id", "query", "text").mapInPandas(run, f"query_id bigint, doc_id {kind}, score double")


def rerank_scored(pairs: DataFrame, score: Callable, k: int) -> DataFrame:
    """Cross-encoder order; queries of which a score failed keep their given order (``rank``)."""
    scored = score_pairs(pairs, score).join(pairs.select("query_id", "doc_id", F.col("rank").alias("given")), ["query_id", "doc_id"])
    bad = scored.where(F.isnan("score") | F.col("score").isNull()).select("query_id").distinct().withColumn("bad", F.lit(True))
    use = scored.join(bad, "query_id", "left").withColumn("score", F.when(F.col("bad"), -F.col("given").cast("double")).otherwise(F.col("score")))
    return top_k(use.select("query_id", "doc_id", "score"), k, "score", ascending=False)


def encode_texts(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 32, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """``key, vec``: an encoder is called with batches that are halved when it fails; a
    single text that fails ``tries`` times gives null."""
    kind = dict(df.dtypes)[key]

    def one(texts: list[str]) -> list:
        for t in range(tries):
            try:
                return list(encode(texts))
            except Exception:
                if len(texts) > 1:
                    half = len(texts) // 2
                    return one(texts[:half]) + one(texts[half:])
                time.sleep(wait * 2**t)
        return [None] * len(texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["t"].fillna("").tolist()
            out = [v for a in range(0, len(texts), batch) for v in one(texts[a : a + batch])]
            yield pd.DataFrame({key: f[key], "vec": out})

    return df.select(key, F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, vec array<double>")


def blind_verdicts(pairs: DataFrame, judge: Callable[[str, str, str], str], seed: int = 0) -> DataFrame:
    """A judge that does not know which side is which: ``query_id, score_a, score_b, winner``
    of (query_id, query, a, b), where a and b are the texts of two result lists.

    Which side comes first is drawn by a hash of query and seed. The judge gets query, first
    and second and answers in free text, read by ``text.parse_verdict``; a failing judge gives
    nulls. ``winner`` is ``a``, ``b`` or ``tie``."""
    from vectide.operators.text import parse_verdict

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = []
            for query, first, second in zip(f["query"], f["first"], f["second"]):
                try:
                    said.append(judge(query, first, second))
                except Exception:
                    said.append(None)
            yield pd.DataFrame({"query_id": f.query_id, "swapped": f.swapped, "answer": said})

    swapped = F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(2)) == 1
    rows = pairs.select("query_id", "query", swapped.alias("swapped"), F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("first"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("second"))
    said = rows.mapInPandas(run, "query_id bigint, swapped boolean, answer string").withColumn("v", parse_verdict(F.col("answer")))
    swap = lambda x, y: F.when(F.col("swapped"), F.col(y)).otherwise(F.col(x))
    winner = F.when(F.col("v.winner") == 0, "tie").when((F.col("v.winner") == 1) != F.col("swapped"), "a").when(F.col("v.winner").isNotNull(), "b")
    return said.select("query_id", swap("v.first", "v.second").alias("score_a"), swap("v.second", "v.first").alias("score_b"), winner.alias("winner"))


def truncated(df: DataFrame, text: str, budget: int, count: Callable[[list[str]], list[int]]) -> DataFrame:
    """Adds ``truncated``: the longest prefix of the text of at most ``budget`` tokens.

    ``count`` gives the tokens of a batch of texts; prefixes are bisected, all texts of a
    batch at once, so it is called about log2(length) times a batch. Tokens must not
    decrease as a prefix grows. Null stays null."""
    schema = StructType([*df.schema.fields, StructField("truncated", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f[text].tolist()
            low, high = [0] * len(texts), [len(t) if t else 0 for t in texts]
            for i, n in zip(ask := [i for i, t in enumerate(texts) if t], count([texts[i] for i in ask]) if ask else []):
                low[i] = high[i] if n <= budget else 0
            while todo := [i for i in range(len(texts)) if low[i] < high[i]]:
                middle = [(low[i] + high[i] + 1) // 2 for i in todo]
                for i, m, n in zip(todo, middle, count([texts[i][:m] for i, m in zip(todo, middle)])):
                    if n <= budget:
                        low[i] = m
                    else:
                        high[i] = m - 1
            yield f.assign(truncated=[None if t is None else t[:n] for t, n in zip(texts, low)])

    return df.mapInPandas(run, schema)
