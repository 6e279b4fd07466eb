"""Lexical retrieval and text helpers, in built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower case, parted by whatever is no Latin letter, digit or CJK ideograph; terms of two or more characters."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9一-鿿]+"), lambda t: F.length(t) > 1)


def query_terms(text: Column) -> Column:
    """Distinct terms, any of which may match."""
    return F.array_distinct(terms(text))


def quoted_query(text: Column) -> Column:
    """The query string of a full-text index: quoted terms joined by OR."""
    return F.array_join(F.transform(query_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def word_count(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "\\s+"))).cast("bigint")


def sentences(text: Column, shortest: int = 15, most: int = 20, fallback: int = 500) -> Column:
    """Split behind . ! ? and white space; sentences of at least ``shortest`` characters,
    the first ``most``; if none is left the first ``fallback`` characters."""
    parts = F.slice(F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= shortest), 1, most)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.substring(text, 1, fallback)))


def cjk_sentences(text: Column, longer_than: int = 5) -> Column:
    """Split at 。 ； ; and line ends; parts longer than ``longer_than``, else the whole text."""
    parts = F.filter(F.transform(F.split(text, "[。；;\\n]"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def titled(title: Column, text: Column, joint: str = ". ") -> Column:
    """Title, joint and text; either alone if the other is null or empty."""
    blank = lambda c: F.when(F.length(c) > 0, c)
    return F.concat_ws(joint, blank(title), blank(text))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, term, tf`` and the document's ``len`` in terms."""
    rows = docs.select("doc_id", F.explode(F.transform(F.array(terms(F.col(text))), lambda t: F.struct(F.size(t).alias("len"), t.alias("t")))).alias("x"))
    return rows.select("doc_id", F.col("x.len").alias("len"), F.explode("x.t").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))


#: Different terms that one pass over the documents asks for, and queries it scores.
TERM_BLOCK, QUERY_BLOCK = 4096, 1024


def asked_documents(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """``doc_id, len, kept``: the document's length in terms and those of its terms that are
    ``wanted``, as often as they stand there. Nothing is shuffled."""
    both = F.transform(F.array(terms(F.col("text"))), lambda t: F.struct(F.greatest(F.size(t), F.lit(0)).cast("bigint").alias("len"), F.filter(t, lambda x: x.isin(wanted)).alias("kept")))
    return docs.select("doc_id", F.element_at(both, 1).alias("x")).select("doc_id", F.coalesce("x.len", F.lit(0)).cast("bigint").alias("len"), F.coalesce("x.kept", F.array()).alias("kept"))


def _query_blocks(asked: DataFrame) -> Iterator[dict[int, dict[str, int]]]:
    """Queries with their terms and how often each is given, in blocks of bounded size."""
    block: dict[int, dict[str, int]] = {}
    seen: set[str] = set()
    rows = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "times")).alias("t"))
    for row in rows.toLocalIterator(prefetchPartitions=True):
        mine = {t.term: int(t.times) for t in row.t}
        if block and (len(seen | mine.keys()) > TERM_BLOCK or len(block) >= QUERY_BLOCK):
            yield block
            block, seen = {}, set()
        block[row.query_id] = mine
        seen |= mine.keys()
    if block:
        yield block


def _score_block(kept: DataFrame, ids: list[int], wanted: list[str], weights: np.ndarray, avgdl: float, k: int, k1: float, b: float) -> DataFrame:
    """The k best documents of each query of a block; ``weights`` are terms x queries, idf
    and number of times in one. A task keeps k rows a query."""
    place, kind = {t: i for i, t in enumerate(wanted)}, dict(kept.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, object)) for _ in ids]
        for batch in batches:
            docs, lens = np.asarray(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = np.fromiter((place[t] for t in lists.flatten().to_pylist()), np.int64)
            row = np.repeat(np.arange(len(docs)), sizes)
            for at in range(0, len(docs), 512):
                inside = (row >= at) & (row < at + 512)
                n = min(512, len(docs) - at)
                tf = np.bincount((row[inside] - at) * len(wanted) + flat[inside], minlength=n * len(wanted)).reshape(n, -1).astype(float)
                norm = k1 * (1 - b + b * lens[at : at + n] / avgdl)
                scores = (tf * (k1 + 1) / (tf + norm[:, None])) @ weights
                least = np.array([s[-1] - 2e-9 if len(s) == k else 0.0 for s, _ in best])
                for j in np.flatnonzero((scores > least).any(axis=0)):
                    hit = np.flatnonzero(scores[:, j] > least[j])
                    s, i = np.concatenate([best[j][0], scores[hit, j]]), np.concatenate([best[j][1], docs[at + hit]])
                    order = np.lexsort((i, -np.round(s, 9)))[:k]
                    best[j] = s[order], i[order]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.asarray(ids, np.int64), [len(s) for s, _ in best])),
                pa.array(np.concatenate([i for _, i in best]).tolist(), {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]),
                pa.array(np.concatenate([s for s, _ in best])),
            ],
            names=["query_id", "doc_id", "score"],
        )

    return kept.where(F.size("kept") > 0).mapInArrow(run, f"query_id bigint, doc_id {kind}, score double")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, pool: DataFrame | None = None, distinct_terms: bool = True) -> DataFrame:
    """``query_id, doc_id, score, rank``. idf = ln((N - df + .5) / (df + .5) + 1).

    Without ``pool`` N, df and the mean length are those of all documents: queries go in
    blocks of bounded size, the documents' terms are filtered by the block's in the scan
    and scored where they lie, and a task sends on k rows a query. With ``pool``
    (``query_id, doc_id`` candidates) the statistics are those of each query's pool, and a
    query term counts as often as it is given unless ``distinct_terms``. Documents without
    a query term have no row; null and empty texts are documents of length 0.
    """
    from vectide.shared import spread, stored

    asked = queries.select("query_id", F.explode(query_terms(F.col("text")) if distinct_terms else terms(F.col("text"))).alias("term"))
    asked = asked.where("query_id is not null").groupBy("query_id", "term").agg(F.count("*").alias("times"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    if pool is not None:
        tf = term_counts(docs.join(pool.select("doc_id").distinct(), "doc_id", "left_semi"))
        cand = pool.select("query_id", "doc_id").distinct()
        lengths = tf.groupBy("doc_id").agg(F.first("len").alias("len"))
        stats = cand.join(lengths, "doc_id", "left").groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.coalesce("len", F.lit(0))).alias("avgdl"))
        postings = cand.join(tf, "doc_id").join(asked, ["query_id", "term"])
        df = postings.groupBy("query_id", "term").agg(F.count("*").alias("df"))
        rows = postings.join(df, ["query_id", "term"]).join(stats, "query_id")
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
        scores = rows.groupBy("query_id", "doc_id").agg(F.sum(idf * norm * F.col("times")).alias("score"))
        return scores.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
    parts, docs = None, spread(docs.select("doc_id", "text"))
    for block in _query_blocks(asked):
        ids, wanted = list(block), sorted({t for terms_ in block.values() for t in terms_})
        kept = stored(asked_documents(docs, wanted), "asked-terms")
        n, total = kept.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        counts = kept.select(F.explode(F.array_distinct("kept")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        df = {r.term: r.df for r in counts.toLocalIterator()}  # at most TERM_BLOCK rows
        place = {t: i for i, t in enumerate(wanted)}
        weights = np.zeros((len(wanted), len(ids)))
        for j, q in enumerate(ids):
            for t, times in block[q].items():
                f = df.get(t, 0)
                weights[place[t], j] = times * np.log((n - f + 0.5) / (f + 0.5) + 1)
        one = _score_block(kept, ids, wanted, weights, total / n if total else 1.0, k, k1, b)
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return docs.select(F.lit(0).cast("bigint").alias("query_id"), "doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank")).where("false")
    return parts.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def parse_listwise(answer: Column, n: Column | int) -> Column:
    """Order of 1..n from a judge's free text: numbers in order of mention, without
    repeats and those out of range, then the missing ones ascending."""
    n = n if isinstance(n, Column) else F.lit(n)
    every = F.sequence(F.lit(1), n.cast("int"))
    said = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(answer, F.lit("(\\d{1,9})"), 1), lambda s: s.cast("int")), lambda i: (i >= 1) & (i <= n)))
    return F.concat(said, F.array_except(every, said))


def pair_wins(items: DataFrame, judgements: DataFrame, budget: int | None = None) -> DataFrame:
    """``query_id, doc_id, wins``: a win counts 1, a failed (null) judgement a half for
    each. ``judgements`` are (query_id, a, b, winner); of each query the first
    ``budget`` pairs by (a, b) count, the number of calls that a judge may get."""
    rows = judgements
    if budget is not None:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("a", "b"))).where(F.col("r") <= budget)
    share = lambda side: F.when(F.col("winner").isNull(), 0.5).when(F.col("winner") == F.col(side), 1.0).otherwise(0.0)
    got = rows.select("query_id", F.explode(F.array(F.struct(F.col("a").alias("doc_id"), share("a").alias("w")), F.struct(F.col("b").alias("doc_id"), share("b").alias("w")))).alias("x"))
    won = got.groupBy("query_id", F.col("x.doc_id").alias("doc_id")).agg(F.sum("x.w").alias("wins"))
    return items.select("query_id", "doc_id").distinct().join(won, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("wins", F.lit(0.0)).alias("wins"))


def set_windows(ranked: DataFrame, size: int = 4, step: int = 2) -> DataFrame:
    """``query_id, window, doc_id, rank``: overlapping windows over ranks from 1."""
    last = F.floor((F.col("rank") - 1) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("rank") - size) / step))
    return ranked.select("query_id", F.explode(F.sequence(first, last)).alias("window"), "doc_id", "rank").where(F.col("rank") <= F.col("window") * step + size)


def set_scores(windows: DataFrame, choices: DataFrame) -> DataFrame:
    """Per window 1 for the first choice and 0.5 for the second, less 0.001 a rank for ties."""
    rows = windows.join(choices, ["query_id", "window"], "left")
    won = F.when(F.col("doc_id") == F.col("first"), 1.0).when(F.col("doc_id") == F.col("second"), 0.5).otherwise(0.0)
    return rows.groupBy("query_id", "doc_id").agg((F.sum(won) - 0.001 * F.min("rank")).alias("score"))


def parse_verdict(answer: Column) -> Column:
    """``first``, ``second`` (scores out of 1 to 5, null if not given) and ``winner`` (1, 2, 0
    for a tie) from a judge's free text with lines such as "first: 4/5" and "winner: second"."""
    low = F.lower(answer)

    def found(pattern: str) -> Column:
        hit = F.regexp_extract(low, pattern, 1)
        return F.when(hit != "", hit)

    winner = found(r"winner\s*[:：]*\s*(first|second|tie)")
    score = lambda side: found(side + r"\s*[:：]+\s*([1-5])\s*[/／]\s*5").cast("int")
    return F.struct(score("first").alias("first"), score("second").alias("second"), F.when(winner == "first", 1).when(winner == "second", 2).when(winner == "tie", 0).alias("winner"))
