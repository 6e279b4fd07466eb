"""Queries on texts: terms, BM25, hybrid pools, parsing of judges' answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.operators import scan, text
from vectide.plans import base

QUERIES, ORACLES = {}, {}
_TERMS = """terms as (select doc_id, list_filter(string_split_regex(regexp_replace(lower(replace(text, 'İ', 'I' || chr(775))), '[^a-z0-9一-鿿]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1) as t from documents)"""


def _q(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _r(c, name):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


@_q("text_terms", f"with {_TERMS} select doc_id, coalesce(len(t), 0)::bigint as n, coalesce(len(list_distinct(t)), 0)::bigint as distinct_terms from terms")
def text_terms(spark, folder):
    d = base.table(spark, folder, "documents").select("doc_id", text.terms(F.col("text")).alias("t"))
    return d.select("doc_id", F.when(F.col("t").isNotNull(), F.size("t")).otherwise(0).cast("bigint").alias("n"), F.when(F.col("t").isNotNull(), F.size(F.array_distinct("t"))).otherwise(0).cast("bigint").alias("distinct_terms"))


@_q("term_counts", f"with {_TERMS}, x as (select doc_id, unnest(t) as term from terms) select doc_id, term, count(*) as tf from x group by all")
def term_counts(spark, folder):
    return text.term_counts(base.table(spark, folder, "documents")).select("doc_id", "term", "tf")


@_q("text_titled", "select _id, length(case when length(title) > 0 and length(text) > 0 then title || '. ' || text when length(title) > 0 then title when length(text) > 0 then text else '' end)::bigint as n from (select distinct _id, title, text from doc_records)")
def text_titled(spark, folder):
    d = base.table(spark, folder, "doc_records").select("_id", "title", "text").distinct()
    return d.select("_id", F.length(text.titled(F.col("title"), F.col("text"))).cast("bigint").alias("n"))


@_q(
    "text_sentences",
    """with d as (select doc_id, text, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 15)) as n,
    len(list_filter(list_transform(string_split_regex(text, '[。；;\\n]'), lambda s: trim(s)), lambda s: length(s) > 5)) as c, trim(text) as t from documents where text is not null)
  select doc_id, greatest(1, least(20, n))::int as sentences, greatest(1, c)::int as cjk_sentences, case when t = '' then 0 else len(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+')) end::bigint as words from d""",
)
def text_sentences(spark, folder):
    d = base.table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentences"), F.size(text.cjk_sentences(F.col("text"))).alias("cjk_sentences"), text.word_count(F.col("text")).alias("words"))


def _asked(spark, folder):
    """Every twentieth record's title asks."""
    d = base.table(spark, folder, "doc_records").select("_id", "title").distinct().withColumn("query_id", F.substring("_id", -8, 8).cast("bigint"))
    return d.where((F.col("query_id") % 20 == 0) & F.col("title").isNotNull()).select("query_id", F.col("title").alias("text"))


_BM25 = (
    f"with {_TERMS}"
    + """, tf as (select doc_id, term, count(*) as tf, any_value(n) as len from (select doc_id, len(t) as n, unnest(t) as term from terms) group by doc_id, term),
  st as (select count(*) as n, avg(coalesce(len(t), 0)) as avgdl from terms), qs as (select distinct right(_id, 8)::bigint as query_id, title from doc_records where title is not null),
  qt as (select distinct query_id, unnest(list_filter(string_split_regex(regexp_replace(lower(replace(title, 'İ', 'I' || chr(775))), '[^a-z0-9一-鿿]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1)) as term from qs where query_id % 20 = 0),
  df as (select term, count(*) as df from tf group by 1),
  bm as (select query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) as s from qt join tf using (term) join df using (term), st group by all),
  rk as (select *, row_number() over (partition by query_id order by round(s, 9) desc, doc_id) as rank from bm)"""
)


@_q("bm25_search", _BM25 + " select query_id, doc_id, round(s, 6) + 0.0 as score, rank from rk where rank <= 10")
def bm25_search(spark, folder):
    hits = text.bm25(base.table(spark, folder, "documents").select("doc_id", "text"), _asked(spark, folder), 10)
    return hits.select("query_id", "doc_id", _r(F.col("score"), "score"), "rank")


@_q(
    "bm25_rerank",
    _BM25 + """, pool as (select query_id, doc_id from rk where rank <= 20), pst as (select query_id, count(*) as n, avg(coalesce(len(t), 0)) as avgdl from pool join terms using (doc_id) group by 1),
  qm as (select query_id, term, count(*) as times from (select query_id, unnest(list_filter(string_split_regex(regexp_replace(lower(replace(title, 'İ', 'I' || chr(775))), '[^a-z0-9一-鿿]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1)) as term from qs where query_id % 20 = 0) group by all),
  pp as (select pool.query_id, doc_id, term, tf, len, times from pool join tf using (doc_id) join qm using (query_id, term)), pdf as (select query_id, term, count(*) as df from pp group by all),
  sc as (select query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) as s from pp join pdf using (query_id, term) join pst using (query_id) group by all)
  select query_id, doc_id, round(s, 6) + 0.0 as score, rank from (select *, row_number() over (partition by query_id order by round(s, 9) desc, doc_id) as rank from sc) where rank <= 10""",
)
def bm25_rerank(spark, folder):
    """Statistics over each query's candidate pool only."""
    docs, asked = base.table(spark, folder, "documents").select("doc_id", "text"), _asked(spark, folder)
    pool = text.bm25(docs, asked, 20).select("query_id", "doc_id")
    return text.bm25(docs, asked, 10, pool=pool, distinct_terms=False).select("query_id", "doc_id", _r(F.col("score"), "score"), "rank")


@_q(
    "hybrid_pool",
    _BM25 + ", ds as (select query_id, doc_id, row_number() over (partition by query_id order by min(distance), doc_id) as r from scan_hits where distance >= 0 and distance <= 4 and not isnan(distance) and query_id % 20 = 0 group by query_id, doc_id) select query_id, doc_id from rk where rank <= 10 union select query_id, doc_id from ds where r <= 10",
)
def hybrid_pool(spark, folder):
    """Union of lexical and dense candidates, each pair once."""
    lexical = text.bm25(base.table(spark, folder, "documents").select("doc_id", "text"), _asked(spark, folder), 10).select("query_id", "doc_id")
    h = base.table(spark, folder, "scan_hits").where("query_id % 20 = 0 and distance >= 0 and distance <= 4 and not isnan(distance)")
    dense = scan.top_k(h.groupBy("query_id", "doc_id").agg(F.min("distance").cast("double").alias("value")), 10)
    return lexical.unionByName(dense.select("query_id", "doc_id")).distinct()


@_q("listwise_parse", "with p as (select p_partkey as k, list_filter(list_transform(regexp_extract_all(p_name || ' ' || p_retailprice::varchar || ' ' || (p_partkey % 9)::varchar || ' 3 1', '(\\d{1,9})', 1), lambda s: s::int), lambda i: i >= 1 and i <= 5) as s from part), u as (select k, list_filter(s, lambda x, i: list_position(s, x) = i) as s from p) select k, array_to_string(list_concat(s, list_filter([1, 2, 3, 4, 5], lambda i: not list_contains(s, i))), ',') as ranking from u")
def listwise_parse(spark, folder):
    p = base.table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", F.col("p_retailprice").cast("string"), (F.col("p_partkey") % 9).cast("string"), F.lit("3 1")).alias("t"))
    return p.select("k", F.array_join(text.parse_listwise(F.col("t"), 5), ",").alias("ranking"))


def _lists(spark, folder):
    h = base.table(spark, folder, "scan_hits").where("distance >= 0 and distance <= 4 and not isnan(distance) and query_id is not null")
    return scan.top_k(h.groupBy("query_id", "doc_id").agg(F.min("distance").cast("double").alias("value")), 8)


_LISTS = "with l as (select query_id, doc_id, d, r as rank from (select *, row_number() over (partition by query_id order by d, doc_id) as r from (select query_id, doc_id, min(distance)::double as d from scan_hits where distance >= 0 and distance <= 4 and not isnan(distance) group by all)) where r <= 8)"


@_q("pairwise_wins", _LISTS + ", p as (select a.query_id, a.doc_id as a, b.doc_id as b, case when (a.doc_id + b.doc_id) % 5 = 0 then null when (a.doc_id + b.doc_id) % 2 = 0 then a.doc_id else b.doc_id end as w from l a join l b on a.query_id = b.query_id and a.doc_id < b.doc_id), e as (select query_id, a as doc_id, case when w is null then 0.5 when w = a then 1.0 else 0.0 end as s from p union all select query_id, b, case when w is null then 0.5 when w = b then 1.0 else 0.0 end from p) select l.query_id, l.doc_id, coalesce(sum(s), 0.0)::double as wins from l left join e on e.query_id = l.query_id and e.doc_id = l.doc_id group by all")
def pairwise_wins(spark, folder):
    """Win counts under a fixed stand-in judge; ten lists' worth of pairs a query."""
    l = _lists(spark, folder)
    pairs = l.alias("a").join(l.alias("b"), F.expr("a.query_id = b.query_id and a.doc_id < b.doc_id")).select(F.col("a.query_id").alias("query_id"), F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))
    total = F.col("a") + F.col("b")
    return text.pair_wins(l, pairs.withColumn("winner", F.when(total % 5 == 0, F.lit(None)).when(total % 2 == 0, F.col("a")).otherwise(F.col("b"))))


@_q("setwise_scores", _LISTS + ", w as (select query_id, unnest(range(greatest(0, ceil((rank - 4) / 2.0)::bigint), (rank - 1) // 2 + 1)) as w, doc_id, rank from l), x as (select * from w where rank <= w * 2 + 4), c as (select query_id, w, arg_max(doc_id, doc_id % 13 * 100000 + rank) as f, min_by(doc_id, doc_id % 13 * 100000 + rank) as g from x group by all) select x.query_id, x.doc_id, round(sum(case when x.doc_id = f then 1.0 when x.doc_id = g then 0.5 else 0.0 end) - 0.001 * min(rank), 6) + 0.0 as score from x join c using (query_id, w) group by x.query_id, x.doc_id")
def setwise_scores(spark, folder):
    l = _lists(spark, folder).select("query_id", "doc_id", "rank")
    w = text.set_windows(l)
    key = F.col("doc_id") % 13 * 100000 + F.col("rank")
    choices = w.groupBy("query_id", "window").agg(F.max_by("doc_id", key).alias("first"), F.min_by("doc_id", key).alias("second"))
    return text.set_scores(w, choices).select("query_id", "doc_id", _r(F.col("score"), "score"))
