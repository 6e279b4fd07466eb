import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm import queries, split, tokens, topn


def check_split(text, limit, overlap):
    got = split.split_pieces(text, limit, overlap)
    if len(text) <= limit:
        assert got == []
        return
    assert all(0 < len(p) <= limit for p, _ in got)
    whole = got[0][0]
    for piece, _ in got[1:]:
        assert piece[:overlap] == whole[len(whole) - overlap :]
        whole += piece[overlap:]
    assert whole == text


def test_split_round_trip_random():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.choice([0, 5, 399, 400, 401, 459, 800, 3000, 20000])
        text = "".join(rng.choice(rng.choice(["ab ", "abcdefgh", "a.b\n\n ", "好。字", "éx"])) for _ in range(n))
        check_split(text, 400, 60)
        check_split(text, 100, 0)


def test_split_prefers_strong_boundaries():
    text = ("word " * 70).strip() + ".\n\n" + ("other " * 70).strip()
    pieces = split.split_pieces(text, 500, 60)
    assert len(pieces) == 2 and pieces[0][0].endswith(".\n\n") and pieces[1][1] == 4.0


def test_cuts_snap_to_the_strongest_boundary_in_reach():
    """Where the least number of pieces leaves room, cuts fall behind paragraphs and sentences."""
    rng = random.Random(8)
    paragraph = lambda: " ".join(" ".join(rng.choice(["alpha", "be", "gamma", "delta"]) for _ in range(rng.randint(5, 14))).capitalize() + "." for _ in range(rng.randint(2, 5))) + "\n\n"
    strengths = []
    for _ in range(40):
        text = "".join(paragraph() for _ in range(40))[:3300]
        strengths += split.cut_points(text, 1500, 60)[1]
    assert len(strengths) == 80 and min(strengths) >= 2.0 and sum(s == 4.0 for s in strengths) > 60
    words = " ".join("word" for _ in range(2000))
    assert set(split.cut_points(words, 400, 60)[1]) == {1.0}
    cuts, strengths = split.cut_points("x" * 5000, 400, 60)
    assert set(strengths) == {0.0}


def test_one_long_stretch_is_scanned_once():
    import time

    begin = time.time()
    assert not split.longest_unbroken("x" * 1499 + " " + ("y" * 1400 + ",") * 3000, 1500)
    assert split.longest_unbroken(("y" * 1400 + ",") * 3000 + "z" * 1501, 1500)
    assert time.time() - begin < 2


def test_split_forced_and_boundary(spark):
    rows = [("a", "x" * 401), ("b", "x y " * 200), ("b", "x y " * 200), ("c", None), ("d", ""), (None, "z" * 900), ("e", "z" * 100_000)]
    df = spark.createDataFrame(rows, "item_id string, t string").withColumn("piece", F.lit(1)).withColumn("n_pieces", F.lit(2))
    out = {(r.item_id, r.cut_kind) for r in split.split_oversized(df, "item_id", "t", 400).collect()}
    assert out == {("a", "forced"), ("b", "boundary"), ("e", "forced")}
    assert split.split_oversized(df.limit(0), "item_id", "t", 400).count() == 0


def test_p2_found_is_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/doc_records.parquet").where("length(text) > 1500").select("_id").distinct().count()
    chunks = spark.read.parquet(f"{sf}/chunks.parquet").where("length(chunk_text) > 400").select("id").distinct().count()
    assert queries.p2_found(spark, sf).count() == docs + chunks


def brute_top(rows, default_n):
    best, most = {}, {}
    for g, i, s, n in rows:
        if None in (g, i, s) or s != s:
            continue
        most[g] = default_n if n is None else n
        key = (g, i)
        best[key] = min(best.get(key, s), s)
    out = []
    for g in {k[0] for k in best}:
        ranked = sorted((s + 0.0, i) for (h, i), s in best.items() if h == g)
        out += [(g, i, s, r + 1) for r, (s, i) in enumerate(ranked[: max(0, most[g])])]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_top_n_against_brute_force(spark, parts):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(15), None]), rng.choice([0.0, -0.0, 0.5, 0.25, 1.5, None, float("nan")]), 4) for _ in range(1500)]
    rows += [(9, 1, 0.125, 0), (8, 5, 0.25, None), (8, 6, 0.25, None)] * 3
    df = spark.createDataFrame(rows, "q long, d long, s float, n int").repartition(parts).withColumn("rank", F.lit(0)).withColumn("g", F.lit(0))
    got = topn.top_n_per_group(df, "q", "d", "s", F.col("n"), default_n=1, buckets=3)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 1)
    assert got.columns == ["q", "d", "s", "rank"]


def test_top_n_descending_strings_and_empty(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("a", "z", 3.0), ("b", "x", -1.0)], "g string, i string, s double")
    got = sorted(tuple(r) for r in topn.top_n_per_group(df, "g", "i", "s", 2, ascending=False).collect())
    assert got == [("a", "y", 3.0, 1), ("a", "z", 3.0, 2), ("b", "x", -1.0, 1)]
    assert topn.top_n_per_group(df.limit(0), "g", "i", "s", 2).count() == 0


def test_top_n_streams_more_groups_than_a_batch(spark):
    """Many groups in one bucket and small batches: groups cross the batches' ends, and a hot one spans many."""
    rng = random.Random(3)
    rows = [(g, rng.randrange(40), float(rng.randrange(9)), 3) for g in range(4000) for _ in range(rng.choice([1, 2, 9]))] + [(77, i, float(i % 50), 3) for i in range(9000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "q long, d long, s double, n int").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sorted(tuple(r) for r in topn.top_n_per_group(df, "q", "d", "s", 3, buckets=1).collect())
        assert got == brute_top(rows, 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_merge_seeks_past_the_rest_of_a_group():
    """Of a long run only the rows up to the N-th output are ever looked at."""

    class Watched(list):
        seen = 0

        def __getitem__(self, at):
            Watched.seen = max(Watched.seen, at if isinstance(at, int) else 0)
            return super().__getitem__(at)

    scores = Watched(float(x) for x in range(10_000))
    got = topn.merge_group(scores, list(range(10_000)), 3, [(0, 5000), (5000, 10_000)])
    assert got == [(0, 0.0, 1), (1, 1.0, 2), (2, 2.0, 3)] and Watched.seen == 5000


def test_loser_tree_sorts():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted(rng.random() for _ in range(rng.randint(0, 20))) for _ in range(k)]
        heads = [0] * k
        tree = topn.LoserTree([r[0] if r else None for r in runs])
        out = []
        while tree.keys[tree.winner] is not None:
            w = tree.winner
            out.append(tree.keys[w])
            heads[w] += 1
            tree.replace(runs[w][heads[w]] if heads[w] < len(runs[w]) else None)
        assert out == sorted(x for r in runs for x in r)


def test_tokens_equal_the_library(spark):
    tk = pytest.importorskip("tokenizers")
    whole = tk.Tokenizer.from_file(f"{tokens.DEFAULT_TOKENIZERS}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    rng = random.Random(5)
    parts = ["word ", " ", "  ", "\n", "'s", "!'s", "'", "é", "好字", "ßx", " ", "　", "12", "<|endoftext|>", "ab", "\t", "x" * 3000, "é", "🙂", "龍", "䷀", "при вет ", "λόγος ", "한국어 문장은", "ひらがなカタカナー゛", "สวัสดี", "\u00a0 ", "\u2003 ", "\u3000 ", "\u1680 ", "\u0085 ", "क्षत्रिय ", "שלום "]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.choice([1, 5, 60, 400]))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("ids", F.lit("clash"))
    got = {r.k: r.ids for r in tokens.encode_corpus(df, "k", "text").collect()}
    for k, text in enumerate(texts):
        assert got[k] == whole.encode(text or "", add_special_tokens=False).ids
    counts = {r.k: r.tokens for r in tokens.count_tokens(df, ["k"], "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokens.encode_corpus(df.limit(0), "k", "text").count() == 0


def test_cuts_are_certain_and_found_in_many_scripts():
    """Every certain cut, not only one in a block, leaves the ids as they are."""
    code = tokens.encoder(tokens.tokenizer_file("byte_bpe_50k"))
    rng = random.Random(6)
    alphabets = ["абвгдежз иклмн ", "αβγδ εζηθ ", "한국어문장은길다 ", "ひらがなのカタカナーァヺ・゛", "中文文本没有空格的", "abc def é ", "\u00a0\u2003\u3000\u1680\u0085 x", "สวัสดีครับ ", "שלום עולם ", "क्षत्रिय ", "'s ll've re 12 ab3 -- !"]
    met = dict.fromkeys(alphabets, 0)
    for _ in range(300):
        for letters in alphabets:
            text = "".join(rng.choice(letters) for _ in range(rng.choice([3, 20, 200])))
            if rng.random() < 0.3:
                text += "".join(rng.choice(rng.choice(alphabets)) for _ in range(30))
            data = text.encode()
            edges = [0, *code.cuts(np.frombuffer(data, np.uint8)).tolist(), len(data)]
            met[letters] += len(edges) - 2
            parts = [data[a:b].decode() for a, b in zip(edges, edges[1:])]  # no cut inside a character
            assert [i for p in parts for i in code.encoding.encode(p, disallowed_special=())] == code.encoding.encode(text, disallowed_special=())
    assert all(n > 50 for k, n in met.items() if not k.startswith("\u00a0")), met
