"""Near duplicates, fused rankings, mixtures and stuffed pages on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm import components, mixing, neardup, queries, rankwalk, stuffing

WORDS = [f"w{i:03d}x{i % 7}" for i in range(300)]


def overlap(a, b):
    x, y = neardup.run_set(a, 5), neardup.run_set(b, 5)
    return len(x & y) / len(x | y) if x | y else 0.0


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        base = " ".join(rng.choice(WORDS) for _ in range(rng.choice([30, 80, 400])))
        rows.append((f"d{i:03d}a", f"T{i}", base))
        rows.append((f"d{i:03d}b", f"T{i}", edited(base, rng, rng.choice([1, 3, 8]))))
        if i % 5 == 0:
            rows += [(f"d{i:03d}{c}", f"t{i}!", base.upper()) for c in "cde"]  # copies after normalising
        if i % 7 == 0:
            half = base.split()
            rows.append((f"d{i:03d}z", None, " ".join(half[len(half) // 3 :] + half[: len(half) // 3]) + f" T{i}"))
    rows += [("n1", None, None), ("n2", "", ""), ("n3", "a", "b"), ("n4", "a", "b"), (None, "x", "some text that is long enough"), rows[0], rows[0]]
    rows.append(("long1", None, "ab cd " * 40_000))
    df = spark.createDataFrame([(*r, "e", "e") for r in rows], "_id string, title string, text string, rep string, digest string")
    found = neardup.NearDuplicates(df, "_id", ["title", "text"], threshold=0.7, bands=60, rows=4)
    got = {tuple(r) for r in found.pairs().collect()}
    norm = {i: neardup.normalised(f"{t or ''} {x or ''}") for i, t, x in rows if i}
    ids = sorted(norm)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if overlap(norm[a], norm[b]) >= 0.7}
    assert got == want
    groups = {r.id: r.group_id for r in found.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in want)
    assert set(groups) == {i for i in ids if len(norm[i]) >= 5}
    empty = neardup.NearDuplicates(df.limit(0), "_id", ["title", "text"])
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_many_copies_have_one_shape(spark, monkeypatch):
    text = "the same long enough text in very many places"
    n = 90
    df = spark.createDataFrame([(f"{i:04d}", text) for i in range(n)] + [(x, text + " y") for x in "uvwx"], "_id string, text string")
    want = {(f"{i:04d}", f"{j:04d}") for j in range(n) for i in range(j)} | {(f"{i:04d}", x) for i in range(n) for x in "uvwx"} | {(x, y) for x in "uvwx" for y in "uvwx" if x < y}
    for block in (512, 20):
        monkeypatch.setattr(neardup, "BLOCK", block)
        found = neardup.NearDuplicates(df, "_id", ["text"], threshold=0.7)
        pairs = [tuple(r) for r in found.pairs().collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
        groups = found.groups().collect()
        assert {r.group_id for r in groups} == {"0000"} and {r.links for r in groups} == {1} and {r.copies_of for r in groups} == {"0000", "u"}
        assert found.links.count() == 1


def test_hot_band_is_met_in_blocks(spark, monkeypatch):
    """A family of one boilerplate: every text shares bands with every other."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng = random.Random(9)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = [(f"{i:05d}", " ".join(base[:145] + [f"n{i:05d}"] + base[145:])) for i in range(700)]
    df = spark.createDataFrame(rows, "_id string, text string")
    prepared = neardup._prepared(df, "_id", ["text"], 5, 32, 5)
    exploded = prepared.select("id", F.explode("bands").alias("h"))
    hot = exploded.join(exploded.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h")
    assert hot.agg(F.max("n")).first()[0] > 600
    left, right = neardup.in_blocks(hot, "h", 64)
    assert max(r["count"] for side in (left, right) for r in side.groupBy("h", "meet").count().collect()) < 200
    found = neardup.NearDuplicates(df, "_id", ["text"], threshold=0.7)
    assert found.links.count() == 700 * 699 // 2
    assert {r.group_id for r in found.groups().collect()} == {"00000"}


def test_slack_loses_nothing_at_the_threshold():
    """Of pairs with an overlap of 0.7, none is dropped by its signature's estimate."""
    rng = np.random.default_rng(3)
    low = 1.0
    for _ in range(400):
        n = int(rng.integers(60, 1500))
        whole = rng.choice(neardup.UNIVERSE, n + 2 * int(n * 0.2143), replace=False)
        side = int(n * 0.2143)  # n / (n + 2 side) is 0.7
        x, y = np.sort(whole[: n + side]), np.sort(np.concatenate([whole[:n], whole[n + side :]]))
        low = min(low, (neardup.signature(x, 160) == neardup.signature(y, 160)).mean())
    assert low > 0.7 - neardup.SLACK


def test_circulant_signature_estimates_overlap():
    rng = np.random.default_rng(1)
    a = rng.choice(10**6, 2000, replace=False)
    b = np.concatenate([a[:1600], rng.choice(10**6, 400) + 10**6])
    x, y = (np.unique(neardup.mix64(v.astype(np.uint64)) >> np.uint64(44)).astype(int) for v in (a, b))
    same = (neardup.signature(x, 512) == neardup.signature(y, 512)).mean()
    assert same == pytest.approx(1600 / 2400, abs=0.08)


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y"), ("q", "q"), (None, "a")] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)], "a string, b string")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert {got[k] for k in "abc"} == {"a"} and got["y"] == "x" and "q" not in got
    assert {got[f"n{i:02d}"] for i in range(31)} == {"n00"}
    assert components.components(edges.limit(0)).count() == 0


def slow_walk(lists, n, damping):
    """The chain's matrix, powered."""
    m = np.zeros((n, n))
    for order in lists:
        place = {x: r for r, x in enumerate(order)}
        for i in range(n):
            r = place.get(i, len(order) - 1)
            m[i, order[: r + 1]] += damping / len(lists) / (r + 1)
    m += (1 - damping) / n
    p = np.full(n, 1 / n)
    for _ in range(3000):
        p = p @ m
    return p


def ranking_rows():
    rng = random.Random(2)
    rows = [(q, l, d, rng.choice([rng.gauss(0, 1), 0.5, -0.0, 0.0]) * 10.0 ** l, 10.0) for q in (1, 2) for l in range(3) for d in range(25) if rng.random() < 0.7]
    return rows


def test_walk_against_matrix_and_giant_path(spark):
    rows = ranking_rows() + [(1, 0, 3, float("nan"), 10.0), (1, 1, None, 1.0, 10.0), (None, 1, 1, 1.0, 10.0), (3, 0, 5, 1.0, None), (1, 7, 4, None, 10.0)]
    df = spark.createDataFrame(rows, "q long, l int, d long, v double, k double").withColumn("rank", F.lit(0)).withColumn("chance", F.lit("x"))
    one = {(r.q, r.d): r for r in rankwalk.combine_rankings(df, "q", "l", "d", "v", "k").collect()}
    best: dict = {}
    for q, l, d, v, _ in rows:
        if None not in (q, l, d, v) and v == v:
            best[q, l, d] = max(best.get((q, l, d), -1e300), v + 0.0)
    for q in (1, 2):
        items = sorted({d for g, _, d in best if g == q})
        lists = [[items.index(d) for d in sorted((d for g, m, d in best if (g, m) == (q, l)), key=lambda d: (-best[q, l, d], d))] for l in range(3)]
        p = slow_walk(lists, len(items), 10 / 11)
        for i, d in enumerate(items):
            assert one[q, d].chance == pytest.approx(p[i], abs=1e-9)
        assert [d for d in sorted(items, key=lambda d: one[q, d]["rank"])] == [items[i] for i in np.lexsort((items, -np.round(np.log(p), 10)))]
    assert one[3, 5]["rank"] == 1 and one[3, 5].lists == 1
    big = {(r.q, r.d): r for r in rankwalk.combine_rankings(df, "q", "l", "d", "v", "k", giant_over=10, chunk_rows=9).collect()}
    assert set(big) == set(one)
    for k, r in one.items():
        assert big[k].chance == pytest.approx(r.chance, rel=1e-7) and big[k]["rank"] == r["rank"]
        assert (big[k].lists, big[k].in_lists, big[k].worst_rank) == (r.lists, r.in_lists, r.worst_rank)
    assert rankwalk.combine_rankings(df.limit(0), "q", "l", "d", "v", "k").count() == 0


def test_scale_of_a_list_does_not_matter(spark):
    rows = ranking_rows()
    df = spark.createDataFrame(rows, "q long, l int, d long, v double, k double")
    scaled = df.withColumn("v", F.when(F.col("l") == 1, F.col("v") * 1e6 + 5).otherwise(F.col("v")))
    order = lambda x: {(r.q, r.d): r["rank"] for r in rankwalk.combine_rankings(x, "q", "l", "d", "v").collect()}
    assert order(df) == order(scaled)


def test_heads_of_all_lists_are_at_the_head_of_the_order():
    """The bound on the rank of an item that stands among the first r of every list."""
    rng = random.Random(12)
    met = 0
    for _ in range(400):
        n, lists = rng.randint(3, 40), rng.randint(1, 5)
        orders = []
        for _ in range(lists):
            score = [i * rng.choice([0, 1]) + rng.random() * rng.choice([1, n]) for i in range(n)]
            orders.append(np.array(sorted(range(n), key=score.__getitem__)[: rng.randint(2, n)]))
        p = rankwalk.stationary(orders, n, rng.choice([0.5, 10 / 11, 60 / 61]))
        place = {i: r for r, i in enumerate(np.lexsort((np.arange(n), -np.round(np.log(p), 10))), 1)}
        for r in (1, 2, 3):
            for i in set.intersection(*(set(o[:r].tolist()) for o in orders)):
                met += 1
                assert place[i] <= (r - 1) * lists + 1
    assert met > 200


def test_long_lists_keep_their_order():
    """Neighbours far down one list differ, though their chances lie close."""
    p = rankwalk.stationary([np.arange(300_000)], 300_000, 60 / 61)
    assert (np.diff(np.round(np.log(p), 10)) < 0).all()


def test_p4_order_against_brute_force(spark, sf):
    """Every query of the smallest tables, by the powered matrix."""
    best: dict = {}
    for r in queries.table(spark, sf, "search_results").collect():
        if r.score is not None and r.score == r.score and None not in (r.query_id, r.channel, r.id):
            v = (-r.score if r.channel == "fts5" else r.score) + 0.0
            best[r.query_id, r.channel, r.id] = max(best.get((r.query_id, r.channel, r.id), -np.inf), v)
    asked = {r.query_id for r in queries.table(spark, sf, "search_results").select("query_id").distinct().collect()}
    k = {r.params_id: r.rrf_k for r in queries.table(spark, sf, "cascade_params").collect()}
    damping: dict = {}
    for r in queries.table(spark, sf, "scan_hits").collect():
        if r.params_id is not None:
            damping[r.query_id] = k[r.params_id]
        if r.query_id in asked and r.distance is not None and 0 <= r.distance <= 4:
            best[r.query_id, "distance", r.doc_id] = max(best.get((r.query_id, "distance", r.doc_id), -np.inf), -r.distance + 0.0)
    groups: dict = {}
    for q, channel, d in best:
        groups.setdefault(q, {}).setdefault(channel, []).append(d)
    got: dict = {}
    for r in queries.p4_order(spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.chance)
    assert set(got) == set(groups) and len(groups) > 5
    for q, lists in groups.items():
        items = sorted({d for l in lists.values() for d in l})
        if len(items) > 400:
            continue  # the matrix would be large
        orders = [[items.index(d) for d in sorted(l, key=lambda d: (-best[q, c, d], d))] for c, l in lists.items()]
        c = damping.get(q)
        c = 60.0 if c is None else c
        p = slow_walk(orders, len(items), c / (c + 1))
        assert [got[q][r][1] for r in range(1, len(items) + 1)] == pytest.approx(sorted(p, reverse=True), rel=1e-6)
        for r in range(1, len(items) + 1):
            assert p[items.index(got[q][r][0])] == pytest.approx(got[q][r][1], rel=1e-6)


def test_p4_oracle_shape(spark, sf):
    out = queries.p4_order(spark, sf)
    assert out.groupBy("query_id", "rank").count().where("count > 1").count() == 0


def test_amounts():
    held, share, most = {"a": 100, "b": 100, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 1, "b": 2, "c": 3, "d": 1}
    got = mixing.amounts(held, share, most, 200)
    assert got["c"] == 30 and got["a"] == 100 and got["b"] == pytest.approx(70) and got["d"] == 0
    assert mixing.amounts({}, share, most, 100) == dict.fromkeys(share, 0.0)


def test_pivot_keeps_tokens():
    rng = random.Random(3)
    for n in (0, 1, 2, 50, 501):
        t = [rng.randint(1, 900) for _ in range(n)]
        p = [rng.choice([0.0, 1.0, 0.3, 0.5, rng.random()]) for _ in range(n)]
        take, open_, chance = mixing.pivot(list(range(n)), p, t, 5)
        total = sum(a * b for a, b in zip(take, t)) + (chance * t[open_] if open_ is not None else 0)
        assert total == pytest.approx(sum(a * b for a, b in zip(p, t)), abs=1e-3)


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 40))), rng.choice(["a", "a", "b", "c", "x", None])) for i in range(300)]
    docs += [(900, None, "a"), (901, "", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("p", F.lit(1)).withColumn("row", F.lit(1))
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.29, 2), ("gone", 0.01, 2)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(df, targets)
    report = {r.source: r for r in m.report().collect()}
    longest = max(r.tokens for r in m.copies.collect())
    aims = {r.source: r.aim for r in m.targets.collect()}
    for s in "abc":
        assert abs(report[s].tokens - aims[s]) <= longest and report[s].most_repeats <= report[s].max_repeats
    assert report["x"].tokens == report[None].tokens == report["gone"].tokens == 0
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1)
    again = {r.id: r.copies for r in mixing.Mixture(df.repartition(5), targets).copies.collect()}
    assert again == {r.id: r.copies for r in m.copies.collect()}  # no matter how rows lie
    assert all(r.reached_share == 0 for r in mixing.Mixture(df.limit(0), targets).report().collect())


COURTS, MATTERS, ENDS = ["Norwick", "Dunmouth", "Skell", "Farrow", "Haldon"], ["the appeal", "the lease", "the permit", "a claim of the carrier", "the second notice"], ["was late", "had no merit", "is not for this panel", "was sent back to the office", "was left open"]


def prose(rng, n=6):
    """Honest sentences."""
    return " ".join(f"The {rng.choice(['court', 'board', 'clerk'])} of {rng.choice(COURTS)} held in {rng.randint(1950, 2020)} that {rng.choice(MATTERS)} {rng.choice(ENDS)}, and the costs of {rng.choice(MATTERS)} were put on the {rng.choice(['owner', 'tenant', 'bank'])}." for _ in range(n))


def stuffed(rng, kind):
    """Pages of one kind, each with its own keywords and places."""
    x, y = (f"{rng.choice(['red', 'old', 'oak', 'dry', 'raw', 'big'])} {rng.choice(['shoes', 'lamps', 'tiles', 'pipes', 'coats', 'boats', 'rings'])}{rng.choice('abcdefgh')}" for _ in "xy")
    town = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).title()
    ads = ["cheap", "best", "near me", "online", "sale", "buy"]
    if kind == "keywords":
        return " ".join(rng.choice([x, y, rng.choice(ads)]) for _ in range(60))
    if kind == "places":
        return ", ".join(f"cheap {x} {town()}" for _ in range(30))
    if kind == "links":
        return "\n".join(f"https://www.{town().lower()}.example/p/{rng.randint(1, 999)} {rng.choice([x, y])}" for _ in range(15))
    if kind == "goods":
        return "\n".join(f"{rng.choice([x, y])} {town().upper()}-{rng.randint(1, 999)} {rng.randint(1, 99)}.50 {rng.choice(ads)} [in stock]" for _ in range(15))
    if kind == "sentences":
        return " ".join(rng.choice([f"Why {x}? Because {x} beats every other {y}.", f"Looking for {x} in {town()}? Our {x} is the best {x} around.", f"The {x} experts compare {x} and {y} for all of the owners."]) for _ in range(12))
    if kind == "after prose":
        return prose(rng, 1) + "\n" + " ".join(rng.choice([x, y, rng.choice(ads)]) for _ in range(150))
    words = rng.sample(["港口规费", "外墙改造", "渡船班次", "仲裁费用", "数据托管"], 2)
    if kind == "ideograph list":
        return ", ".join(f"{rng.choice(words)} {rng.choice(['价格', '排名', '哪家好', '便宜'])}" for _ in range(40))
    return "".join(rng.choice([f"为什么选择{words[0]}？因为{words[0]}胜过其他{words[1]}。", f"我们的{words[0]}是最好的{words[0]}。", f"{words[0]}专家为您比较{words[0]}与{words[1]}。"]) for _ in range(15))


KINDS = ["keywords", "places", "links", "goods", "sentences", "after prose", "ideograph list", "ideographs"]
LINES = "\n".join(["harbour dues | article 12 | 516,924 crowns", "ferry permits | article 9 | 11,200 crowns", "[1] Carter v Norwick Foundry, RA 92871/11 (1994).", "[2] Dune v Mill Trust, RB 1871/12 (1998)."])


def crawl(seed=5):
    """(id, text, host, lang): 8 kinds of stuffed pages on 9 hosts each, and honest ones."""
    rng = random.Random(seed)
    rows = [(1000 * k + i, stuffed(rng, kind), f"s{k}-{i}.example", "zh" if kind.startswith("ideo") else "en") for k, kind in enumerate(KINDS, 1) for i in range(9)]
    zh = "申请人认为，法院对该合同作出的决定已经超过规定的期限，应当在三十日内完成登记。承租人可以在判决生效之后提出书面的异议，但以不超过两个月为限。"
    for i in range(200):
        text = prose(rng)
        if i % 4 == 0:
            text += "\n" + LINES
        if i % 7 == 0:
            text += " (see https://www.court.example/p/77)"
        if i % 11 == 0:
            text = rng.choice(["short text", None, "", "   ", text[:90], "ç\x94³è¯·äººè®¤ä¸ºï¼\x8cæ³\x95é\x99¢å¯¹è¯¥å\x90\x88" * 5])
        rows.append((i, text, f"h{i % 60}.example", "en"))
    rows += [(300 + i, zh + str(i), f"h{i}.example", "zh") for i in range(30)]
    return rows


SCHEMA = "doc_id long, text string, portal string, lang string"


def pages(df, **how):
    return stuffing.stuffed_pages(df, "doc_id", "text", "portal", "lang", **how)


def test_stuffed_pages(spark):
    rows = crawl()
    rows += [rows[0], rows[3], (9999, rows[20][1] + " ", None, None)]  # given again, and without host and language
    df = spark.createDataFrame(rows, SCHEMA).withColumn("stuffed", F.lit(1)).withColumn("host", F.lit(1)).withColumn("n", F.lit(1))
    got = pages(df).where("stuffed").collect()
    assert {r.id for r in got} == {i for i, *_ in rows if i >= 1000} and len(got) == len({r.id for r in got})
    assert pages(df.limit(0)).count() == 0


def test_nothing_is_flagged_without_phrases_on_other_hosts(spark):
    """The same pages on one host, then one of them alone in the crawl: density alone flags nothing."""
    rows = crawl()
    df = spark.createDataFrame(rows, SCHEMA)
    one = pages(df.withColumn("portal", F.lit("one.example")))
    assert one.where("stuffed").count() == 0 and one.count() >= 9 * len(KINDS)  # dense all the same
    for k in (1000, 4000, 5000, 8000):
        found = {r.id: r for r in pages(spark.createDataFrame([r for r in rows if r[0] < 1000 or r[0] == k], SCHEMA)).collect()}
        assert k in found and not any(r.stuffed for r in found.values())


def test_copied_prose_is_no_case(spark):
    rng = random.Random(2)
    text = prose(rng, 20)
    rows = [(i, text, f"h{i}", "en") for i in range(50)] + [(100 + i, prose(rng), f"k{i}", "en") for i in range(50)]
    assert pages(spark.createDataFrame(rows, SCHEMA)).where("stuffed").count() == 0


def test_common_words_are_counted(spark):
    rows = [(f"The owner of house {i} and the tenant", "en") for i in range(40)] + [(f"der Mieter und w{i}", "de") for i in range(20)] + [("rare words here", "xx")]
    df = spark.createDataFrame([(t, l) for t, l in rows] * 3, "t string, lang string")
    assert stuffing.common_words(df, 0.3) == {"the", "owner", "of", "house", "and", "tenant", "der", "mieter", "und", "rare", "words", "here"}
    many = df.unionByName(df.where("lang = 'en'")).unionByName(df.where("lang = 'en'")).where("lang != 'xx'").unionByName(spark.createDataFrame([("rare words", "xx")], "t string, lang string"))
    assert "rare" not in stuffing.common_words(many, 0.3)  # a language of under one page in a hundred
    assert stuffing.common_words(df.limit(0), 0.3) == frozenset()


def test_shingles_have_stride_one():
    h, unit, weight = stuffing.shingles(np.arange(1, 10, dtype=np.uint64), np.array([7, 2]))
    assert unit.tolist() == [0, 0, 0, 1] and len(set(h.tolist())) == 4 and weight.tolist() == [5, 1, 1, 2]
    shifted, _, _ = stuffing.shingles(np.arange(2, 8, dtype=np.uint64), np.array([6]))
    assert shifted.tolist() == h[1:3].tolist()
    assert len(stuffing.shingles(np.zeros(0, np.uint64), np.zeros(0, np.int64))[0]) == 0


def test_units():
    common = frozenset("the of that was and a in is".split())
    kinds = lambda t: stuffing.page_units(t + "\n" + "The costs of the claim and of the appeal were put on the carrier in that year.", common).kinds[:-1]
    assert kinds("The court held that the appeal was late.") == [stuffing.SENTENCE]
    assert kinds("red shoes, blue lamps, oak desks") == [stuffing.ITEM] * 3
    assert kinds("法院对该合同作出的决定已经超过规定的期限。") == [stuffing.SENTENCE]
    assert kinds("港口规费 价格 外墙改造 排名 仲裁费用") == [stuffing.ITEM]
    page = stuffing.page_units("https://a.example/x red shoes\nThe court (www.b.example/y) held that the appeal was late.\n" + "The costs of the claim were put on the carrier in that year.", common)
    assert page.words.count("\x00") == 2 and page.listed == len("https://a.example/x red shoes") + len("www.b.example/y)") - 1
    assert stuffing.page_units(None, common) is stuffing.page_units("short", common) is None
