"""Most similar vectors and similarity clusters against brute force."""

import numpy as np
import pytest

from vectide.llm import knn
from vectide.llm.clusters import BisectingClusters, bisect_locally

DIM = 16


def blob(v):
    return None if v is None else np.asarray(v, "<f4").tobytes()


def topics(n, k, spread, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(k, DIM))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(0, k, n)] + spread * rng.normal(size=(n, DIM)) / np.sqrt(DIM)
    return (x * rng.uniform(0.5, 3, size=(n, 1))).astype(np.float32)


def brute(ids, x, k):
    """Top k by similarity to 6 decimals, then id (as string)."""
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = {}
    for i, a in enumerate(ids):
        others = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if ids[j] != a)
        out[a] = [(b, -v) for v, b in others[:k]]
    return out


def test_dirty_vectors_copies_and_ties(spark):
    x = topics(60, 3, 0.3, 4)
    ids = [f"v{i:03d}" for i in range(60)]
    copies = [(f"c{i:02d}", x[0]) for i in range(12)]  # a large group of copies
    rows = [(a, blob(v), 1.0) for a, v in zip(ids, x)] + [(a, blob(v), 2.0) for a, v in copies]
    rows += [rows[5], rows[5], ("v001", None, 3.0), ("n", None, 1.0), ("s", b"123", 1.0), ("z", blob([0] * DIM), 1.0), ("i", blob([np.inf] * DIM), 1.0), ("w", blob([1] * (DIM + 1)), 1.0), (None, blob(x[3]), 1.0)]
    df = spark.createDataFrame(rows, "id string, vector binary, sim double")
    got: dict = {}
    for r in knn.most_similar(df, "id", "vector", DIM, k=5).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, round(r.sim, 4)))
    want = brute(ids + [a for a, _ in copies], np.concatenate([x, np.stack([v for _, v in copies])]), 5)
    assert set(got) == set(want)
    for a, rows_ in want.items():
        assert [b for _, b, _ in sorted(got[a])] == [b for b, _ in rows_], a
    assert knn.most_similar(df.limit(0), "id", "vector", DIM).count() == 0


def test_many_shards_keep_recall(spark):
    x = topics(2500, 5, 0.5, 9)
    ids = [f"{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(a, blob(v)) for a, v in zip(ids, x)], "id string, vector binary")
    out = knn.most_similar(df, "id", "vector", DIM, k=5, shard_cap=200, margin=0.25, reach=8, ef=24)
    got: dict = {}
    for r in out.collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute(ids, x, 5)
    assert np.mean([len(got[a] & {b for b, _ in want[a]}) / 5 for a in ids]) >= 0.9
    strong = knn.most_similar(df, "id", "vector", DIM, k=5, shard_cap=200, margin=0.25, reach=8, min_sim=0.97).collect()
    expected = {(a, b) for a in ids for b, s in want[a] if s >= 0.97}
    assert len({(r.id, r.other) for r in strong} & expected) >= 0.98 * len(expected)


def test_results_come_from_the_graph(spark, monkeypatch):
    """With a beam of one the search, and so the answer, gets worse: no other path gives rows."""
    x = topics(1500, 3, 0.6, 11)
    df = spark.createDataFrame([(f"{i:05d}", blob(v)) for i, v in enumerate(x)], "id string, vector binary")
    want = brute([f"{i:05d}" for i in range(len(x))], x, 5)

    def recall(**how):
        got: dict = {}
        for r in knn.most_similar(df, "id", "vector", DIM, k=5, m=4, **how).collect():
            got.setdefault(r.id, set()).add(r.other)
        return np.mean([len(got.get(a, set()) & {b for b, _ in w}) / 5 for a, w in want.items()])

    assert recall(ef=5) < recall(ef=32) - 0.02 and recall(ef=32) > 0.9


def test_cells_are_divided_until_they_are_small(spark, monkeypatch):
    """Several levels: few centres a level, cells of one direction and of equal centres among them."""
    monkeypatch.setattr(knn, "FAN", 4)
    monkeypatch.setattr(knn, "SAMPLE", 256)
    monkeypatch.setattr(knn, "ROUTE_BLOCK", 300)
    monkeypatch.setattr(knn, "ASK_BLOCK", 100)
    rng = np.random.default_rng(2)
    x = np.concatenate([topics(1200, 5, 0.5, 9), (np.ones(DIM) + 0.001 * rng.normal(size=(600, DIM)))]).astype(np.float32)
    ids = [f"{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(a, blob(v)) for a, v in zip(ids, x)], "id string, vector binary")
    reps = knn.usable_vectors(df, "id", "vector", DIM, "<f4")
    placed, sizes = knn.cells_of(reps, len(x), DIM, 60, 0.2, 6)
    rows = placed.collect()
    assert sorted(r.id for r in rows if r.home) == ids  # one own cell each
    assert len({(r.id, r.node) for r in rows}) == len(rows)
    own = {r.node: r.own for r in sizes.collect()}
    assert max(own.values()) <= 120 and sum(own.values()) == len(x) and max(own) > 4 * 4
    got: dict = {}
    for r in knn.most_similar(df, "id", "vector", DIM, k=5, shard_cap=60, margin=0.3, reach=12, ef=24).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute(ids, x, 5)
    assert np.mean([len(got[a] & {b for b, _ in want[a]}) / 5 for a in ids[:1200]]) >= 0.85


def test_cells_without_a_difference(spark):
    same = np.ones((4, DIM), np.float32)
    row, cell, home = knn.reached(same, [f"{i}" for i in range(4)], np.ones((3, DIM), np.float32), 0.1, 2)
    assert home.sum() == 4 and len(row) == 8 and set(cell) <= {0, 1, 2}
    assert (knn.reached(same, ["a"] * 4, np.eye(DIM, dtype=np.float32)[:1], 0.1, 4)[1] == 0).all()


@pytest.mark.parametrize("fan", [4, 4096])
def test_more_like_vectors_than_a_shard_holds(spark, monkeypatch, fan):
    """Different vectors that no centres part: cells divide all the same, and those without members answer nothing."""
    monkeypatch.setattr(knn, "FAN", fan)
    x = (np.ones((600, DIM)) + 1e-7 * np.random.default_rng(2).normal(size=(600, DIM))).astype(np.float32)
    ids = [f"{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(a, blob(v)) for a, v in zip(ids, x)], "id string, vector binary")
    placed, sizes = knn.cells_of(knn.usable_vectors(df, "id", "vector", DIM, "<f4"), len(x), DIM, 60, 0.12, 4)
    assert sorted(r.id for r in placed.where("home").collect()) == ids
    own = [r.own for r in sizes.collect()]
    assert max(own) <= 120 and sum(own) == len(x)
    rows = knn.most_similar(df, "id", "vector", DIM, k=5, shard_cap=60).collect()
    assert {r.id for r in rows} == set(ids) and len(rows) >= 0.99 * 5 * len(x)
    assert all(r.id != r.other and r.sim > 0.999999 for r in rows) and len({(r.id, r.other) for r in rows}) == len(rows)


def test_asked_cells_without_members(spark, monkeypatch):
    """Of equal centres the first gets all members; vectors reach the other too."""
    x = topics(300, 2, 0.3, 3)
    ids = [f"{i:05d}" for i in range(len(x))]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(knn, "_centres_of", lambda *a: np.stack([u[0], u[0], -u[0]]))
    df = spark.createDataFrame([(a, blob(v)) for a, v in zip(ids, x)], "id string, vector binary")
    got: dict = {}
    for r in knn.most_similar(df, "id", "vector", DIM, k=5, margin=3.0).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert np.mean([len(got[a] & {b for b, _ in w}) / 5 for a, w in brute(ids, x, 5).items()]) >= 0.95


def test_bisecting_in_one_task():
    x = topics(500, 8, 0.25, 3).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaves = bisect_locally(x, 0.8)
    assert sorted(np.concatenate(leaves)) == list(range(500))
    assert all((x[rows] @ x[rows[0]] >= 0.8).all() for rows in leaves)


@pytest.mark.parametrize("cap", [50, 8192])
def test_clusters_against_brute_force(spark, cap):
    rng = np.random.default_rng(5)
    c = np.linalg.qr(rng.normal(size=(DIM, DIM)))[0][:6]
    x = np.concatenate([c[i] + 0.15 * rng.normal(size=(n, DIM)) / 4 for i, n in enumerate((150, 80, 30, 10, 3, 1))]).astype(np.float32)
    label = np.repeat(np.arange(6), (150, 80, 30, 10, 3, 1))
    order = rng.permutation(len(x))
    rows = [(int(i), blob(x[i] * 2), "k") for i in order] + [(0, blob(x[0] * 2), "k"), (900, None, "k"), (901, b"zz", "k"), (None, blob(x[0]), "k")]
    df = spark.createDataFrame(rows, "id long, vector binary, cluster string")
    made = BisectingClusters(df, "id", "vector", DIM, min_cos=0.7, local_cap=cap)
    got: dict = {}
    for r in made.members.collect():
        got.setdefault(r.cluster, set()).add(int(r.id))
    assert sorted(map(sorted, got.values())) == sorted(np.flatnonzero(label == k).tolist() for k in range(6))
    report = made.report(3).collect()
    assert sorted(r["size"] for r in report) == [1, 3, 10, 30, 80, 150] and all(len(r.typical_ids) == min(3, r["size"]) or r.leaves > 1 for r in report)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id long, vector binary")
    assert BisectingClusters(df, "id", "vector", DIM).members.count() == 0


def test_joined_leaves_stay_compact(spark):
    """A fan of directions, each like its neighbours only: leaves are not chained together."""
    rng = np.random.default_rng(6)
    angle = np.repeat(np.linspace(0, np.pi * 0.9, 10), 40)
    x = np.zeros((400, DIM), np.float32)
    x[:, 0], x[:, 1] = np.cos(angle), np.sin(angle)
    x += (0.01 * rng.normal(size=x.shape)).astype(np.float32)
    df = spark.createDataFrame([(f"{i:04d}", blob(v)) for i, v in enumerate(x)], "id string, vector binary")
    made = BisectingClusters(df, "id", "vector", DIM, min_cos=0.8, local_cap=30)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = made.members.collect()
    assert sorted(r.id for r in rows) == sorted(f"{i:04d}" for i in range(400))
    assert min(float(u[int(r.id)] @ u[int(r.cluster)]) for r in rows) >= 0.8 - 1e-6
    assert 2 <= len({r.cluster for r in rows}) < made.leaves.select("leaf").distinct().count()
