"""The graph of a shard against brute force."""

import numpy as np
import pytest

from vectide.operators import hnsw

DIM = 16


def topics(n, k, spread, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(k, DIM))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(0, k, n)] + spread * rng.normal(size=(n, DIM)) / np.sqrt(DIM)
    return (x * rng.uniform(0.5, 3, size=(n, 1))).astype(np.float32)


def test_top_of_rows_is_exact():
    rng = np.random.default_rng(0)
    for n in (3, 255, 1024, 1500):
        s = rng.integers(0, 50, size=(7, n)).astype(np.float32)
        cols, values = hnsw.top_of_rows(s, 9)
        assert (values == -np.sort(-s, axis=1)[:, :9]).all()
        assert (np.take_along_axis(s, cols.astype(int), axis=1) == values).all()


def test_graph_round_trip_and_recall():
    x = topics(3000, 12, 0.4, 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.build(x, np.arange(3000, dtype=np.uint64), 8)
    g = hnsw.Graph.unpack(*g.pack().values())
    q = topics(300, 12, 0.4, 1)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    found, _ = g.search(q, 5, ef=32)
    exact = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, exact)]) > 0.95
    own, sims = g.search(x[:300], 5, ef=32, own=np.arange(300))
    exact = np.argsort(-(x[:300] @ x.T), axis=1)[:, :6]
    assert (own != np.arange(300)[:, None]).all() and (np.diff(sims, axis=1) <= 0).all()
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(own, exact)]) > 0.95


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_tiny_graphs(n):
    x = np.eye(DIM, dtype=np.float32)[:n]
    g = hnsw.Graph.build(x, np.arange(n, dtype=np.uint64), 4)
    found, _ = g.search(np.eye(DIM, dtype=np.float32)[:2], 5)
    assert ((found >= 0).sum(axis=1) == min(n, 5)).all()
    if n:
        own, _ = g.search(x, 5, own=np.arange(n))
        assert own.shape == (n, 5) and ((own >= 0).sum(axis=1) == min(n - 1, 5)).all()
