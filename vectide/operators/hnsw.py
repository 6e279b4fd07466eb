"""One shard's hierarchical navigable small-world graph, as flat arrays.

Vectors are unit length, so similarity is the inner product. Every node gets a
top level from a hash of its key (geometric, 1/``M`` of the nodes per level).
A level's links are the diversity-pruned nearest nodes of that level, then made
mutual. A shard is small and of fixed size, so the candidates for links are found by
blocked matrix products, all nodes at once, instead of one greedy insertion after
another: the links that insertion finds with an unbounded beam. They serve for links
only; every result comes from a search.
``nbr[level]`` is a flat ``n_level x degree`` int32 array, -1 where empty.

A search runs with a beam of ``ef`` on level 0, many queries at once: a member's begins
at its own node, any other vector's at the entry found from the top level downwards.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
GROUPS = 256
#: Nodes of an upper level that a search may look at whole.
SCAN = 2048


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def top_of_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of each row's k largest entries, descending, exactly.

    Columns are folded into groups first: the k largest entries lie in the k
    groups of largest maximum, so only those are looked at one by one.
    """
    b, n = scores.shape
    k = min(k, n)
    folds = n // GROUPS
    if folds >= 4 and k * 4 <= GROUPS:
        body = folds * GROUPS
        peak = scores[:, :body].reshape(b, folds, GROUPS).max(axis=1)
        groups = np.argpartition(peak, GROUPS - k, axis=1)[:, GROUPS - k :]
        cols = (groups[:, :, None] + (np.arange(folds) * GROUPS)[None, None, :]).reshape(b, -1)
        if body < n:
            cols = np.concatenate([cols, np.broadcast_to(np.arange(body, n), (b, n - body))], axis=1)
        values = np.take_along_axis(scores, cols, axis=1)
    else:
        cols, values = np.broadcast_to(np.arange(n), (b, n)), scores
    if values.shape[1] > k:
        part = np.argpartition(values, values.shape[1] - k, axis=1)[:, -k:]
        cols, values = np.take_along_axis(cols, part, axis=1), np.take_along_axis(values, part, axis=1)
    order = np.lexsort((cols, -values), axis=1)
    return np.take_along_axis(cols, order, axis=1).astype(np.int32), np.take_along_axis(values, order, axis=1)


def nearest_within(vecs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row the k most similar other rows, exactly; -1 where there are fewer."""
    n = len(vecs)
    ids = np.full((n, k), -1, dtype=np.int32)
    sims = np.full((n, k), -2.0, dtype=np.float32)
    flip = np.ascontiguousarray(vecs.T)
    room = np.empty((BLOCK, n), dtype=np.float32)
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        scores = np.matmul(vecs[at:end], flip, out=room[: end - at])
        scores[np.arange(end - at), np.arange(at, end)] = -3.0
        cols, values = top_of_rows(scores, min(k, n))
        real = values > -2.5
        ids[at:end, : cols.shape[1]] = np.where(real, cols, -1)
        sims[at:end, : cols.shape[1]] = np.where(real, values, -2.0)
    return ids, sims


def diverse(vecs: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates (nearest first) those nearer to it than to any
    link already kept, at most ``degree``; the rest fills up what stays free."""
    n, c = cand.shape
    out = np.full((n, degree), -1, dtype=np.int32)
    for at in range(0, n, BLOCK):
        ids, s = cand[at : at + BLOCK], sims[at : at + BLOCK]
        x = vecs[np.maximum(ids, 0)]
        among = np.matmul(x, x.transpose(0, 2, 1))
        keep = np.zeros(ids.shape, dtype=bool)
        for j in range(c):
            blocked = ((among[:, j, :] > s[:, j : j + 1]) & keep).any(axis=1)
            keep[:, j] = ~blocked & (ids[:, j] >= 0)
        rank = np.where(keep, 0, c) + np.arange(c) + np.where(ids < 0, 2 * c, 0)
        order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
        out[at : at + BLOCK, : order.shape[1]] = np.take_along_axis(ids, order, axis=1)
    return out


def mutual(nbr: np.ndarray, degree: int) -> np.ndarray:
    """Adds the reverse of every link while the other end has room for it."""
    n, d = nbr.shape
    src = np.repeat(np.arange(n, dtype=np.int32), d)
    dst = nbr.ravel()
    rank = np.tile(np.arange(d, dtype=np.int32), n)
    ok = dst >= 0
    src, dst, rank = src[ok], dst[ok], rank[ok]
    heads, tails = np.concatenate([src, dst]), np.concatenate([dst, src])
    pref = np.concatenate([rank * 2, rank * 2 + 1])
    key = heads.astype(np.int64) * n + tails
    _, first = np.unique(key, return_index=True)
    heads, tails, pref = heads[first], tails[first], pref[first]
    order = np.lexsort((pref, heads))
    heads, tails = heads[order], tails[order]
    start = np.searchsorted(heads, np.arange(n))
    slot = np.arange(len(heads)) - start[heads]
    out = np.full((n, degree), -1, dtype=np.int32)
    fits = slot < degree
    out[heads[fits], slot[fits]] = tails[fits]
    return out


class Graph:
    """``levels[l]`` are the nodes of level l (level 0: all), ``nbr[l]`` their links
    as positions in ``levels[l]``."""

    def __init__(self, vecs: np.ndarray, levels: list[np.ndarray], nbr: list[np.ndarray]) -> None:
        self.vecs, self.levels, self.nbr = vecs, levels, nbr

    @classmethod
    def build(cls, vecs: np.ndarray, keys: np.ndarray, m: int = 16) -> Graph:
        """The graph of unit vectors; ``keys`` give every node its top level."""
        n = len(vecs)
        u = (mix64(keys) >> np.uint64(11)).astype(np.float64) / 2.0**53
        top = np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(m)).astype(int)
        levels, nbr = [np.arange(n, dtype=np.int32)], []
        while len(levels[-1]) > m:
            upper = np.flatnonzero(top >= len(levels)).astype(np.int32)
            if not len(upper):
                break
            levels.append(upper)
        for level, nodes in enumerate(levels):
            x = vecs if level == 0 else vecs[nodes]
            ids, near = nearest_within(x, 2 * m if level == 0 else m)
            nbr.append(mutual(diverse(x, ids, near, m), 2 * m if level == 0 else m))
        return cls(vecs, levels, nbr)

    def search(self, q: np.ndarray, k: int, ef: int = 48, step: int = 4, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of about the k most similar nodes of each query; -1
        where none. With ``own`` the queries are these nodes, which are no results."""
        out_i, out_s = np.full((len(q), k), -1, np.int32), np.full((len(q), k), -2.0, np.float32)
        n = len(self.vecs)
        if n and len(q):
            at_once = max(32, min(1024, (16 << 20) // n))
            for at in range(0, len(q), at_once):
                i, s = self._search(q[at : at + at_once], k, min(ef, n), step, None if own is None else own[at : at + at_once])
                out_i[at : at + at_once, : i.shape[1]], out_s[at : at + at_once, : s.shape[1]] = i, s
        return out_i, out_s

    def _entry(self, q: np.ndarray) -> np.ndarray:
        """Up to four starts on level 0 for each query, -1 where fewer.

        The lowest upper level of at most ``SCAN`` nodes is looked at whole, so
        that groups without a link between them are all within reach; levels
        below it are descended greedily from the best of its nodes.
        """
        level = next((k for k in range(1, len(self.levels)) if len(self.levels[k]) <= SCAN), len(self.levels) - 1)
        if level == 0:
            return np.zeros((len(q), 1), dtype=np.int32)
        nodes = self.levels[level]
        cols, scores = top_of_rows(q @ self.vecs[nodes].T, 4)
        starts = nodes[cols]
        at, best = starts[:, 0].copy(), scores[:, 0].copy()
        level -= 1
        while level > 0:
            nodes, links = self.levels[level], self.nbr[level]
            moving = np.arange(len(q))
            while len(moving):
                where = np.searchsorted(nodes, at[moving])
                near = links[where]
                ids = nodes[np.maximum(near, 0)]
                s = np.einsum("bmd,bd->bm", self.vecs[ids], q[moving])
                s[near < 0] = -3.0
                j = s.argmax(axis=1)
                top = s[np.arange(len(j)), j]
                better = top > best[moving]
                moving, ids, j, top = moving[better], ids[better], j[better], top[better]
                at[moving], best[moving] = ids[np.arange(len(j)), j], top
            level -= 1
        starts[:, 0] = at
        return starts

    def _search(self, q: np.ndarray, k: int, ef: int, step: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        b, n, links = len(q), len(self.vecs), self.nbr[0]
        beam = np.full((b, ef), -1, dtype=np.int32)
        sims = np.full((b, ef), -3.0, dtype=np.float32)
        fresh = np.zeros((b, ef), dtype=bool)
        entry = self._entry(q) if own is None else own[:, None]
        seen = np.zeros(b * n, dtype=np.int32)
        for k_ in range(min(entry.shape[1], ef)):
            key = np.arange(b) * n + entry[:, k_]
            new = seen[key] == 0
            seen[key] = -1
            beam[new, k_], fresh[new, k_] = entry[new, k_], True
            sims[new, k_] = np.einsum("bd,bd->b", self.vecs[entry[new, k_]], q[new])
        rows = np.arange(b)
        while len(rows):
            f = fresh[rows]
            pick = np.argsort(~f, axis=1, kind="stable")[:, :step]  # the beam is sorted: the best unexpanded
            real = np.take_along_axis(f, pick, axis=1)
            nodes = np.take_along_axis(beam[rows], pick, axis=1)
            f[np.arange(len(rows))[:, None], pick] = False
            near = np.where(real[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(len(rows), -1)
            r, c = np.nonzero(near >= 0)
            ids = near[r, c]
            key = rows[r].astype(np.int64) * n + ids
            new = seen[key] == 0
            r, c, ids, key = r[new], c[new], ids[new], key[new]
            stamp = np.arange(1, len(key) + 1, dtype=np.int32)
            seen[key] = stamp  # of equal keys the last stays: it alone goes on
            one = seen[key] == stamp
            r, c, ids = r[one], c[one], ids[one]
            s = np.full(near.shape, -3.0, dtype=np.float32)
            s[r, c] = np.einsum("pd,pd->p", self.vecs[ids], q[rows[r]])
            all_s = np.concatenate([sims[rows], s], axis=1)
            all_i = np.concatenate([beam[rows], near], axis=1)
            all_f = np.concatenate([f, s > -2.5], axis=1)
            best = np.argpartition(all_s, all_s.shape[1] - ef, axis=1)[:, -ef:]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_s, best, axis=1), axis=1), axis=1)
            sims[rows] = np.take_along_axis(all_s, best, axis=1)
            beam[rows] = np.take_along_axis(all_i, best, axis=1)
            now = np.take_along_axis(all_f, best, axis=1)
            fresh[rows] = now
            rows = rows[now.any(axis=1)]
        if own is not None:
            sims[beam == own[:, None]] = -3.0
            order = np.argsort(-sims, axis=1, kind="stable")
            beam, sims = np.take_along_axis(beam, order, axis=1), np.take_along_axis(sims, order, axis=1)
        k = min(k, ef)
        none = sims[:, :k] < -2.5
        return np.where(none, -1, beam[:, :k]), np.where(none, -2.0, sims[:, :k])

    def pack(self) -> dict[str, bytes]:
        """The flat arrays, for a table."""
        sizes = np.array([len(x) for x in self.levels], dtype=np.int32)
        degrees = np.array([x.shape[1] for x in self.nbr], dtype=np.int32)
        return {
            "vecs": self.vecs.astype(np.float32).tobytes(),
            "sizes": sizes.tobytes(),
            "degrees": degrees.tobytes(),
            "members": b"".join(x.tobytes() for x in self.levels[1:]),
            "links": b"".join(x.tobytes() for x in self.nbr),
        }

    @classmethod
    def unpack(cls, vecs: bytes, sizes: bytes, degrees: bytes, members: bytes, links: bytes) -> Graph:
        sizes_, degrees_ = np.frombuffer(sizes, np.int32), np.frombuffer(degrees, np.int32)
        n = int(sizes_[0])
        x = np.frombuffer(vecs, np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)
        flat_m, flat_l = np.frombuffer(members, np.int32), np.frombuffer(links, np.int32)
        levels, nbr, m, at = [np.arange(n, dtype=np.int32)], [], 0, 0
        for level, (size, degree) in enumerate(zip(sizes_, degrees_)):
            if level:
                levels.append(flat_m[m : m + size])
                m += size
            nbr.append(flat_l[at : at + size * degree].reshape(size, degree))
            at += size * degree
        return cls(x, levels, nbr)
