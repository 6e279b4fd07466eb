"""Set distances of point clouds in numpy, for Arrow batches.

``q`` is one query cloud (points x dim); ``p`` are the points of many documents,
one document behind another, document k from ``starts[k]``. Every function gives
one number per document. Point sets are never empty.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from vectide.functions.vectors import CLAMPED, PLAIN, SCAN, Kernel, SubspaceSpec


def sub_distances(q: np.ndarray, p: np.ndarray, spec: SubspaceSpec, kernel: Kernel) -> np.ndarray:
    """parts x query points x points: the kernel's distance in each subspace."""
    a = q.reshape(len(q), spec.parts, spec.width).transpose(1, 0, 2)
    b = p.reshape(len(p), spec.parts, spec.width).transpose(1, 2, 0)
    na = np.sqrt((a * a).sum(axis=2))[:, :, None]
    nb = np.sqrt((b * b).sum(axis=1))[:, None, :]
    product = na * nb
    small = ((na < kernel.zero) | (nb < kernel.zero)) if kernel.by_norm else product < kernel.zero
    cos = np.matmul(a, b) / np.where(small, 1.0, product + kernel.eps)
    if kernel.clip:
        cos = np.clip(cos, -1.0, 1.0)
    d = 1.0 - cos
    if kernel.floor:
        d = np.maximum(d, 0.0)
    return np.where(small, 1.0, d)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _two_sided(d: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Last two axes query points x points: mean of minima both ways, added."""
    there = np.minimum.reduceat(d, starts, axis=-1).mean(axis=-2)
    back = np.add.reduceat(d.min(axis=-2), starts, axis=-1) / _sizes(starts, d.shape[-1])
    return there + back


def pair_first(q, p, starts, spec, kernel=CLAMPED):
    """Chamfer of the mean subspace distance."""
    return _two_sided(sub_distances(q, p, spec, kernel).mean(axis=0), starts)


def scan_pair_first(q, p, starts, spec, kernel=SCAN):
    return pair_first(q, p, starts, spec, kernel)


def subspace_first(q, p, starts, spec, kernel=PLAIN):
    """Mean over the subspaces of the Chamfer distance in each."""
    return _two_sided(sub_distances(q, p, spec, kernel), starts).mean(axis=0)


def subspace_minima(q, p, starts, spec, kernel=PLAIN, piece: int | None = None):
    """For query clouds of any size, taken in pieces of points: parts x query points x
    documents the least distances, and parts x points those over the whole query."""
    piece = piece or max(1, (1 << 19) // max(1, len(p)))
    least, back = [], None
    for at in range(0, len(q), piece):
        d = sub_distances(q[at : at + piece], p, spec, kernel)
        least.append(np.minimum.reduceat(d, starts, axis=2))
        near = d.min(axis=1)
        back = near if back is None else np.minimum(back, near)
    return np.concatenate(least, axis=1), back


def subspace_first_pieces(q, p, starts, spec, kernel=PLAIN, piece: int | None = None):
    """``subspace_first`` with the query in pieces, minima and sums merged exactly."""
    least, back = subspace_minima(q, p, starts, spec, kernel, piece)
    return (least.mean(axis=1) + np.add.reduceat(back, starts, axis=1) / _sizes(starts, len(p))).mean(axis=0)


#: Sub-vectors of smaller norms are not measured by ``unit_distances``.
SMALL = 1 / 32
#: How far ``unit_distances`` may lie from ``subspace_first`` with the plain kernel: twice its
#: 1e-8 by the least product of norms, 1.1e-5, and twice the rounding of sums in single precision, 1.2e-6.
TOLERANCE = 3e-5
#: Document points and query points of a block of products: 2 MB, which the caches hold.
ROWS, COLS = 256, 1920


def units(p: np.ndarray, spec: SubspaceSpec) -> tuple[np.ndarray, np.ndarray]:
    """Points x parts x width in single precision, each sub-vector of norm 1, and which points have a smaller one than ``SMALL``."""
    x = p.reshape(len(p), spec.parts, spec.width)
    norms = np.sqrt((x * x).sum(axis=2))
    odd = ~((norms >= SMALL) & (norms < np.inf)).all(axis=1)
    return (x / np.where(odd[:, None], 1.0, norms)[:, :, None]).astype(np.float32), odd


def unit_groups(queries: list[np.ndarray], spec: SubspaceSpec) -> tuple[list[tuple[np.ndarray, int, np.ndarray]], list[int]]:
    """(numbers of the queries, points of each, parts x points x width x queries) of
    groups of queries of as many points, and the queries that have a point of a small norm."""
    made = [units(q, spec) for q in queries]
    by: dict[int, list[int]] = {}
    for j, (u, odd) in enumerate(made):
        if not odd.any():
            by.setdefault(len(u), []).append(j)
    groups = []
    for m, js in sorted(by.items()):
        room = max(1, COLS // m)
        for at in range(0, len(js), room):
            part = js[at : at + room]
            together = np.stack([made[j][0] for j in part])  # queries x points x parts x width
            groups.append((np.asarray(part), m, np.ascontiguousarray(together.transpose(2, 1, 3, 0))))
    return groups, [j for j, (_, odd) in enumerate(made) if odd.any()]


def unit_distances(docs: np.ndarray, n: int, group: tuple[np.ndarray, int, np.ndarray], back_only: bool = False) -> np.ndarray:
    """Documents x queries of a group: ``subspace_first`` of documents of n points each, within
    ``TOLERANCE``. ``docs`` is parts x (n x documents) x width. With ``back_only`` its second
    half alone, the mean of each document point's least distances.

    Products lie as query points x document points x documents x queries, so that all
    reductions run along long rows."""
    js, m, q = group
    parts, rows, _ = docs.shape
    wide, step = len(js), max(1, COLS // len(js))
    across = rows // n * wide
    room = np.empty(min(m, step) * rows * wide, dtype=np.float32)
    there = np.zeros((m, across), dtype=np.float32)
    back = np.zeros((n, across), dtype=np.float32)
    for s in range(parts):
        most = None
        for at in range(0, m, step):
            end = min(m, at + step)
            cos = room[: (end - at) * rows * wide].reshape(end - at, rows, wide)
            np.matmul(docs[s], q[s, at:end], out=cos)
            if not back_only:
                there[at:end] += cos.reshape(end - at, n, across).max(axis=1)
            near = cos.reshape(end - at, n, across).max(axis=0)
            most = near if most is None else np.maximum(most, near)
        back += most
    value = 1 - back.sum(axis=0, dtype=np.float64) / (n * parts)
    if not back_only:
        value += 1 - there.sum(axis=0, dtype=np.float64) / (m * parts)
    return value.reshape(-1, wide)


def query_to_cloud(q, p, starts, spec, kernel=PLAIN):
    """One query vector: mean over the subspaces of nearest plus mean distance."""
    d = sub_distances(q[:1], p, spec, kernel)[:, 0, :]
    return (np.minimum.reduceat(d, starts, axis=1) + np.add.reduceat(d, starts, axis=1) / _sizes(starts, d.shape[1])).mean(axis=0)


def cloud_to_centroid(q, p, starts, spec, kernel=PLAIN):
    """Each document's centroid: mean over the subspaces of mean plus least distance."""
    centre = np.add.reduceat(p, starts, axis=0) / _sizes(starts, len(p))[:, None]
    d = sub_distances(q, centre, spec, kernel)
    return (d.mean(axis=1) + d.min(axis=1)).mean(axis=0)


def centroid_cosine(q, p, starts, spec, kernel=CLAMPED):
    """Full cosine distance, within [0, 2], of the query's first vector and the document's centroid."""
    centre = np.add.reduceat(p, starts, axis=0) / _sizes(starts, len(p))[:, None]
    return np.clip(sub_distances(q[:1], centre, SubspaceSpec(1, q.shape[1]), kernel)[0, 0], 0.0, 2.0)


def max_point_cosine(q, p, starts, spec, kernel=PLAIN):
    """As a similarity: largest over query points of the mean subspace cosine with the
    document's representative, the mean of its three points farthest from the centroid."""
    rep = np.stack([far_points(x, 3) for x in np.split(p, starts[1:])])
    return (1.0 - sub_distances(q, rep, spec, kernel)).mean(axis=0).max(axis=0)


def far_points(x: np.ndarray, k: int) -> np.ndarray:
    """Mean of the k points of the largest cosine distance to the centroid (ties: first)."""
    d = sub_distances(x.mean(axis=0)[None, :], x, SubspaceSpec(1, x.shape[1]), CLAMPED)[0, 0]
    return x[np.argsort(-d, kind="stable")[:k]].mean(axis=0)


def sampled_chamfer(q, p, starts, spec, kernel=PLAIN, n: int = 3):
    """Subspace-first Chamfer of at most n evenly spaced points of either side."""
    pick = lambda x: x[np.unique(np.minimum((np.arange(n) * len(x)) // n, len(x) - 1))] if len(x) > n else x
    parts = [pick(x) for x in np.split(p, starts[1:])]
    return subspace_first(pick(q), np.concatenate(parts), np.cumsum([0, *[len(x) for x in parts[:-1]]]), spec, kernel)


def plain_chamfer(q, p, starts, spec, kernel=CLAMPED):
    """Chamfer of the full cosine distance."""
    return _two_sided(sub_distances(q, p, SubspaceSpec(1, q.shape[1]), kernel)[0], starts)


def unaligned(q, p, starts, spec, kernel=PLAIN, most: int | None = None):
    """Chamfer of all sub-vectors as points, whatever their subspace; with ``most`` of a
    document's first ``most`` points only."""
    if most is not None:
        place = np.arange(len(p)) - np.repeat(starts, _sizes(starts, len(p)))
        p, starts = p[place < most], np.concatenate([[0], np.cumsum(np.minimum(_sizes(starts, len(p)), most))[:-1]])
    a, b = q.reshape(-1, spec.width), p.reshape(-1, spec.width)
    return _two_sided(sub_distances(a, b, SubspaceSpec(1, spec.width), kernel)[0], starts * spec.parts)


def max_sim(q, p, starts, spec, kernel=None):
    """Late interaction, as a similarity: sum over query points of the largest product."""
    return np.maximum.reduceat(q @ p.T, starts, axis=1).sum(axis=0)


def max_sim_distance(q, p, starts, spec, kernel=CLAMPED):
    """1 less the mean over query points of the largest cosine."""
    d = sub_distances(q, p, SubspaceSpec(1, q.shape[1]), kernel)[0]
    return np.minimum.reduceat(d, starts, axis=1).mean(axis=0)


def symmetric_max_sim_distance(q, p, starts, spec, kernel=CLAMPED):
    return plain_chamfer(q, p, starts, spec, kernel) / 2


def header_chamfer(q, p, starts, spec, kernel=CLAMPED):
    """One-sided: from the query's points only."""
    d = sub_distances(q, p, spec, kernel).mean(axis=0)
    return np.minimum.reduceat(d, starts, axis=1).mean(axis=0)


def density_weights(x: np.ndarray, k: int, spec: SubspaceSpec) -> np.ndarray:
    """1 / (mean distance of the k nearest other points + 1e-8), adding to 1."""
    n = len(x)
    if n <= 1:
        return np.ones(n)
    d = sub_distances(x, x, spec, PLAIN).mean(axis=0)
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, axis=1)[:, : min(k, n - 1)].mean(axis=1)
    w = 1.0 / (near + 1e-8)
    return w / w.sum() if w.sum() > 1e-8 else w


def density_chamfer(q, p, starts, spec, kernel=PLAIN, near: int = 3, weight_query: bool = False):
    """Subspace-first Chamfer in which document points count by their density."""
    d = sub_distances(q, p, spec, kernel)
    w = np.concatenate([density_weights(x, near, spec) for x in np.split(p, starts[1:])])
    there = np.minimum.reduceat(d, starts, axis=2)
    there = (there * density_weights(q, near, spec)[None, :, None]).sum(axis=1) if weight_query else there.mean(axis=1)
    back = np.add.reduceat(d.min(axis=1) * w[None, :], starts, axis=1)
    return (there + back).mean(axis=0)


def _by_subspace(q, p, starts, spec, kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the query's first vector, parts x points its distances, and parts x documents
    the least and the mean of them."""
    d = sub_distances(q[:1], p, spec, kernel)[:, 0, :]
    return d, np.minimum.reduceat(d, starts, axis=1), np.add.reduceat(d, starts, axis=1) / _sizes(starts, d.shape[1])


def softmax_dual(q, p, starts, spec, kernel=PLAIN, temperature: float = 0.1):
    """Subspaces count by the softmax of their best similarity: the weighted sum of nearest plus mean distance."""
    _, least, mean = _by_subspace(q, p, starts, spec, kernel)
    best = 1 - least
    w = np.exp((best - best.max(axis=0)) / temperature)
    return (w * (least + mean)).sum(axis=0) / w.sum(axis=0)


def hierarchical_dual(q, p, starts, spec, kernel=PLAIN, near: int = 8, share: float = 0.7):
    """``share`` of the aligned distance of the query's first vector, the rest of its
    agreement between subspaces: each subspace is the point of its distances to the
    document's points, and the root of its least distance times the mean least distance
    of the ``near`` subspaces nearest to it (L2, ties: smaller number) is averaged."""
    d, least, mean = _by_subspace(q, p, starts, spec, kernel)
    aligned, other = (least + mean).mean(axis=0), np.zeros(len(starts))
    near = min(near, spec.parts - 1)
    for k, x in enumerate(np.split(d, starts[1:], axis=1) if near else []):
        apart = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, np.inf)
        around = least[np.argsort(apart, axis=1, kind="stable")[:, :near], k].mean(axis=1)
        other[k] = np.sqrt(np.maximum(least[:, k] * around, 0)).mean()
    return share * aligned + (1 - share) * other


def _moments(p: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = _sizes(starts, len(p))[:, None]
    mean = np.add.reduceat(p, starts, axis=0) / n
    spread = (p - np.repeat(mean, n[:, 0], axis=0)) ** 2
    return mean, np.add.reduceat(spread, starts, axis=0) / n


def diagonal_fid(q, p, starts, spec, kernel=None, weight: float = 0.5, spread: str = "variance", scale: float = 1.0):
    """Squared distance of the means plus ``weight * scale`` times that of the variances,
    or with ``spread="std"`` of the standard deviations. ``scale`` brings both terms to one
    size: see ``clouds.fid_scale``."""
    mean, var = _moments(p, starts)
    out = ((mean - q.mean(axis=0)) ** 2).sum(axis=1)
    if weight:
        mine = q.var(axis=0)
        apart = np.sqrt(var) - np.sqrt(mine) if spread == "std" else var - mine
        out = out + weight * scale * (apart**2).sum(axis=1)
    return out


def diagonal_fid_document(q, p, starts, spec, kernel=None, weight: float = 0.5, scale: float = 1.0):
    """The variant named after the document's spread: squared difference of the two standard deviations."""
    return diagonal_fid(q, p, starts, spec, kernel, weight, "std", scale)


def _point_cosines(q, p):
    return 1 - sub_distances(q[:1], p, SubspaceSpec(1, q.shape[1]), CLAMPED)[0, 0]


def _top_mean(x, starts, k):
    return np.array([np.sort(c)[::-1][:k].mean() for c in np.split(x, starts[1:])])


def shape_boost(q, p, starts, spec, kernel=None, share: float = 0.6):
    """As a similarity: ``share`` of the centroid's cosine, the rest of the largest and the three largest point cosines."""
    s = _point_cosines(q, p)
    points = 0.5 * np.maximum.reduceat(s, starts) + 0.5 * _top_mean(s, starts, 3)
    return share * (1 - centroid_cosine(q, p, starts, spec)) + (1 - share) * points


def mixed_field(q, p, starts, spec, kernel=None, share: float = 0.7):
    """As a similarity: ``share`` of the largest and the rest of the mean point cosine."""
    s = _point_cosines(q, p)
    return share * np.maximum.reduceat(s, starts) + (1 - share) * np.add.reduceat(s, starts) / _sizes(starts, len(s))


def code_difference(q, p, starts, spec, kernel=None):
    """Points are code words: mean over query points of the least number of differing codes."""
    d = (q[:, None, :] != p[None, :, :]).sum(axis=2)
    return np.minimum.reduceat(d, starts, axis=1).mean(axis=0)


METRICS: dict[str, Callable] = {
    f.__name__: f
    for f in (
        pair_first, scan_pair_first, subspace_first, subspace_first_pieces, query_to_cloud, cloud_to_centroid, plain_chamfer, unaligned, max_sim, max_sim_distance,
        symmetric_max_sim_distance, header_chamfer, centroid_cosine, max_point_cosine, sampled_chamfer, diagonal_fid, diagonal_fid_document, shape_boost, mixed_field, code_difference, density_chamfer, softmax_dual, hierarchical_dual,
    )
}
#: Metrics of which more is better.
SIMILARITIES = {"max_sim", "max_point_cosine", "shape_boost", "mixed_field"}


# -- many queries at once: ``q`` holds their points one behind another, ``qs`` where each begins --
def _two_sided_many(d: np.ndarray, qs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Last two axes all query points x points: queries x documents as ``_two_sided``."""
    there = np.add.reduceat(np.minimum.reduceat(d, starts, axis=-1), qs, axis=-2) / _sizes(qs, d.shape[-2])[:, None]
    back = np.add.reduceat(np.minimum.reduceat(d, qs, axis=-2), starts, axis=-1) / _sizes(starts, d.shape[-1])
    return there + back


def _full(q, p, kernel=CLAMPED):
    return sub_distances(q, p, SubspaceSpec(1, q.shape[1]), kernel)[0]


def _centres(p, starts):
    return np.add.reduceat(p, starts, axis=0) / _sizes(starts, len(p))[:, None]


def _firsts(d, starts):
    """Nearest plus mean distance of single vectors."""
    return np.minimum.reduceat(d, starts, axis=-1) + np.add.reduceat(d, starts, axis=-1) / _sizes(starts, d.shape[-1])


def _per_query(d, qs):
    return np.add.reduceat(d, qs, axis=-2) / _sizes(qs, d.shape[-2])[:, None]


def _to_centres(q, qs, p, starts, spec):
    d = sub_distances(q, _centres(p, starts), spec, PLAIN)
    return (_per_query(d, qs) + np.minimum.reduceat(d, qs, axis=-2)).mean(axis=0)


#: Metrics that a block of queries is measured with in one go: queries x documents.
TOGETHER: dict[str, Callable] = {
    "pair_first": lambda q, qs, p, starts, spec: _two_sided_many(sub_distances(q, p, spec, CLAMPED).mean(axis=0), qs, starts),
    "scan_pair_first": lambda q, qs, p, starts, spec: _two_sided_many(sub_distances(q, p, spec, SCAN).mean(axis=0), qs, starts),
    "subspace_first": lambda q, qs, p, starts, spec: _two_sided_many(sub_distances(q, p, spec, PLAIN), qs, starts).mean(axis=0),
    "plain_chamfer": lambda q, qs, p, starts, spec: _two_sided_many(_full(q, p), qs, starts),
    "symmetric_max_sim_distance": lambda q, qs, p, starts, spec: _two_sided_many(_full(q, p), qs, starts) / 2,
    "max_sim": lambda q, qs, p, starts, spec: np.add.reduceat(np.maximum.reduceat(q @ p.T, starts, axis=1), qs, axis=0),
    "max_sim_distance": lambda q, qs, p, starts, spec: _per_query(np.minimum.reduceat(_full(q, p), starts, axis=1), qs),
    "header_chamfer": lambda q, qs, p, starts, spec: _per_query(np.minimum.reduceat(sub_distances(q, p, spec, CLAMPED).mean(axis=0), starts, axis=1), qs),
    "query_to_cloud": lambda q, qs, p, starts, spec: _firsts(sub_distances(q[qs], p, spec, PLAIN), starts).mean(axis=0),
    "cloud_to_centroid": _to_centres,
    "centroid_cosine": lambda q, qs, p, starts, spec: np.clip(_full(q[qs], _centres(p, starts)), 0.0, 2.0),
}


def cloud_matrix(points: list[np.ndarray], spec: SubspaceSpec, metric: str = "subspace_first", **options) -> np.ndarray:
    """Symmetric matrix of the distances (or similarities) of a query's candidates among each other."""
    flat = np.concatenate(points)
    starts = np.cumsum([0, *[len(x) for x in points[:-1]]])
    out = np.stack([METRICS[metric](x, flat, starts, spec, **options) for x in points])
    out = (out + out.T) / 2
    np.fill_diagonal(out, 0.0)
    return out
