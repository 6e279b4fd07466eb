"""Iterative solvers on one query's candidate graph (a few hundred nodes), in numpy.

``w`` is a dense weight matrix, 0 where there is no edge. All updates read the
old state only. Every function returns the final field.
"""

from __future__ import annotations

import numpy as np


def knn_weights(dist: np.ndarray, k: int, beta: float = 2.0) -> np.ndarray:
    """The k nearest others of each node (ties: smaller number), weight exp(-beta d); missing reverse edges added."""
    n = len(dist)
    w = np.zeros((n, n))
    if n < 2 or k <= 0:
        return w
    d = dist.copy()
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, n - 1)]
    rows = np.repeat(np.arange(n), near.shape[1])
    w[rows, near.ravel()] = np.exp(-beta * dist[rows, near.ravel()])
    return np.where(w > 0, w, w.T)


def laplacian(c: np.ndarray, w: np.ndarray, alpha: float = 0.02, steps: int = 20) -> np.ndarray:
    """c += alpha * weighted mean difference to the neighbours, not below 0."""
    degree = w.sum(axis=1)
    safe = np.where(degree > 0, degree, 1.0)
    for _ in range(steps):
        c = np.maximum(c + alpha * np.where(degree > 0, (w @ c - degree * c) / safe, 0.0), 0.0)
    return c


def advection_diffusion(c: np.ndarray, w: np.ndarray, u: np.ndarray, diffusion: float = 0.15, most: int = 50, eps: float = 1e-3) -> np.ndarray:
    """Upwind scheme; the step is min(0.1, 0.8 / largest number of neighbours); stops when no node moves by eps."""
    if not len(c):
        return c
    links = int((w > 0).sum(axis=1).max())
    dt = min(0.1, 0.8 / links) if links else 0.1
    out, into = np.maximum(u, 0) * w, np.minimum(u, 0) * w
    degree = w.sum(axis=1)
    for _ in range(most):
        new = c + dt * (diffusion * (w @ c - degree * c) - out.sum(axis=1) * c - into @ c)
        new = np.maximum(new, 0.0)
        moved = np.abs(new - c).max()
        c = new
        if moved < eps:
            break
    return c


def _reaction(c: np.ndarray, gamma: float) -> np.ndarray:
    return gamma * c * (1 - c) * (c - c.mean())


def token_gradient(c: np.ndarray, w: np.ndarray, potential: np.ndarray, beta: float = 1.0, diffusion: float = 0.15, gamma: float = 0.5, dt: float = 0.1, most: int = 50, eps: float = 1e-3) -> np.ndarray:
    """Flow up the potential with diffusion and a two-state reaction, within [0, 1]."""
    if not len(c):
        return c
    u = beta * (potential[None, :] - potential[:, None])
    speed, degree = (np.abs(u) * w).sum(axis=1).max(), w.sum(axis=1).max()
    bound = diffusion * degree + speed
    dt = min(dt, 0.8 / bound) if bound > 0 else dt
    gain, loss = np.maximum(-u, 0) * w, (np.maximum(u, 0) * w).sum(axis=1)
    total = w.sum(axis=1)
    for _ in range(most):
        new = np.clip(c + dt * (diffusion * (w @ c - total * c) + gain @ c - loss * c + _reaction(c, gamma)), 0, 1)
        moved = np.abs(new - c).max()
        c = new
        if moved < eps:
            break
    return c


def allen_cahn(c: np.ndarray, w: np.ndarray, alpha: float = 0.02, gamma: float = 0.5, steps: int = 30, eps: float = 1e-3) -> np.ndarray:
    """Normalised Laplacian plus the two-state reaction, within [0, 1]."""
    degree = w.sum(axis=1)
    safe = np.where(degree > 0, degree, 1.0)
    for _ in range(steps):
        new = np.clip(c + alpha * (np.where(degree > 0, (w @ c - degree * c) / safe, 0.0) + _reaction(c, gamma)), 0, 1) if len(c) else c
        moved = np.abs(new - c).max() if len(c) else 0.0
        c = new
        if moved < eps:
            break
    return c


def advection_field(query: np.ndarray, centres: np.ndarray, w: np.ndarray, alpha: float = 0.3) -> np.ndarray:
    """u_ij = alpha <c_j - c_i, q/|q|> / (|c_j - c_i| + 1e-8) on edges, antisymmetric."""
    q = query / (np.linalg.norm(query) + 1e-8)
    along = centres @ q
    gap = np.sqrt(np.maximum(0.0, ((centres[None, :, :] - centres[:, None, :]) ** 2).sum(axis=2)))
    u = alpha * (along[None, :] - along[:, None]) / (gap + 1e-8)
    return np.where((w > 0) | (w.T > 0), u, 0.0)


def helmholtz_kalman(token: np.ndarray, graph: np.ndarray, w: np.ndarray, variance: np.ndarray, beta: float = 1.0) -> np.ndarray:
    """Token score plus the smoothed part of the graph score that it does not explain,
    by a gain that weighs token variance against disagreement in the graph."""
    tt = token @ token
    rest = graph - (graph @ token / tt if tt > 1e-12 else 0.0) * token
    degree = w.sum(axis=1)
    root = np.where(degree > 1e-12, 1 / np.sqrt(np.where(degree > 1e-12, degree, 1.0)), 0.0)
    lap = -root[:, None] * w * root[None, :]
    np.fill_diagonal(lap, (degree > 1e-12).astype(float))
    try:
        smooth = np.linalg.solve(np.eye(len(token)) + beta * lap, rest)
    except np.linalg.LinAlgError:
        smooth = rest
    spread = (w * (graph[None, :] - graph[:, None]) ** 2).sum(axis=1)
    spread = np.maximum(np.where(degree > 1e-12, spread / np.where(degree > 1e-12, degree, 1.0), 1e-10), 1e-10)
    gain = spread / (np.maximum(variance, 1e-10) + spread)
    return token + (1 - gain) * smooth


def unnormalised(c: np.ndarray, w: np.ndarray, alpha: float = 0.15, steps: int = 5) -> np.ndarray:
    """C <- (I - alpha L) C with W = max(W, W')."""
    w = np.maximum(w, w.T)
    lap = np.diag(w.sum(axis=1)) - w
    for _ in range(steps):
        c = c - alpha * (lap @ c)
    return c


def directed(c: np.ndarray, w: np.ndarray, alpha: float = 0.15, steps: int = 5) -> np.ndarray:
    """Row-normalised smoothing along out-edges only: w is not made symmetric."""
    degree = w.sum(axis=1)
    p = w / np.where(degree > 0, degree, 1.0)[:, None]
    for _ in range(steps):
        c = np.where(degree > 0, (1 - alpha) * c + alpha * (p @ c), c)
    return c


def convex_mix(s: np.ndarray, w: np.ndarray, alpha: float = 0.15, steps: int = 1) -> np.ndarray:
    """(1 - alpha) s + alpha * neighbours' mean, against the first scores."""
    degree = w.sum(axis=1)
    p = w / np.where(degree > 0, degree, 1.0)[:, None]
    c = s
    for _ in range(steps):
        c = (1 - alpha) * s + alpha * (p @ c)
    return c


def min_max_field(x: np.ndarray) -> np.ndarray:
    """Scaled to [0, 1]; 0.5 where all are equal."""
    if not len(x):
        return x
    span = x.max() - x.min()
    return (x - x.min()) / span if span > 1e-8 else np.full(len(x), 0.5)


def reaction_diffusion(w: np.ndarray, potential: np.ndarray, diffusion: float = 0.2, gamma: float = 0.5, tau: float = 0.2, steps: int = 20, eps: float = 1e-3) -> np.ndarray:
    """Transport along edges, i to j at w exp((phi_j - phi_i) / tau), and a two-state
    reaction whose threshold is the median of the start field, the scaled potential. The
    step is 0.9 over the largest outflow and the reaction's rate."""
    c = min_max_field(potential)
    if not len(c):
        return c
    t = w * np.exp((potential[None, :] - potential[:, None]) / tau)
    away = t.sum(axis=1)
    theta, dt = np.median(c), 0.9 / (diffusion * away.max() + gamma + 1e-8)
    for _ in range(steps):
        new = np.clip(c + dt * (diffusion * (t.T @ c - away * c) + gamma * c * (1 - c) * (c - theta)), 0, 1)
        moved = np.abs(new - c).max()
        c = new
        if moved < eps:
            break
    return c


def otsu(values: np.ndarray) -> float:
    """The split of the sorted values with the largest variance between both parts: the
    middle of the gap there. Of more than 30 values some thirty splits are tried."""
    s = np.sort(values)
    n = len(s)
    if n < 2:
        return float(s[0]) if n and s[0] else 0.5
    at = np.arange(1, n, max(1, n // 30))
    total = np.cumsum(s)
    low, high = total[at - 1] / at, (total[-1] - total[at - 1]) / (n - at)
    best = at[int(((at / n) * (1 - at / n) * (low - high) ** 2).argmax())]
    return float((s[best - 1] + s[best]) / 2)


def bounded_reaction(c: np.ndarray, w: np.ndarray, u: np.ndarray, rate: float = 1.0, diffusion: float = 0.15, most: int = 80, eps: float = 5e-3) -> np.ndarray:
    """Advection-diffusion with a reaction between the field's first least and largest
    values, about their Otsu threshold and sharper the narrower they lie; the field stays
    within them."""
    if not len(c):
        return c
    low, high = c.min(), c.max()
    sharp, theta = rate / (high - low + 1e-6) ** 2, otsu(c)
    links = int((w > 0).sum(axis=1).max())
    dt = min(0.05, 0.8 / links if links else 0.05, 1 / (rate * 0.25 + 1e-8))
    out, into, degree = (np.maximum(u, 0) * w).sum(axis=1), np.maximum(u.T, 0) * w, w.sum(axis=1)
    for _ in range(most):
        new = np.clip(c + dt * (diffusion * (w @ c - degree * c) + into @ c - out * c + sharp * (c - low) * (high - c) * (c - theta)), low, high)
        moved = np.abs(new - c).max()
        c = new
        if moved < eps:
            break
    return c


def spread_of(c: np.ndarray) -> float:
    return float(c.max() - c.min()) if len(c) else 0.0
