"""Set distances, solvers and literal cases."""

import itertools
import math

import numpy as np
import pytest

from vectide.functions.vectors import CLAMPED, LOOKUP, PLAIN, SCAN, SubspaceSpec
from vectide.operators import adaptive, expansion, kernels, linalg, quantize, solvers

SPEC = SubspaceSpec(4, 3)


def cloud(seed, n):
    return np.array([[math.sin((i + seed + 7 * j) * 0.37) for i in range(SPEC.dim)] for j in range(n)])


def slow_kernel(a, b, kernel):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    if (na < kernel.zero or nb < kernel.zero) if kernel.by_norm else na * nb < kernel.zero:
        return 1.0
    cos = float(a @ b) / (na * nb + kernel.eps)
    cos = min(1.0, max(-1.0, cos)) if kernel.clip else cos
    return max(0.0, 1 - cos) if kernel.floor else 1 - cos


def slow_sub(q, p, s, kernel):
    w = SPEC.width
    return [[slow_kernel(a[s * w : (s + 1) * w], b[s * w : (s + 1) * w], kernel) for b in p] for a in q]


def two_sided(m):
    m = np.array(m)
    return m.min(axis=1).mean() + m.min(axis=0).mean()


@pytest.mark.parametrize("kernel", [PLAIN, CLAMPED, SCAN, LOOKUP])
def test_chamfer_forms_against_loops(kernel):
    q = cloud(3, 3)
    q[0, :3] = 0  # a zero sub-vector
    docs = [cloud(s, n) for s, n in ((10, 1), (20, 4), (31, 2))]
    docs[1][2] = 0
    p, starts = np.concatenate(docs), np.array([0, 1, 5])
    got_sub = kernels.subspace_first(q, p, starts, SPEC, kernel)
    got_pair = kernels.pair_first(q, p, starts, SPEC, kernel)
    for k, d in enumerate(docs):
        each = [slow_sub(q, d, s, kernel) for s in range(SPEC.parts)]
        assert got_sub[k] == pytest.approx(np.mean([two_sided(m) for m in each]), abs=1e-9)
        assert got_pair[k] == pytest.approx(two_sided(np.mean(each, axis=0)), abs=1e-9)


@pytest.mark.parametrize("metric", ["subspace_first", "pair_first", "plain_chamfer", "unaligned"])
def test_identity_and_symmetry(metric):
    a, b = cloud(30, 2), cloud(50, 3)
    f, one = kernels.METRICS[metric], np.zeros(1, int)
    assert f(a, a, one, SPEC)[0] == pytest.approx(0, abs=1e-4)
    assert f(a, b, one, SPEC)[0] == pytest.approx(f(b, a, one, SPEC)[0], abs=1e-6)
    assert 0 <= f(a, b, one, SPEC)[0] <= 4


def test_single_point_cloud_equals_its_centroid():
    q, d, one = cloud(1, 3), cloud(9, 1), np.zeros(1, int)
    assert kernels.cloud_to_centroid(q, d, one, SPEC)[0] == pytest.approx(kernels.subspace_first(q, d, one, SPEC)[0])


def test_order_of_points_does_not_matter():
    q, d, one = cloud(1, 4), cloud(9, 5), np.zeros(1, int)
    for name, f in kernels.METRICS.items():
        if name in ("query_to_cloud", "centroid_cosine", "sampled_chamfer", "shape_boost", "mixed_field", "softmax_dual", "hierarchical_dual"):  # the first vector asks, or points are picked
            continue
        assert f(q, d, one, SPEC)[0] == pytest.approx(f(q[::-1], d[::-1], one, SPEC)[0]), name


def test_lookup_equals_reconstruction():
    """A lookup of codes is the distance to the rebuilt points."""
    q, book = cloud(2, 2), cloud(40, 5)
    codes = np.array([[0, 1, 2, 3], [4, 4, 0, 1]])
    rebuilt = np.stack([np.concatenate([book[c, s * 3 : s * 3 + 3] for s, c in enumerate(row)]) for row in codes])
    d = np.array([[[slow_kernel(a[s * 3 : s * 3 + 3], book[c, s * 3 : s * 3 + 3], LOOKUP) for c in codes[:, s]] for a in q] for s in range(4)])
    assert kernels.subspace_first(q, rebuilt, np.zeros(1, int), SPEC, LOOKUP)[0] == pytest.approx(np.mean([two_sided(m) for m in d]))


def test_knn_symmetrised():
    d = np.array([[0, 1, 5, 2], [1, 0, 1.5, 4], [5, 1.5, 0, 1], [2, 4, 1, 0.0]])
    w = solvers.knn_weights(d, 2)
    assert set(np.flatnonzero(w[0])) == {1, 3}
    assert (w == w.T).all() and w[0, 1] == pytest.approx(math.exp(-2))


def ring(n):
    w = np.zeros((n, n))
    for i in range(n):
        w[i, (i + 1) % n] = w[(i + 1) % n, i] = 1.0
    return w


def test_uniform_field_stays():
    c, w = np.ones(4), ring(4)
    np.testing.assert_allclose(solvers.laplacian(c, w, 0.1, 10), 1)
    np.testing.assert_allclose(solvers.advection_diffusion(c, w, np.zeros((4, 4))), 1, atol=1e-6)


def test_smoothing_lowers_variance_and_isolated_nodes_stay():
    w = np.zeros((4, 4))
    w[0, 1] = w[1, 0] = w[1, 2] = w[2, 1] = 1
    c = np.array([10.0, 0, 0, 7])
    out = solvers.laplacian(c, w, 0.2, 5)
    assert out[:3].var() < c[:3].var() and out[3] == 7


def test_strong_advection_is_not_negative():
    w, u = ring(3), np.zeros((3, 3))
    u[0, 1] = u[2, 1] = 2.0
    u[1, 0] = u[1, 2] = -2.0
    assert (solvers.advection_diffusion(np.array([1.0, 0.2, 0.1]), w, u, 0.01, 100) >= 0).all()


def slow_advection_diffusion(c, w, u, diffusion, most, eps):
    n, c = len(c), list(c)
    links = max(sum(1 for x in row if x > 0) for row in w)
    dt = min(0.1, 0.8 / links) if links else 0.1
    for _ in range(most):
        old, moved = list(c), 0
        for i in range(n):
            diff = adv = 0.0
            for j in range(n):
                if w[i][j] > 0:
                    diff += w[i][j] * (old[j] - old[i])
                    adv -= u[i][j] * (old[i] if u[i][j] > 0 else old[j]) * w[i][j]
            c[i] = max(0.0, old[i] + dt * (diffusion * diff + adv))
            moved = max(moved, abs(c[i] - old[i]))
        if moved < eps:
            break
    return c


def test_advection_diffusion_against_loops():
    rng = np.random.default_rng(1)
    d = rng.random((9, 9)) + 0.1
    d = (d + d.T) / 2
    w = solvers.knn_weights(d, 3)
    u = solvers.advection_field(rng.normal(size=5), rng.normal(size=(9, 5)), w)
    c = rng.random(9)
    np.testing.assert_allclose(u, -u.T, atol=1e-12)
    np.testing.assert_allclose(solvers.advection_diffusion(c, w, u), slow_advection_diffusion(c, w, u, 0.15, 50, 1e-3), atol=1e-12)


def test_token_gradient_attracts_and_allen_cahn_is_bounded():
    w = ring(3)
    out = solvers.token_gradient(np.full(3, 0.5), w, np.array([0.1, 0.5, 0.9]), beta=2.0, gamma=0.0)
    assert out[2] >= out[0]
    c = solvers.allen_cahn(np.array([0.0, 0.4, 1.0]), w, 0.3, 2.0)
    assert (c >= 0).all() and (c <= 1).all()


def test_kalman_of_equal_signals_is_the_signal():
    s = np.array([0.9, 0.5, 0.1])
    np.testing.assert_allclose(solvers.helmholtz_kalman(s, s, ring(3), np.full(3, 0.01)), s, atol=1e-6)


def test_empty_and_single_fields():
    for f in (solvers.laplacian, solvers.allen_cahn, solvers.unnormalised, solvers.directed, solvers.convex_mix):
        assert len(f(np.zeros(0), np.zeros((0, 0)))) == 0
        np.testing.assert_allclose(f(np.array([0.4]), np.zeros((1, 1))), [0.4], atol=0.3)
    assert solvers.knn_weights(np.zeros((1, 1)), 3).sum() == 0


def test_projection_and_spectrum():
    x = np.array([1.0, 2.0, 3.0])
    p, coef, rest = linalg.orthogonal_projection(x, [[1, 0, 0], [2, 0, 0], [0, -1, 0]])
    np.testing.assert_allclose(p, [1, 2, 0])
    np.testing.assert_allclose(coef, [1, 2])
    assert rest == pytest.approx(3)
    m = linalg.projection_matrix(64, 16)
    assert m.shape == (16, 64) and (linalg.projection_matrix(64, 16) == m).all() and abs(m.mean()) < 0.02


def test_bits_add_up():
    for total in (8, 16, 30, 48):
        bits = quantize.allocate_bits([1.0, 4.0, 0.25, 0.0], total)
        assert sum(bits) == min(max(total, 16), 48) and bits[1] >= bits[0] >= bits[2]
    assert quantize.allocate_bits([1.0, 1.0, 1.0], 24) == [8, 8, 8]
    assert quantize.allocate_bits([4.0, 1.0], 16) == [10, 6]  # 8 + 1.5 log2(v / 2.5): 9.02 and 6.02, one short
    assert quantize.allocate_bits([4.0, 1.0], 16, inverse=True) == [6, 10]


def test_otsu_and_diagnosis():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x = rng.random(int(rng.integers(2, 30)))
        s, best = np.sort(x), (-1, 0)
        for t in range(1, len(s)):
            v = t / len(s) * (1 - t / len(s)) * (s[:t].mean() - s[t:].mean()) ** 2
            best = max(best, (v, -t))
        t = -best[1]
        assert solvers.otsu(x) == pytest.approx((s[t - 1] + s[t]) / 2)
    assert solvers.otsu(np.zeros(0)) == 0.5 and solvers.otsu(np.array([0.3])) == 0.3
    c = np.array([0.9, 0.88, 0.2, 0.15])
    assert expansion.diagnose(c, 0.5) == "C-type"
    assert expansion.diagnose(np.array([1.0, 0.4, 0.29, -0.2]), 0.35) == "A-type"
    assert expansion.diagnose(np.linspace(0, 1, 30), 0.5) == "smooth"


def test_shape_flow_settings():
    rng = np.random.default_rng(3)
    f = {"points": [rng.normal(size=(int(rng.integers(1, 5)), 16)) for _ in range(12)], "qp": rng.normal(size=(3, 16))}
    seen = set()
    for name, o in expansion.PRESETS.items():
        r = expansion.shape_flow(f, o)
        assert r.c.shape == (12,) and ((r.c >= 0) & (r.c <= 1)).all() and len(r.topology) == 12, name
        seen |= set(r.topology)
    assert seen <= {"convergence", "divergence", "stagnation", "flow"}
    assert expansion._adapted(expansion.Flow(adaptive=True, reaction=True), f["qp"]).most == 100
    assert expansion._adapted(expansion.Flow(adaptive=True, reaction=True), f["qp"][:1]).most == 40
    assert expansion.shape_v5_ensemble(f).shape == (12,)
    one = {"points": f["points"][:1], "qp": f["qp"]}
    assert expansion.shape_flow(one, expansion.PRESETS["full"]).c.shape == (1,)


def test_linucb_inverse_is_exact():
    rng = np.random.default_rng(0)
    b, a = adaptive.LinUCB(1, 3), np.eye(3)
    for _ in range(20):
        x = rng.normal(size=3)
        b.update(0, x, 1.0)
        a += np.outer(x, x)
    np.testing.assert_allclose(b.inv[0], np.linalg.inv(a), atol=1e-9)


def test_drift_alarm_and_reset():
    d = adaptive.Drift(0.1, 0.0, 1.0)
    alarms = [d.add(0.3)[1] for _ in range(8)]
    assert alarms == [False, False, False, True, False, False, False, True]


def test_unaligned_of_the_first_points():
    rng = np.random.default_rng(2)
    q, p, starts = rng.normal(size=(2, SPEC.dim)), rng.normal(size=(9, SPEC.dim)), np.array([0, 5, 6])
    cut = np.concatenate([p[:2], p[5:6], p[6:8]])
    np.testing.assert_allclose(kernels.unaligned(q, p, starts, SPEC, most=2), kernels.unaligned(q, cut, np.array([0, 2, 3]), SPEC))


def test_many_queries_at_once_equal_one_by_one():
    rng = np.random.default_rng(8)
    queries = [rng.normal(size=(n, SPEC.dim)) for n in (1, 3, 2, 5)]
    queries[1][0] = 0
    p, starts = rng.normal(size=(9, SPEC.dim)), np.array([0, 2, 3, 7])
    p[2, :3] = 0
    qs = np.cumsum([0, *[len(q) for q in queries[:-1]]])
    for name, f in kernels.TOGETHER.items():
        got = f(np.concatenate(queries), qs, p, starts, SPEC)
        np.testing.assert_allclose(got, np.stack([kernels.METRICS[name](q, p, starts, SPEC) for q in queries]), atol=1e-12, err_msg=name)


def test_all_metrics_give_one_value_a_document():
    q, p, starts = cloud(1, 2), cloud(5, 6), np.array([0, 2, 3])
    for name, f in kernels.METRICS.items():
        assert f(q, p, starts, SPEC).shape == (3,), name
    assert len(list(itertools.islice(linalg.mulberry32(42), 3))) == 3
