"""Concentration-field rankers on centroid graphs, and pools that grow while they are ranked."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import SubspaceSpec
from vectide.operators import retrieval, scan, solvers
from vectide.operators.kernels import METRICS, cloud_matrix
from vectide.operators.linalg import uniform_projections


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-8)


def _flow(query: np.ndarray, docs: np.ndarray, k: int, strength: float, diffusion: float, most: int, eps: float) -> np.ndarray:
    """Cosine field on the cosine graph, carried towards the query, within [0, 1]."""
    sims = _unit(docs) @ _unit(docs).T
    w = solvers.knn_weights(1 - sims, k)
    u = solvers.advection_field(query, docs, w, strength)
    c = _unit(docs) @ _unit(query)
    links = int((w > 0).sum(axis=1).max()) if len(c) else 0
    dt = min(0.1, 0.8 / links) if links else 0.1
    gain, loss = np.maximum(u.T, 0) * w, (np.maximum(u, 0) * w).sum(axis=1)
    degree = w.sum(axis=1)
    for _ in range(most):
        new = np.clip(c + dt * (diffusion * (w @ c - degree * c) + gain @ c - loss * c), 0, 1)
        moved = np.abs(new - c).max() if len(c) else 0.0
        c = new
        if moved < eps:
            break
    return c


def ad_rank(f: dict, k: int = 3, strength: float = 0.3, diffusion: float = 0.15, most: int = 50, eps: float = 1e-3) -> np.ndarray:
    return _flow(f["q"], np.stack([p.mean(axis=0) for p in f["points"]]), k, strength, diffusion, most, eps)


def _weighted(fields: list[np.ndarray], lengths: list[float]) -> np.ndarray:
    """Fields by the share of the query's length in each."""
    total = sum(lengths) or 1.0
    return sum(n / total * c for n, c in zip(lengths, fields))


def ad_rank_projected(f: dict, heads: int = 8, width: int = 32, seed: int = 42) -> np.ndarray:
    """Several random projections, weighted by the query's length in each."""
    docs = np.stack([p.mean(axis=0) for p in f["points"]])
    fields, lengths = [], []
    for m in uniform_projections(heads, width, docs.shape[1], seed):
        q = m @ f["q"]
        fields.append(_flow(q, docs @ m.T, 3, 0.3, 0.15, 50, 1e-3))
        lengths.append(float(np.linalg.norm(q)))
    return _weighted(fields, lengths)


def ad_rank_blocks(f: dict, blocks: int = 8) -> np.ndarray:
    """Contiguous blocks of dimensions, the last with what is left over, weighted by the query's length in each."""
    docs = np.stack([p.mean(axis=0) for p in f["points"]])
    size = docs.shape[1] // blocks
    cuts = [np.arange(i * size, docs.shape[1] if i == blocks - 1 else (i + 1) * size) for i in range(blocks)]
    return _weighted([_flow(f["q"][b], docs[:, b], 3, 0.3, 0.15, 50, 1e-3) for b in cuts], [float(np.linalg.norm(f["q"][b])) for b in cuts])


def diagnose(c: np.ndarray, theta: float) -> str:
    """How the scores part at ``theta``: ``C-type`` if the gap is over 0.02 and over 0.3 of
    the wider side's spread, ``A-type`` if it is over 0.1, else ``smooth``."""
    above, below = c[c >= theta], c[c < theta]
    gap = (above.min() if len(above) else theta) - (below.max() if len(below) else theta)
    wide = max(np.ptp(above) if len(above) else 0.0, np.ptp(below) if len(below) else 0.0)
    return "C-type" if gap > 0.02 and gap > 0.3 * wide else "A-type" if gap > 0.1 else "smooth"


def diagnosis(scores: DataFrame, theta: str = "theta", group: str = "query_id", score: str = "score") -> DataFrame:
    """``group, above, below, gap, type``: ``diagnose`` of every group as aggregates."""
    up = F.col(score) >= F.col(theta)
    low = F.min(F.when(up, F.col(score)))
    ends = scores.groupBy(group).agg(
        F.first(theta).alias("theta"), F.count(F.when(up, 1)).alias("above"), F.count(F.when(~up, 1)).alias("below"), low.alias("a0"), F.max(F.when(up, F.col(score))).alias("a1"),
        F.min(F.when(~up, F.col(score))).alias("b0"), F.max(F.when(~up, F.col(score))).alias("b1"),
    )
    gap = F.coalesce("a0", "theta") - F.coalesce("b1", "theta")
    wide = F.greatest(F.coalesce(F.col("a1") - F.col("a0"), F.lit(0.0)), F.coalesce(F.col("b1") - F.col("b0"), F.lit(0.0)))
    kind = F.when((gap > 0.02) & (gap > 0.3 * wide), "C-type").when(gap > 0.1, "A-type").otherwise("smooth")
    return ends.select(group, "above", "below", gap.alias("gap"), kind.alias("type"))


@dataclass(frozen=True)
class Flow:
    """Settings of ``shape_flow``. ``start``: ``chamfer`` or ``max_sim``; ``cutoff``: edges
    shorter than this carry nothing, ``auto`` for the fifth percentile; ``theta``: the
    reaction's threshold, ``fixed`` at the start field's mean, ``dynamic`` (the mean now)
    or ``ema``; ``adaptive``: diffusion, strength, steps and gamma by the query's cloud."""

    start: str = "chamfer"
    cutoff: float | str | None = None
    reaction: bool = False
    theta: str = "fixed"
    adaptive: bool = False
    diffusion: float = 0.15
    strength: float = 0.1
    gamma: float = 0.5
    most: int = 80
    eps: float = 5e-3
    neighbours: int = 3
    dt: float = 0.05
    metric: str = "plain_chamfer"
    ema: float = 0.1


_ALL = {"start": "max_sim", "cutoff": "auto", "reaction": True}
#: The named settings.
PRESETS = {
    "maxsim": Flow(start="max_sim"),
    "cutoff": Flow(start="max_sim", cutoff="auto"),
    "allen-cahn": Flow(**_ALL),
    "adaptive": Flow(**_ALL, adaptive=True),
    "full": Flow(**_ALL, adaptive=True, theta="ema"),
    "reaction-only": Flow(reaction=True),
    "cutoff-only": Flow(cutoff="auto"),
    "maxsim-reaction": Flow(start="max_sim", reaction=True),
}
#: Of the ensemble: diffusion, strength, gamma.
ENSEMBLE = ((0.2, 0.05, 0.2), (0.15, 0.1, 0.5), (0.1, 0.15, 0.8))


@dataclass
class Solved:
    """A settled field with what is known of the flow."""

    c: np.ndarray
    topology: list[str]
    iterations: int
    converged: bool
    reynolds: float
    peclet: float
    damkohler: float
    kind: str


def _adapted(o: Flow, cloud: np.ndarray) -> Flow:
    spread = np.max(1 - _unit(cloud) @ _unit(cloud).T) if len(cloud) > 1 else 0.0
    if len(cloud) >= 3 or spread > 0.4:
        return replace(o, diffusion=0.1, strength=0.15, most=100, gamma=0.8 if o.reaction else o.gamma)
    if len(cloud) <= 1 and spread < 0.15:
        return replace(o, diffusion=0.2, strength=0.05, most=40, gamma=0.2 if o.reaction else o.gamma)
    return o


def shape_flow(f: dict, o: Flow = Flow()) -> Solved:
    """Field of the query's cloud on the candidates' graph: diffusion, flow along the
    query's centroid and, if asked, a two-state reaction, within [0, 1]."""
    cloud = f["qp"] if "qp" in f else f["q"][None, :]
    if o.adaptive:
        o = _adapted(o, cloud)
    spec = SubspaceSpec(1, cloud.shape[1])
    flat, starts = np.concatenate(f["points"]), np.cumsum([0, *[len(p) for p in f["points"][:-1]]])
    w = solvers.knn_weights(cloud_matrix(f["points"], spec, o.metric), o.neighbours)
    c = np.exp(-2 * METRICS["max_sim_distance" if o.start == "max_sim" else "plain_chamfer"](cloud, flat, starts, spec))
    centres = np.stack([p.mean(axis=0) for p in f["points"]])
    u = solvers.advection_field(cloud.mean(axis=0), centres, w, o.strength)
    edges = np.triu((w > 0) | (w.T > 0), 1)
    if o.cutoff is not None and edges.any():
        gap = ((centres[None, :, :] - centres[:, None, :]) ** 2).sum(axis=2)
        if o.cutoff == "auto":
            lengths = np.sort(gap[edges & (gap > 0)])
            least = lengths[int(len(lengths) * 0.05)] if len(lengths) else 0.0
        else:
            least = float(o.cutoff) ** 2
        u = np.where(gap < least, 0.0, u)
    links = int((w > 0).sum(axis=1).max()) if len(c) else 0
    dt = min(o.dt, 0.8 / links) if links else o.dt
    out, into, degree = (np.maximum(u, 0) * w).sum(axis=1), np.maximum(u.T, 0) * w, w.sum(axis=1)
    level, converged, step = float(c.mean()), False, 0
    carried = spread_ = 0.0
    for step in range(1, o.most + 1):
        if o.reaction and step > 1:
            level = {"fixed": level, "dynamic": c.mean(), "ema": o.ema * c.mean() + (1 - o.ema) * level}[o.theta]
        diffusion, advection = o.diffusion * (w @ c - degree * c), into @ c - out * c
        reaction = o.gamma * c * (1 - c) * (c - level) if o.reaction else 0.0
        carried, spread_ = float(np.abs(advection).sum()), float(np.abs(diffusion).sum())
        new = np.clip(c + dt * (diffusion + advection + reaction), 0, 1)
        moved = np.abs(new - c).max()
        c = new
        if moved < o.eps:
            converged = True
            break
    turning = (u * w) @ c
    rate = np.abs(o.diffusion * (w @ c - degree * c) + into @ c - out * c)
    topology = np.where(turning < -0.01, "convergence", np.where(turning > 0.01, "divergence", np.where(rate < 10 * o.eps, "stagnation", "flow"))).tolist()
    speed = float(np.abs(u[edges]).mean()) if edges.any() else 0.0
    ratio = lambda a, b: a / b if b > 1e-12 else 0.0
    return Solved(c, topology, step, converged, ratio(carried, spread_), ratio(speed, o.diffusion), ratio(o.gamma, o.diffusion), diagnose(c, level))


def shape_v5(f: dict, preset: str = "allen-cahn") -> np.ndarray:
    return shape_flow(f, PRESETS[preset]).c


def shape_v5_ensemble(f: dict, preset: str = "allen-cahn") -> np.ndarray:
    """Of three settings that settle the field with the widest scores; the preset's own if none does."""
    runs = [shape_flow(f, replace(PRESETS[preset], diffusion=d, strength=s, gamma=g)) for d, s, g in ENSEMBLE]
    settled = [r.c for r in runs if r.converged]
    return max(settled, key=solvers.spread_of) if settled else shape_v5(f, preset)


def shape_report(cands: DataFrame, preset: str = "full") -> DataFrame:
    """``query_id, doc_id, score, topology`` and the query's ``iterations, converged,
    reynolds, peclet, damkohler, kind``; ``cands`` as for ``graph.solve_by_query`` with qp."""
    kind = dict(cands.dtypes)["doc_id"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        f = {"points": [np.asarray(p, float) for p in table.column("points").to_pylist()], "qp": np.asarray(table.column("qp")[0].as_py(), float)}
        s = shape_flow(f, PRESETS[preset])
        n = table.num_rows
        each = {"iterations": pa.array([s.iterations] * n, pa.int32()), **{k: [getattr(s, k)] * n for k in ("converged", "reynolds", "peclet", "damkohler", "kind")}}
        return pa.table({"query_id": table.column("query_id"), "doc_id": table.column("doc_id"), "score": s.c, "topology": s.topology, **each})

    schema = f"query_id bigint, doc_id {kind}, score double, topology string, iterations int, converged boolean, reynolds double, peclet double, damkohler double, kind string"
    return cands.select("query_id", "doc_id", "points", "qp").groupBy("query_id").applyInArrow(run, schema)


# -- growing pools ---------------------------------------------------------------------
@dataclass(frozen=True)
class Growth:
    """How a pool grows while it is ranked. ``start``: its first documents by ``centroid``
    cosine or a ``scan`` of pair-first distances; ``probe``: a search by ``vector``,
    0.7 q + 0.3 of a document's centroid (``unit``: of the unit query), or by the document's
    whole ``cloud``; ``metric``: of the graph and the field; ``flux``: a document's pressure
    to grow from, ``boundary`` (towards the query) or ``outward`` (along the flow); a query
    stops when its largest flux is under ``least`` of that of its first round."""

    first: int = 30
    budget: int = 60
    rounds: int = 3
    probes: int = 8
    neighbours: int = 3
    start: str = "centroid"
    probe: str = "vector"
    unit: bool = False
    metric: str = "pair_first"
    flux: str = "boundary"
    least: float = 0.1


def flux_of(o: Growth, f: dict, c: np.ndarray, w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Pressure of every node; 0 for well linked ones and those not above the (upper) median."""
    if o.flux == "outward":
        drive = (np.maximum(u, 0) * w) @ c
    else:
        q = f["q"] / (np.linalg.norm(f["q"]) + 1e-8)
        drive = np.array([(q - p.mean(axis=0)) @ q for p in f["points"]])
    out = c * np.maximum(drive, 0)
    out[((w > 0).sum(axis=1) >= 2 * o.neighbours) | (c <= np.sort(c)[len(c) >> 1])] = 0
    return out


def _settled(c: retrieval.Corpus, o: Growth, pool: DataFrame) -> DataFrame:
    """``query_id, doc_id, c, flux`` of a pool (query_id, doc_id, c0) carried along the query's vector."""
    from vectide.operators import graph

    rows, spec = retrieval.fetch(c, pool.select("query_id", "doc_id"), pool), c.spec
    kind = dict(rows.dtypes)["doc_id"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        f = {"points": [np.asarray(p, float) for p in table.column("points").to_pylist()], "q": np.asarray(table.column("q")[0].as_py(), float)}
        w = graph.graph_of(f, spec, o.neighbours, o.metric)
        u = solvers.advection_field(f["q"], np.stack([p.mean(axis=0) for p in f["points"]]), w)
        field = solvers.advection_diffusion(np.array(table.column("c0").to_pylist(), float), w, u)
        return pa.table({"query_id": table.column("query_id"), "doc_id": table.column("doc_id"), "c": field, "flux": flux_of(o, f, field, w, u)})

    return rows.select("query_id", "doc_id", "c0", "points", "q").groupBy("query_id").applyInArrow(run, f"query_id bigint, doc_id {kind}, c double, flux double")


def _probed(c: retrieval.Corpus, o: Growth, state: DataFrame, most: DataFrame) -> DataFrame:
    """``query_id, doc_id`` of new documents: the probes of each query in order of flux take
    their nearest unknown ones, an equal share of what the budget leaves each."""
    from vectide.operators.clouds import mean_of

    top = scan.top_k(state.where("flux > 0"), o.probes, "flux", ascending=False)
    live = top.where("rank = 1").join(most, "query_id").where(F.col("flux") >= o.least * F.col("first_flux")).select("query_id")
    size = state.groupBy("query_id").agg((F.lit(o.budget) - F.count("*")).alias("left")).where("left > 0").join(live, "query_id")
    top = top.join(size, "query_id").join(c.docs, "doc_id")
    share = F.greatest(F.lit(1), F.ceil(F.col("left") / F.col("m"))).cast("int")
    plan = top.groupBy("query_id").agg(F.first("left").alias("left"), F.count("*").alias("m")).select("query_id", F.col("left").cast("int").alias("left"), share.alias("share"))
    wide = o.probes + 1  # ranks are 1 to o.probes
    name = (F.col("query_id") * wide + F.col("rank")).alias("query_id")
    if o.probe == "cloud":
        asked = top.select(name, "points")
    else:
        q = F.col("q")
        if o.unit:
            norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)) + 1e-8
            q = F.transform("q", lambda x: x / norm)
        moved = F.zip_with(q, mean_of(F.col("points"), c.spec.dim), lambda x, y: 0.7 * x + 0.3 * y)
        asked = top.join(c.queries.select("query_id", F.get("points", F.lit(0)).alias("q")), "query_id").select(name, F.array(moved).alias("points"))
    hits = scan.scan(asked, c.docs, "scan_pair_first" if o.probe == "cloud" else "centroid_cosine", c.spec, 2 * o.budget)
    hits = hits.select(F.floor(F.col("query_id") / wide).alias("query_id"), (F.col("query_id") % wide).alias("probe"), "doc_id", "value")
    fresh = hits.join(state.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").join(plan, "query_id")
    kind = dict(state.dtypes)["doc_id"]

    def take(table: pa.Table) -> pa.Table:
        left, share = table.column("left")[0].as_py(), table.column("share")[0].as_py()
        rows = sorted(zip(table.column("probe").to_pylist(), table.column("value").to_pylist(), table.column("doc_id").to_pylist()))
        taken: dict = {}
        used: dict = {}
        for probe, _, doc in rows:
            if len(taken) < left and used.get(probe, 0) < share and doc not in taken:
                taken[doc] = used[probe] = used.get(probe, 0) + 1
        return pa.table({"query_id": pa.array([table.column("query_id")[0].as_py()] * len(taken), pa.int64()), "doc_id": pa.array(list(taken), table.schema.field("doc_id").type)})

    # a group holds at most probes x 2 budget rows
    return fresh.groupBy("query_id").applyInArrow(take, f"query_id bigint, doc_id {kind}")


def grow(c: retrieval.Corpus, k: int, o: Growth = Growth()) -> DataFrame:
    """``query_id, doc_id, score, rank``: solve, probe beyond the documents under pressure,
    add what is found with its own start value, solve again from the field as it is."""
    from vectide.shared import stored

    alone = c.queries.where("size(points) > 0").withColumn("points", F.slice("points", 1, 1))
    field = "query_to_cloud" if o.metric == "subspace_first" else o.metric

    def start(pairs: DataFrame) -> DataFrame:
        values = scan.pair_values(pairs, alone, c.docs, field, c.spec)
        return values.select("query_id", "doc_id", F.exp(-2 * F.col("value")).alias("c0"))

    first = scan.scan(alone, c.docs, "scan_pair_first" if o.start == "scan" else "centroid_cosine", c.spec, o.first)
    state = stored(_settled(c, o, start(first.select("query_id", "doc_id"))), "pool")
    most = stored(state.groupBy("query_id").agg(F.max("flux").alias("first_flux")), "pool-flux")
    for _ in range(o.rounds):
        new = stored(_probed(c, o, state, most), "pool-new")
        if new.isEmpty():
            break
        grown = new.select("query_id").distinct()
        pool = state.join(grown, "query_id", "left_semi").select("query_id", "doc_id", F.col("c").alias("c0")).unionByName(start(new))
        state = stored(_settled(c, o, pool).unionByName(state.join(grown, "query_id", "left_anti")), "pool")
    return retrieval._ranked(state.select("query_id", "doc_id", F.col("c").alias("score")), k)


def stefan(c: retrieval.Corpus, k: int, first: int = 30, budget: int = 60) -> DataFrame:
    """Three rounds by vector probes, ended by the flux."""
    return grow(c, k, Growth(first=first, budget=budget))


def stefan_clouds(c: retrieval.Corpus, k: int, first: int = 30, budget: int = 60) -> DataFrame:
    """From a scan of all documents, with whole clouds as probes."""
    return grow(c, k, Growth(first=first, budget=budget, start="scan", probe="cloud", least=0.0))


def adjoint_prefetch(c: retrieval.Corpus, k: int, first: int = 30, total: int = 45, metric: str = "pair_first") -> DataFrame:
    """One round of growth along the flow; ``metric="subspace_first"`` for the aligned form."""
    return grow(c, k, Growth(first=first, budget=total, rounds=1, unit=True, metric=metric, flux="outward", least=0.0))


def multigrid(c: retrieval.Corpus, k: int, n: int, disputed: int = 5, neighbours: int = 5) -> DataFrame:
    """Documents whose smoothed and token ranks differ most bring in their nearest
    documents by centroid cosine; all are ranked by the token distance."""
    smooth, token = retrieval.shape_laplacian(c, n, n, 0.15, 5), retrieval.two_stage(c, n, n)
    a, b = smooth.select("query_id", "doc_id", F.col("rank").alias("a")), token.select("query_id", "doc_id", F.col("rank").alias("b"))
    both = a.join(b, ["query_id", "doc_id"]).withColumn("value", F.abs(F.col("a") - F.col("b")).cast("double"))
    hard = scan.top_k(both, disputed, "value", ascending=False)
    from vectide.operators.clouds import mean_of

    wide = disputed + 1
    asked = hard.join(c.docs, "doc_id").select((F.col("query_id") * wide + F.col("rank")).alias("query_id"), F.array(mean_of(F.col("points"), c.spec.dim)).alias("points"))
    near = scan.scan(asked, c.docs, "centroid_cosine", c.spec, neighbours).select(F.floor(F.col("query_id") / wide).alias("query_id"), "doc_id")
    pool = token.select("query_id", "doc_id").unionByName(near).distinct()
    return retrieval.rerank(c, pool, k)
