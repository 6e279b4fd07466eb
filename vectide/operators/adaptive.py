"""Learning the fusion weight of a query: features, ridge, boosted trees, transfer,
a damped fixed point, and sequential learners."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = [round(0.1 * i, 1) for i in range(11)]
#: Features that need no judgements.
FREE = ["a_top", "a_gap", "a_mean", "a_std", "b_top", "b_gap", "b_mean", "b_std", "overlap", "tau", "words"]


def features(a: DataFrame, b: DataFrame, words: DataFrame | None = None, k: int = 10) -> DataFrame:
    """``query_id`` and the features FREE of two runs (query_id, doc_id, score): top score,
    gap to the second, mean and spread of each, share of common documents, rank
    agreement and query length. Nothing of it is known from judgements."""
    from vectide.operators import metrics

    def side(run: DataFrame, p: str) -> DataFrame:
        top = metrics.ranked(run, k)
        return top.groupBy("query_id").agg(
            F.max("score").alias(f"{p}_top"),
            (F.max("score") - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.max("score"))).alias(f"{p}_gap"),
            F.avg("score").alias(f"{p}_mean"),
            F.stddev_pop("score").alias(f"{p}_std"),
        )

    out = side(a, "a").join(side(b, "b"), "query_id").join(metrics.jaccard_at(a, b, k).withColumnRenamed("jaccard", "overlap"), "query_id", "left")
    out = out.join(metrics.kendall(a, b), "query_id", "left")
    out = out.join(words.select("query_id", "words"), "query_id", "left") if words is not None else out.withColumn("words", F.lit(0))
    return out.select("query_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FREE])


def best_lambda(values: DataFrame) -> DataFrame:
    """``query_id, target``: the grid weight of the largest value (query_id, lam, value); of equals the smallest."""
    w = Window.partitionBy("query_id").orderBy(F.desc("value"), "lam")
    return values.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", F.col("lam").alias("target"))


def _assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="keep").transform(rows)


def fit_ridge(train: DataFrame, columns: list[str], penalty: float = 1.0):
    """Standardised ridge regression of ``target``; the penalty is per row."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol="x", labelCol="target", regParam=penalty, elasticNetParam=0.0, standardization=True).fit(_assembled(train, columns))


def fit_trees(train: DataFrame, columns: list[str], trees: int = 200, depth: int = 3, rate: float = 0.05, seed: int = 7, sampled: float = 0.8):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="x", labelCol="target", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=sampled, seed=seed).fit(_assembled(train, columns))


def predict(model, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with ``lam``, the prediction within [0, 1] snapped to the grid."""
    from vectide.functions.vectors import snap

    out = model.transform(_assembled(rows, columns))
    return out.withColumn("lam", snap(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))), GRID)).drop("x", "prediction")


def leave_one_corpus_out(rows: DataFrame, columns: list[str], corpora: list[str], fit=fit_ridge) -> DataFrame:
    """Predictions for each corpus by a model of all the others."""
    out = None
    for name in corpora:
        model = fit(rows.where(F.col("corpus") != name), columns)
        part = predict(model, rows.where(F.col("corpus") == name), columns)
        out = part if out is None else out.unionByName(part)
    return out


def leave_one_feature_out(rows: DataFrame, columns: list[str], fit=fit_ridge, seed: int = 0) -> dict[str, float]:
    """Mean squared error without each feature (and with all, under ``-``), on the half of
    the queries (by a hash) that the model was not fitted on."""
    half = F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(2)) == 0
    train, test, errors = rows.where(half), rows.where(~half), {}
    for left in ["-", *columns]:
        use = [c for c in columns if c != left]
        got = fit(train, use).transform(_assembled(test, use))
        errors[left] = got.agg(F.avg((F.col("prediction") - F.col("target")) ** 2)).first()[0]
    return errors


def hartree(rows: DataFrame, first: float, gain: float, tolerance: float = 0.01, most: int = 50, damping: float = 0.5) -> DataFrame:
    """Self-consistent weight of every query: lam = first + gain * R(lam)^2 within [0, 1],
    R = (1 - lam) * tok + lam * lap, by damped steps from ``first`` until no query's moves
    by ``tolerance``.

    ``rows`` have (query_id, tok, lap); adds ``lam`` and ``snapped``, the nearest weight of
    the grid. The steps are one expression a row; the step at which all have settled comes
    from one aggregate over them."""
    return hartree_grid(rows, [(first, gain)], tolerance, most, damping).drop("first", "gain")


def hartree_grid(rows: DataFrame, settings: list[tuple[float, float]], tolerance: float = 0.01, most: int = 50, damping: float = 0.5) -> DataFrame:
    """The same for several (first, gain), which become columns; each stops on its own."""
    asked = rows.withColumn("g", F.explode(F.array(*[F.struct(F.lit(float(a)).alias("first"), F.lit(float(b)).alias("gain")) for a, b in settings]))).select("*", "g.first", "g.gain").drop("g")

    def step(path: Column, _) -> Column:
        lam = F.element_at(path, -1)
        r = (1 - lam) * F.col("tok") + lam * F.col("lap")
        aim = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("first") + F.col("gain") * r * r))
        return F.concat(path, F.array((1 - damping) * lam + damping * aim))

    paths = asked.withColumn("path", F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(F.col("first")), step))
    moved = paths.groupBy("first", "gain").agg(*[F.max(F.abs(F.element_at("path", i + 2) - F.element_at("path", i + 1))).alias(f"m{i}") for i in range(most)])
    stop = F.coalesce(*[F.when(F.col(f"m{i}") < tolerance, F.lit(i + 1)) for i in range(most)], F.lit(most))
    ends = moved.select("first", "gain", stop.alias("steps"))
    out = paths.join(F.broadcast(ends), ["first", "gain"])  # one row a setting
    grid = F.array(*[F.lit(g) for g in GRID])
    lam = F.element_at("path", F.col("steps") + 1)
    near = F.transform(grid, lambda g: F.struct(F.abs(g - F.col("lam")).alias("d"), g.alias("g")))
    return out.withColumn("lam", lam).withColumn("snapped", F.array_min(near)["g"]).drop("path", "steps")


def best_hartree(rows: DataFrame, values: DataFrame, firsts: list[float], gains: list[float]) -> DataFrame:
    """``first, gain, value`` of every setting, best first: the mean over queries of the
    value (``query_id, lam, value``) at the snapped weight."""
    solved = hartree_grid(rows, [(a, b) for a in firsts for b in gains]).select("first", "gain", "query_id", F.round("snapped", 1).alias("lam"))
    scored = solved.join(values.select("query_id", F.round("lam", 1).alias("lam"), "value"), ["query_id", "lam"])
    return scored.groupBy("first", "gain").agg(F.avg("value").alias("value")).orderBy(F.desc(F.round("value", 9)), "first", "gain")


# -- sequential learners: one corpus is one ordered stream --------------------------------
class LinUCB:
    """Disjoint linear bandit; the inverse is kept by rank-one updates."""

    def __init__(self, arms: int, dim: int, alpha: float = 1.0) -> None:
        self.alpha, self.inv, self.b = alpha, np.stack([np.eye(dim)] * arms), np.zeros((arms, dim))

    def choose(self, x: np.ndarray) -> int:
        theta = np.einsum("aij,aj->ai", self.inv, self.b)
        width = np.sqrt(np.maximum(0.0, np.einsum("i,aij,j->a", x, self.inv, x)))
        return int((theta @ x + self.alpha * width).argmax())

    def update(self, arm: int, x: np.ndarray, reward: float) -> None:
        v = self.inv[arm] @ x
        self.inv[arm] -= np.outer(v, v) / (1.0 + x @ v)
        self.b[arm] += reward * x


def _replayed(rows: DataFrame, columns: list[str], schema: str, start: Callable, step: Callable) -> DataFrame:
    """Every corpus' rows in order of ``step`` through a learner: ``step(learner, features,
    row)`` gives the columns behind corpus and step. Sorted partitions stream by, a task
    holds a learner and a batch; a corpus, being one ordered stream, is one task's."""
    names = [c.rsplit(" ", 1)[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, learner = None, None
        for f in batches:
            out = []
            for x, row in zip(f[columns].to_numpy(float), f.itertuples(index=False)):
                if row.corpus != last:
                    last, learner = row.corpus, start()
                out.append((row.corpus, row.step, *step(learner, np.append(x, 1.0), row)))
            yield pd.DataFrame(out, columns=["corpus", "step", *names])

    ordered = rows.where("corpus is not null and step is not null").repartition("corpus").sortWithinPartitions("corpus", "step")
    return ordered.mapInPandas(run, f"corpus string, step bigint, {schema}")


def linucb_replay(rows: DataFrame, columns: list[str], arms: list[str], alpha: float = 1.0) -> DataFrame:
    """``corpus, step, arm, reward, regret`` of replaying each corpus in order of ``step``;
    ``arms`` are the columns with each arm's reward."""

    def step(bandit: LinUCB, x: np.ndarray, row) -> tuple:
        r = [float(getattr(row, a)) for a in arms]
        arm = bandit.choose(x)
        bandit.update(arm, x, r[arm])
        return arms[arm], r[arm], max(r) - r[arm]

    kept = rows.select("corpus", "step", *columns, *arms)
    return _replayed(kept, columns, "arm string, reward double, regret double", lambda: LinUCB(len(arms), len(columns) + 1, alpha), step)


class Drift:
    """Moving average of a residual and two-sided cumulative sums that start again after an alarm."""

    def __init__(self, decay: float = 0.1, slack: float = 0.05, threshold: float = 1.0) -> None:
        self.decay, self.slack, self.threshold = decay, slack, threshold
        self.mean = self.up = self.down = 0.0
        self.seen = 0

    def add(self, x: float) -> tuple[float, bool]:
        self.mean = x if not self.seen else (1 - self.decay) * self.mean + self.decay * x
        self.seen += 1
        self.up, self.down = max(0.0, self.up + x - self.slack), max(0.0, self.down - x - self.slack)
        alarm = self.up > self.threshold or self.down > self.threshold
        if alarm:
            self.up = self.down = 0.0
        return self.mean, alarm

    def state(self) -> tuple[float, float, float, int]:
        return self.mean, self.up, self.down, self.seen

    @classmethod
    def of(cls, state: tuple[float, float, float, int], **kw) -> Drift:
        d = cls(**kw)
        d.mean, d.up, d.down, d.seen = state
        return d


def drift_replay(rows: DataFrame, key: str, order: str, value: str, decay: float = 0.1, slack: float = 0.05, threshold: float = 1.0) -> DataFrame:
    """``key, order, ema, alarm`` along each key's ordered values; null values are skipped."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, drift = None, Drift(decay, slack, threshold)
        for f in batches:
            ema, alarm = [], []
            for k, x in zip(f[key], f[value]):
                if k != last:
                    last, drift = k, Drift(decay, slack, threshold)
                m, a = drift.add(float(x))
                ema.append(m)
                alarm.append(a)
            yield pd.DataFrame({key: f[key], order: f[order], "ema": ema, "alarm": alarm})

    # sorted partitions stream by: no key's history is held
    ordered = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, order, value).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, ema double, alarm boolean")


def online_lambda(rows: DataFrame, columns: list[str], rate: float = 0.05) -> DataFrame:
    """Stochastic gradient replay: predict ``target`` from the features so far, then learn
    from it; ``corpus, step, prediction, residual``."""

    def step(w: np.ndarray, x: np.ndarray, row) -> tuple:
        y, p = float(row.target), float(np.clip(w @ x, 0, 1))
        w += rate * (y - w @ x) * x / (1 + x @ x)
        return p, y - p

    return _replayed(rows.select("corpus", "step", "target", *columns), columns, "prediction double, residual double", lambda: np.zeros(len(columns) + 1), step)
