"""Significance and summary statistics over per-query values ``query_id, a, b``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.shared import stored

#: Different values that one task draws from.
PART_ROWS = 100_000
#: A value that so many rows have is drawn as a number of times, any other row by row.
FREQUENT = 16


def _part_sums(d: np.ndarray, c: np.ndarray, k: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sum of k[r] draws with replacement, for every r, from the rows that have the value d[i] c[i] times.

    How often each frequent value is drawn is one multinomial draw, whose last cell is all
    other rows; these are drawn singly. That is the distribution of drawing every row singly."""
    often = (c >= FREQUENT) & np.isfinite(d)
    rare = np.repeat(d[~often], c[~often])
    cells = np.append(c[often], len(rare))
    total = np.zeros(len(k))
    room = max(1, (1 << 21) // max(len(cells), int(k.max(initial=0) * (len(rare) / c.sum()) * 1.1) + 1))
    for at in range(0, len(k), room):
        counts = rng.multinomial(k[at : at + room], cells / c.sum())
        sums, left = counts[:, :-1] @ d[often], counts[:, -1]
        if len(rare):
            drawn = rare[rng.integers(0, len(rare), int(left.sum()))]
            some = left > 0
            sums[some] += np.add.reduceat(drawn, (np.cumsum(left) - left)[some]) if some.any() else 0.0
        total[at : at + room] = sums
    return total


def bootstrap_means(pairs: DataFrame, replicates: int = 10_000, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """``seed, replicate, delta``: mean of b - a over n draws with replacement.

    Rows of one value are collapsed to it and their number. Values go to parts of about
    ``PART_ROWS`` by their hash. How many draws of a replicate fall to each part is drawn
    first, by every part alike from the seed; then each part draws among its own and sends
    one sum a replicate. The result depends on the values, seeds and replicates alone, not
    on the cluster."""
    rows = pairs.select("query_id", (F.col("b") - F.col("a")).cast("double").alias("d")).where("query_id is not null and d is not null")
    values = stored(rows.groupBy("d").agg(F.count("*").alias("c")), "bootstrap")
    parts = max(1, -(-values.count() // PART_ROWS))
    values = values.withColumn("part", F.pmod(F.xxhash64("d"), F.lit(parts)).cast("int"))
    sizes = [0] * parts
    for r in values.groupBy("part").agg(F.sum("c").alias("n")).toLocalIterator():  # one row a part
        sizes[r.part] = r.n
    n = sum(sizes)

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by("d")
        part, seed = table.column("part")[0].as_py(), table.column("seed")[0].as_py()
        share = np.random.default_rng([seed, n]).multinomial(n, np.asarray(sizes) / n, size=replicates)[:, part]
        total = _part_sums(table.column("d").to_numpy(), table.column("c").to_numpy(), share, np.random.default_rng([seed, n, part]))
        return pa.table({"seed": pa.array(np.full(replicates, seed), pa.int64()), "replicate": pa.array(np.arange(replicates), pa.int64()), "total": total})

    asked = values.withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in seeds])))
    # small rows with long work: a number of partitions that Spark does not merge
    asked = asked.repartition(min(2 * parts * len(seeds), 1000), "part", "seed")
    drawn = asked.groupBy("part", "seed").applyInArrow(draw, "seed bigint, replicate bigint, total double")
    return drawn.groupBy("seed", "replicate").agg((F.sum("total") / F.lit(max(n, 1))).alias("delta"))


def paired_bootstrap(pairs: DataFrame, replicates: int = 10_000, seeds: tuple[int, ...] = (0,), rule: str = "shifted") -> DataFrame:
    """``seed, n, delta, low, high, p, cohen_d``.

    ``rule``: ``shifted`` two-sided against the shifted distribution with floor
    1/replicates; ``one_sided`` share of deltas not above 0; ``percentile`` twice the
    smaller tail."""
    d = F.col("b") - F.col("a")
    seen = pairs.where(d.isNotNull()).agg(F.count("*").alias("n"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd")).first()  # one row
    size = float(seen.delta / seen.sd) if seen.sd else 0.0
    obs = F.lit(seen.delta).cast("double")
    runs = bootstrap_means(pairs, replicates, seeds)
    share = lambda c: F.avg(c.cast("double"))
    if rule == "shifted":
        p = F.greatest(share(F.abs(F.col("delta") - obs) >= F.abs(obs)), F.lit(1.0 / replicates))
    elif rule == "one_sided":
        p = share(F.col("delta") <= 0)
    elif rule == "percentile":
        p = F.least(F.lit(1.0), 2 * F.least(share(F.col("delta") <= 0), share(F.col("delta") >= 0)))
    else:
        raise ValueError(f"unknown rule {rule}")
    return runs.groupBy("seed").agg(
        F.lit(seen.n).cast("bigint").alias("n"), obs.alias("delta"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"), p.alias("p"), F.lit(size).alias("cohen_d")
    )


def summary(values: DataFrame, value: str, keys: tuple[str, ...] = (), sample: bool = False) -> DataFrame:
    sd: Column = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return values.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), sd.alias("std"))


def upper_median(values: Column) -> Column:
    """Element n >> 1 of the sorted array."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def floor_percentile(values: Column, p: float) -> Column:
    """Element floor(p * n) of the sorted positive values, 0 if there are none."""
    kept = F.array_sort(F.filter(values, lambda x: x > 0))
    at = F.least(F.floor(F.size(kept) * p).cast("int"), F.size(kept) - 1)
    return F.when(F.size(kept) > 0, F.get(kept, at)).otherwise(F.lit(0.0))


def running(values: DataFrame, order: str, value: str, window: int = 50, key: str = "key") -> DataFrame:
    """Adds, along each key, the mean of the row and the ``window`` rows before it, and the running sum."""
    w = Window.partitionBy(key).orderBy(order)
    return values.withColumn("running_mean", F.avg(value).over(w.rowsBetween(-window, 0))).withColumn("running_sum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def complementarity(pairs: DataFrame) -> DataFrame:
    """One row over per-query (base, a, b): sign quadrants of the gains over base, their correlation and cosine."""
    g = pairs.select((F.col("a") - F.col("base")).alias("x"), (F.col("b") - F.col("base")).alias("y"))
    s = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    x, y = F.col("x"), F.col("y")
    return g.agg(
        s((x > 0) & (y > 0)).alias("both_up"), s((x > 0) & (y <= 0)).alias("a_up"), s((x <= 0) & (y > 0)).alias("b_up"), s((x <= 0) & (y <= 0)).alias("none_up"),
        F.corr("x", "y").alias("pearson"), (F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"),
    )
