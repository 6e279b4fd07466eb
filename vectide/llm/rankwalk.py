"""One ranking from several lists, by a Markov chain over ranks.

From an item the walk picks one of the group's lists at random and jumps, each
with equal chance, to one of the items that the list does not rank below it
(itself included); an item that the list lacks may jump to any item of it. With
chance ``1 / (damping_k + 1)`` it jumps to any item at all. Only ranks matter, so
no list counts for more because its numbers are larger. Items are ordered by the
chain's stationary chances, ties by item.

With the items of a list in order, the chance that arrives at rank s is the sum
over r >= s of (chance at r) / r: one sorted prefix sum a list and step, no matrix.

An item that stands among the first r of each of L lists has a rank of at most
``(r - 1) * L + 1``: in a list, more arrives only at items above it, at most r - 1 of
them, and less at all below and at those the list lacks; so only these can be above it.

Groups of up to ``giant_over`` rows are solved whole in one task; larger ones by
the same iteration on DataFrames with two-level prefix sums, so no task ever
holds a giant group.

Semantics: values are larger-is-better; null and NaN values, null groups, lists
and items count for nothing; -0.0 equals 0.0; infinities rank as such; an item
counts once in a list with its best value; equal values rank by item, smaller
first; ``damping_k`` null means 60. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.shared import release, stored

DEFAULT_DAMPING_K = 60.0
#: The iteration ends when all chances together move by less; the same for groups of any size.
TOLERANCE = 1e-12
MOST_STEPS = 5000
#: Chances that differ by less than this share of them are equal.
DIGITS = 10


class NotSettled(RuntimeError):
    """The chain had not settled after ``MOST_STEPS`` steps."""


def stationary(orders: list[np.ndarray], n: int, damping: float) -> np.ndarray:
    """Stationary chances of n items; ``orders`` hold each list's items, best first."""
    p = np.full(n, 1.0 / n)
    ranks = [np.arange(1, len(o) + 1) for o in orders]
    for _ in range(MOST_STEPS):
        new = np.zeros(n)
        for o, r in zip(orders, ranks):
            mine = p[o]
            arrive = np.cumsum((mine / r)[::-1])[::-1]
            arrive += max(0.0, 1.0 - mine.sum()) / len(o)
            new[o] += arrive
        new = damping / len(orders) * new + (1 - damping) / n
        new /= new.sum()
        done = np.abs(new - p).sum() < TOLERANCE
        p = new
        if done:
            return p
    raise NotSettled(f"{n} items, damping {damping}")


def _solve(table: pa.Table) -> pa.Table:
    item, which = table.column("item").to_numpy(), table.column("list").to_numpy(zero_copy_only=False)
    value = table.column("value").to_numpy()
    items, code = np.unique(item, return_inverse=True)
    lists, which = np.unique(which.astype(str), return_inverse=True)
    order = np.lexsort((item, -value, which))
    cut = np.searchsorted(which[order], np.arange(len(lists) + 1))
    orders = [code[order[a:b]] for a, b in zip(cut, cut[1:])]
    k = table.column("k")[0].as_py()
    p = stationary(orders, len(items), k / (k + 1.0))
    seen, worst = np.zeros(len(items), int), np.zeros(len(items), int)
    for o in orders:
        seen[o] += 1
        worst[o] = np.maximum(worst[o], np.arange(1, len(o) + 1))
    best = np.lexsort((items, -np.round(np.log(p), DIGITS)))
    rank = np.empty(len(items), np.int32)
    rank[best] = np.arange(1, len(items) + 1)
    group = table.column("grp").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(items), np.int64)))
    return pa.table(
        {
            "grp": group,
            "item": pa.array(items, table.schema.field("item").type),
            "chance": pa.array(p),
            "rank": pa.array(rank),
            "lists": pa.array(np.full(len(items), len(lists), np.int32)),
            "in_lists": pa.array(seen.astype(np.int32)),
            "worst_rank": pa.array(worst.astype(np.int32)),
        }
    )


def _local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (grp, list): the place within the partition's part of the list."""
    last, place = None, 0
    for batch in batches:
        places = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            place = place + 1 if key == last else 1
            last = key
            places.append(place)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "place"])


def _giants(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """The same chain for groups too large for a task."""
    kinds = dict(rows.dtypes)
    total = rows.count()
    parts = max(2, -(-total // chunk_rows))
    ranged = rows.repartitionByRange(parts, "grp", "list", F.desc("value"), "item").sortWithinPartitions("grp", "list", F.desc("value"), "item")
    local = stored(ranged.withColumn("chunk", F.spark_partition_id()).select("grp", "list", "item", "k", "chunk").mapInArrow(_local_ranks, f"grp {kinds['grp']}, list string, item {kinds['item']}, k double, chunk int, place long"), "walk-local")
    per_chunk = local.groupBy("grp", "list", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("grp", "list").orderBy("chunk")
    offsets = per_chunk.withColumn("offset", F.sum("n").over(before) - F.col("n")).withColumn("m", F.sum("n").over(Window.partitionBy("grp", "list")))
    ranks = stored(local.join(offsets.drop("n"), ["grp", "list", "chunk"]).withColumn("rank", F.col("place") + F.col("offset")), "walk-ranks")
    info = ranks.groupBy("grp").agg(F.max("k").alias("k"), F.countDistinct("list").alias("lists"))
    items = ranks.groupBy("grp", "item").agg(F.count("*").cast("int").alias("in_lists"), F.max("rank").cast("int").alias("worst_rank"))
    sizes = items.groupBy("grp").agg(F.count("*").alias("n")).join(info, "grp")
    state = before_ = stored(items.join(sizes, "grp").withColumn("p", 1.0 / F.col("n")), "walk-state")
    for _ in range(MOST_STEPS):
        w = ranks.select("grp", "list", "item", "chunk", "rank", "m").join(state.select("grp", "item", "p"), ["grp", "item"]).withColumn("w", F.col("p") / F.col("rank"))
        sums = w.groupBy("grp", "list", "chunk").agg(F.sum("w").alias("cw"), F.sum("p").alias("cp"))
        later = Window.partitionBy("grp", "list").orderBy(F.desc("chunk"))
        whole = Window.partitionBy("grp", "list")
        sums = sums.select("grp", "list", "chunk", (F.sum("cw").over(later) - F.col("cw")).alias("after"), F.sum("cp").over(whole).alias("present"))
        inside = Window.partitionBy("grp", "list", "chunk").orderBy(F.desc("rank"))
        arrive = w.withColumn("s", F.sum("w").over(inside)).join(sums, ["grp", "list", "chunk"]).withColumn("got", F.col("s") + F.col("after") + F.greatest(F.lit(0.0), 1 - F.col("present")) / F.col("m"))
        got = arrive.groupBy("grp", "item").agg(F.sum("got").alias("got"))
        d = F.col("k") / (F.col("k") + 1)
        new = stored(
            state.withColumnRenamed("p", "old").join(got, ["grp", "item"]).withColumn("p", d / F.col("lists") * F.col("got") + (1 - d) / F.col("n")).drop("got"), "walk-state"
        )
        moved = new.groupBy("grp").agg(F.sum(F.abs(F.col("p") - F.col("old"))).alias("moved")).agg(F.max("moved")).first()[0]
        release(before_)
        before_, state = new, new.drop("old")
        if moved is None or moved < TOLERANCE:
            break
    else:
        raise NotSettled("giant groups")
    # places by two levels again
    placed = state.repartitionByRange(parts, "grp", F.desc(F.round(F.log("p"), DIGITS)), "item").sortWithinPartitions("grp", F.desc(F.round(F.log("p"), DIGITS)), "item")
    placed = placed.select("grp", F.lit("").alias("list"), "item", F.spark_partition_id().alias("chunk"), "p", "lists", "in_lists", "worst_rank")
    numbered = stored(placed.mapInArrow(_local_ranks, f"grp {kinds['grp']}, list string, item {kinds['item']}, chunk int, p double, lists long, in_lists int, worst_rank int, place long"), "walk-placed")
    counts = numbered.groupBy("grp", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("grp", "chunk", (F.sum("n").over(Window.partitionBy("grp").orderBy("chunk")) - F.col("n")).alias("offset"))
    return numbered.join(counts, ["grp", "chunk"]).select(
        "grp", "item", F.col("p").alias("chance"), (F.col("place") + F.col("offset")).cast("int").alias("rank"), F.col("lists").cast("int").alias("lists"), "in_lists", "worst_rank"
    )


def combine_rankings(
    df: DataFrame, group: str, which: str, item: str, value: str, damping_k: str | None = None, giant_over: int = 1_000_000, chunk_rows: int = 250_000
) -> DataFrame:
    """group, item, ``chance``, ``rank``, ``lists`` (of the group), ``in_lists`` (that
    have the item), ``worst_rank`` (its largest rank in those)."""
    k = F.coalesce(F.col(damping_k).cast("double"), F.lit(DEFAULT_DAMPING_K)) if damping_k else F.lit(DEFAULT_DAMPING_K)
    rows = (
        df.select(F.col(group).alias("grp"), F.col(which).cast("string").alias("list"), F.col(item).alias("item"), (F.col(value).cast("double") + F.lit(0.0)).alias("value"), k.alias("k"))
        .where("grp is not null and list is not null and item is not null and value is not null and not isnan(value)")
        .groupBy("grp", "list", "item")
        .agg(F.max("value").alias("value"), F.max("k").alias("k"))
    )
    rows = stored(rows, "walk-lists")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") > giant_over).select("grp")
    kinds = dict(rows.dtypes)
    schema = f"grp {kinds['grp']}, item {kinds['item']}, chance double, rank int, lists int, in_lists int, worst_rank int"
    if sizes.isEmpty():
        out = rows.groupBy("grp").applyInArrow(_solve, schema)
    else:
        out = rows.join(sizes, "grp", "left_anti").groupBy("grp").applyInArrow(_solve, schema).unionByName(_giants(stored(rows.join(sizes, "grp", "left_semi"), "walk-giants"), chunk_rows))
    return out.withColumnsRenamed({"grp": group, "item": item})
