"""The N best items of every group, by sorted runs and a loser-tree merge.

1. Every input partition is sorted by (group, score, item): one *run*. While it
   streams by, only the first N distinct items of each group are kept, which
   loses nothing, since an item among the best N of the whole is among the best
   N of the run that holds its best row.
2. Runs are stored by bucket of the group key, in order of group, run and score, so a
   hot group arrives at its bucket as at most (runs x N) rows, however many rows it
   has. Buckets are as many as the runs, or as the session's shuffle partitions if
   those are more.
3. One task a bucket merges as the rows stream by: the runs of a group are merged with
   a tree of losers up to N outputs, then the cursor seeks the next group, past what is
   left of this one. A task holds one batch and the group that crosses its end.

Semantics, nulls included
* Rows whose group, item or score is null, or whose score is NaN, count for nothing.
* ``-0.0`` equals ``0.0``; equal scores are ordered by item, smaller first.
* An item counts once a group, with its best score. Rows given again change nothing.
* ``n`` may be a column that is constant in a group; null means ``default_n``;
  0 or less gives no row. An empty table gives an empty table.
* Only the named columns are read, so extra columns with any names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _truncate_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (g, s, i, n), the first n distinct items of each group.

    Works batch by batch; only the items of the group that crosses a batch's end
    are carried over, at most n of them.
    """
    last_group, seen = None, set()
    for batch in batches:
        if not batch.num_rows:
            continue
        g, i, n = (batch.column(k).to_pylist() for k in (0, 2, 3))
        keep = []
        for row, (group, item, most) in enumerate(zip(g, i, n)):
            if group != last_group:
                last_group, seen = group, set()
            if len(seen) < most and item not in seen:
                seen.add(item)
                keep.append(row)
        if len(keep) == batch.num_rows:
            yield batch
        elif keep:
            yield batch.take(pa.array(np.asarray(keep, dtype=np.int64)))


class LoserTree:
    """A tree of losers over k sorted cursors.

    ``keys[r]`` is the head of run r, or None when it is out of rows. The root
    holds the winner; a replaced head replays only its own path, log2(k) matches.
    """

    def __init__(self, keys: list) -> None:
        self.k = max(1, len(keys))
        self.keys = keys or [None]
        self.tree = [-1] * self.k
        for run in range(self.k - 1, -1, -1):
            self._enter(run)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None if x is not None and y is None else (x is not None and x < y)

    def _enter(self, run: int) -> None:
        node, winner = (run + self.k) // 2, run
        while node > 0:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    @property
    def winner(self) -> int:
        return self.tree[0]

    def replace(self, key) -> None:
        """The winner's run moves on to ``key``."""
        run = winner = self.tree[0]
        self.keys[run] = key
        node = (run + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner


def merge_group(scores: list, items: list, n: int, spans: list[tuple[int, int]]) -> list[tuple]:
    """(item, score, rank) of the first ``n`` distinct items of one group's runs, each a
    span of the lists sorted by (score, item)."""
    out: list[tuple] = []
    seen: set = set()
    cursor = [at for at, _ in spans]
    tree = LoserTree([(scores[at], items[at]) for at in cursor])
    while len(seen) < n and tree.keys[tree.winner] is not None:
        run = tree.winner
        score, item = tree.keys[run]
        if item not in seen:
            seen.add(item)
            out.append((item, score, len(seen)))
        cursor[run] += 1
        at = cursor[run]
        tree.replace((scores[at], items[at]) if at < spans[run][1] else None)
    return out


def _edges(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before."""
    if len(column) < 2:
        return np.zeros(0, np.int64)
    return np.flatnonzero(pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)) + 1


def merge_sorted(batch: pa.RecordBatch) -> tuple[list, list, list, list]:
    """Groups, items, scores and ranks of whole groups, rows in order of (g, r, s, i)."""
    groups, items, scores, ranks = [], [], [], []
    starts = np.concatenate([[0], _edges(batch.column("g"))])
    runs = np.union1d(starts, _edges(batch.column("r")))
    ends = np.append(runs[1:], batch.num_rows)
    cut = np.append(np.searchsorted(runs, starts), len(runs))
    most, names = batch.column("n").take(pa.array(starts)).to_pylist(), batch.column("g").take(pa.array(starts)).to_pylist()
    for k, (group, n) in enumerate(zip(names, most)):
        lo, hi = cut[k], cut[k + 1]
        first, last = int(runs[lo]), int(ends[hi - 1])
        if hi - lo == 1:  # one run: in order, and distinct since its truncation
            last = min(last, first + n)
            some = batch.slice(first, last - first)
            got = list(zip(some.column("i").to_pylist(), some.column("s").to_pylist(), range(1, last - first + 1)))
        else:
            some = batch.slice(first, last - first)
            got = merge_group(some.column("s").to_pylist(), some.column("i").to_pylist(), n, [(int(a) - first, int(b) - first) for a, b in zip(runs[lo:hi], ends[lo:hi])])
        groups += [group] * len(got)
        for item, score, rank in got:
            items.append(item)
            scores.append(score)
            ranks.append(rank)
    return groups, items, scores, ranks


def top_n_per_group(
    df: DataFrame,
    group: str,
    item: str,
    score: str,
    n: Column | int,
    default_n: int = 5,
    ascending: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """The ``n`` best items of each group: columns group, item, score, ``rank``.

    ``buckets`` is the number of merge tasks; by default that of the input's partitions,
    at least the session's shuffle partitions. See the module's text for nulls, ties and
    repeated rows.
    """
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    n = n if isinstance(n, Column) else F.lit(n)
    value = F.col(score).cast("double") + F.lit(0.0)  # -0.0 becomes 0.0
    rows = df.select(
        F.col(group).alias("g"),
        (value if ascending else -value + F.lit(0.0)).alias("s"),
        F.col(item).alias("i"),
        F.coalesce(n.cast("int"), F.lit(default_n)).alias("n"),
    ).where("g is not null and i is not null and s is not null and not isnan(s) and n > 0")
    run_schema = rows.schema
    runs = rows.sortWithinPartitions("g", "s", "i").mapInArrow(_truncate_run, run_schema)
    tagged = runs.select("g", F.spark_partition_id().alias("r"), "s", "i", "n")
    bucketed = tagged.repartition(buckets, "g").sortWithinPartitions("g", "r", "s", "i")
    out_schema = f"g {kinds[group]}, i {kinds[item]}, s double, rank int"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that is not over yet

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.concat_batches(parts)
            g, i, s, rank = merge_sorted(whole)
            return pa.RecordBatch.from_arrays([pa.array(g, whole.column("g").type), pa.array(i, whole.column("i").type), pa.array(s, pa.float64()), pa.array(rank, pa.int32())], names=["g", "i", "s", "rank"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and held[-1].column("g")[-1] != batch.column("g")[0]:
                yield done(held)
                held = []
            edges = _edges(batch.column("g"))
            if len(edges):
                last = int(edges[-1])
                yield done([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield done(held)

    best = bucketed.mapInArrow(merge, out_schema)
    back = F.col("s") if ascending else -F.col("s") + F.lit(0.0)
    return best.select(F.col("g").alias(group), F.col("i").alias(item), back.alias(score), "rank")
