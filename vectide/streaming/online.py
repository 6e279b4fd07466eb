"""Structured Streaming forms of the sequential operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vectide.operators.adaptive import Drift


def drift_stream(events: DataFrame, key: str, time: str, value: str, decay: float = 0.1, slack: float = 0.05, threshold: float = 1.0) -> DataFrame:
    """``key, time, ema, alarm`` with the drift state kept per key between batches.

    Values of a micro-batch are taken in order of time; what comes later than its
    batch is taken then, so the result equals the batch replay on ordered input."""
    kinds = dict(events.dtypes)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kw = {"decay": decay, "slack": slack, "threshold": threshold}
        drift = Drift.of(state.get, **kw) if state.exists else Drift(**kw)
        f = pd.concat(list(frames)).sort_values(time)
        rows = [drift.add(float(x)) for x in f[value]]
        state.update(drift.state())
        yield pd.DataFrame({key: f[key].to_numpy(), time: f[time].to_numpy(), "ema": [r[0] for r in rows], "alarm": [r[1] for r in rows]})

    rows = events.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, time, value)
    return rows.groupBy(key).applyInPandasWithState(
        update, f"{key} {kinds[key]}, {time} {kinds[time]}, ema double, alarm boolean", "mean double, up double, down double, seen bigint", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling-window counts and sums with a watermark for late events."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def ingest_points(stream: DataFrame, path: str, checkpoint: str):
    """Appends arriving (doc_id, point_idx, vec) rows to a cloud table, each point once."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.where("doc_id is not null and point_idx is not null and vec is not null").dropDuplicates(["doc_id", "point_idx"])
        try:
            new = new.join(spark.read.parquet(path).select("doc_id", "point_idx"), ["doc_id", "point_idx"], "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
