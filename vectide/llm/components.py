"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.shared import release, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``node, root``: every node of an edge with the smallest node of its component.

    Null ends and loops count for nothing; an edge given again or turned round
    counts once. No edge gives an empty table. The edges stay in tables; the
    driver sees two counts a round. Rounds grow with the logarithm of the size; if
    ``most_rounds`` do not do, it raises. A node with very many neighbours has one row on
    one side of each join, so the adaptive split of skewed joins divides the other.
    """
    now = stored(
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo is not null and hi is not null and lo != hi").distinct(), "cc-edges"
    )
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        # large star: larger neighbours of u hang on the smallest of u and its neighbours
        least = both.groupBy(F.col("lo").alias("u")).agg(F.min("hi").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("hi > lo").join(least, F.col("lo") == F.col("u")).select(F.col("m").alias("lo"), "hi").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        small_least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(small_least, F.col("hi") == F.col("u")).select(F.col("m").alias("x"), F.explode(F.array("lo", "hi")).alias("y")).where("x != y")
        last, now = now, stored(small.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "cc-edges")
        release(last)
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = now.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
