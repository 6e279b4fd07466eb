"""Mixing sources to target shares of tokens by pivotal dependent rounding.

1. Sizes: the tokens of every text, and their sum per source.
2. Amounts: of a total of ``budget`` tokens (by default what the sources with a
   target hold) each source is to give its share; one that cannot, even with
   every text ``max_repeats`` times, gives all it may, and what it lacks is
   divided among the others in proportion to their shares, and so on until no
   further source runs out.
3. Copies: every text of a source gets the same expected number of copies. Its
   whole part is sure; the fractional parts are rounded by the pivotal method: two
   texts meet, tokens are moved from one's chance to the other's, in a random
   direction that keeps both expectations, until one is 0 or 1, and the other
   goes on. Texts meet within buckets; each bucket leaves one open text, and the
   open ones meet in a tree of tasks until one is left per source. So a source's
   tokens miss their amount by less than one text.

Semantics: null and empty texts have 0 tokens and 0 copies; a source without a
target, or a null source, gives nothing and is reported with a null target; a
target without texts is reported with 0; null or negative shares count as 0,
null ``max_repeats`` as 1; a repeated id counts as often as it stands. With no
rows every share reached is 0. Chance depends on ids and ``seed`` alone, not on
partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.tokens import count_tokens
from vectide.shared import stored

BUCKET_ROWS = 20_000
#: Sources that a table of targets may name; such tables are broadcast.
MOST_TARGETS = 100_000
FAN_IN = 32


def amounts(held: dict[str, int], share: dict[str, float], repeats: dict[str, int], budget: float) -> dict[str, float]:
    """Tokens each source gives: shares of the budget, capped, the lack passed on."""
    most = {s: held.get(s, 0) * max(0, repeats[s]) for s in share}
    out = dict.fromkeys(share, 0.0)
    open_ = {s for s in share if share[s] > 0 and most[s] > 0}
    left = float(budget)
    while open_ and left > 0:
        total = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / total >= most[s]}
        if not full:
            for s in open_:
                out[s] = left * share[s] / total
            break
        for s in full:
            out[s] = float(most[s])
            left -= most[s]
        open_ -= full
    return out


def random_of(key: object, salt: int) -> float:
    """A number in [0, 1) that depends on key and salt alone."""
    return (xxhash.xxh64_intdigest(str(key), salt) >> 11) / 2.0**53


def pivot(ids: list, p: list[float], t: list[int], salt: int) -> tuple[list[int], int | None, float]:
    """Pivotal rounding of chances ``p`` of texts of ``t`` tokens: 0 or 1 for each
    text, the position left open (or None) and its chance. The tokens expected in
    all stay the same throughout."""
    take, q, open_ = [0] * len(p), list(p), None
    for j in range(len(q)):
        if not 1e-9 < q[j] < 1 - 1e-9:
            take[j] = int(q[j] > 0.5)
            continue
        if open_ is None:
            open_ = j
            continue
        i = open_
        up = min((1 - q[i]) * t[i], q[j] * t[j])  # tokens that may move from j to i
        down = min(q[i] * t[i], (1 - q[j]) * t[j])
        move = up if random_of(ids[j], salt) < down / (up + down) else -down
        q[i] += move / t[i]
        q[j] -= move / t[j]
        open_ = None
        for k in (i, j):
            if 1e-9 < q[k] < 1 - 1e-9:
                open_ = k
            else:
                take[k] = int(q[k] > 0.5)
    return take, open_, q[open_] if open_ is not None else 0.0


def _meeting(last: bool, salt: int):
    """One task's round: texts of a bucket meet; only the last round settles the open one."""

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["id", "row"], kind="stable").reset_index(drop=True)
        take, open_, chance = pivot(f.id.tolist(), f.p.tolist(), f.tokens.tolist(), salt)
        if open_ is not None:
            f.loc[open_, "p"] = chance
            take[open_] = int(random_of(f.id[open_], salt + 1) < chance) if last else -1
        return f.assign(take=np.asarray(take, dtype=np.int32))

    return meet


class Mixture:
    """``copies`` (id, source, tokens, copies): every text of a source with a target;
    ``report``: per source target, reached share, tokens and repeats."""

    def __init__(self, docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None, seed: int = 7, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> None:
        spark = docs.sparkSession
        sized = stored(count_tokens(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("t")), ["id", "source"], "t", tokenizer, folder), "mix-sizes")
        # sources are named in a table of targets; the driver holds one row for each
        self.held = sized.groupBy("source").agg(F.sum("tokens").alias("held"), F.count("*").alias("texts"))
        want = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
        if want.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
            raise ValueError(f"targets name more than {MOST_TARGETS} sources")
        plan = {r.source: r for r in want.join(self.held, "source", "left").collect()}
        share = {s: max(0.0, r.share or 0.0) for s, r in plan.items()}
        held = {s: int(r.held or 0) for s, r in plan.items()}
        most = {s: 1 if r.most is None else max(0, r.most) for s, r in plan.items()}
        total = sum(held.values()) if budget is None else budget
        give = amounts(held, share, most, total)
        rate = {s: (give[s] / held[s] if held[s] else 0.0) for s in plan}
        self.targets = spark.createDataFrame([(s, share[s], most[s], float(rate[s]), float(give[s])) for s in plan], "source string, target_share double, max_repeats int, rate double, aim double")
        rows = sized.join(F.broadcast(self.targets), "source")  # one row per source of the targets, at most MOST_TARGETS
        buckets = self.held.select("source", F.ceil(F.col("texts") / BUCKET_ROWS).alias("buckets")).join(F.broadcast(self.targets.select("source")), "source", "left_semi")
        whole, real = F.floor(F.col("rate") + 1e-9), F.col("tokens") > 0
        first = rows.join(F.broadcast(buckets), "source").select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            "source",
            "tokens",
            F.when(real, whole).otherwise(0).cast("int").alias("sure"),
            F.when(real, F.greatest(F.lit(0.0), F.col("rate") - whole)).otherwise(0.0).alias("p"),
            F.pmod(F.xxhash64("id", F.lit(seed)), "buckets").alias("bucket"),
        )
        first = stored(first, "mix-chances")
        level, taken, depth = first, None, 0
        kind = dict(first.dtypes)["id"]
        while True:
            depth += 1
            last = level.agg(F.max("bucket")).first()[0] in (None, 0)

            out = stored(level.groupBy("source", "bucket").applyInPandas(_meeting(last, seed * 1000 + depth), f"row long, id {kind}, source string, tokens long, sure int, p double, bucket long, take int"), "mix-level")
            closed = out.where("take >= 0").select("id", "source", "tokens", (F.col("sure") + F.col("take")).alias("copies"))
            taken = closed if taken is None else taken.unionByName(closed)
            if last:
                break
            level = out.where("take < 0").drop("take").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        self.copies = taken

    def report(self) -> DataFrame:
        """``source, target_share, reached_share, tokens, held_tokens, texts_used,
        max_repeats, mean_repeats, most_repeats``; ``tokens`` are those in the mixture,
        ``mean_repeats`` is tokens by held tokens."""
        used = self.copies.groupBy("source").agg(
            F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum((F.col("copies") > 0).cast("long")).alias("texts_used"), F.max("copies").alias("most_repeats")
        )
        used = stored(used, "mix-used")
        total = used.agg(F.sum("tokens").alias("total"))
        sources = self.held.select("source", "held").join(self.targets.select("source", "target_share", "max_repeats"), "source", "full")
        zero = lambda c, kind="bigint": F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
        return (
            sources.join(used, "source", "left")
            .join(F.broadcast(total))  # one row
            .select(
                "source",
                "target_share",
                F.coalesce(F.col("tokens") / F.when(F.col("total") > 0, F.col("total")), F.lit(0.0)).alias("reached_share"),
                zero("tokens"),
                zero("held").alias("held_tokens"),
                zero("texts_used"),
                "max_repeats",
                F.coalesce(F.col("tokens") / F.when(F.col("held") > 0, F.col("held")), F.lit(0.0)).alias("mean_repeats"),
                zero("most_repeats", "int"),
            )
        )
