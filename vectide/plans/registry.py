"""Every query of the engine by name, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectide.plans import learning, lexical, rankings, retrievals, solving, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (vectors, retrievals, solving, rankings, lexical, learning):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)

FLAGSHIP = retrievals.flagship
