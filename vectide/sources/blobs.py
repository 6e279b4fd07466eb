"""Vectors in binary columns: little-endian f32 and f16, checked by length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(blob: pd.Series) -> pd.Series:
    """Null for null and for a length that is no multiple of 4."""
    return blob.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) % 4 == 0 else None)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f16(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: np.frombuffer(b, "<f2").astype("<f4") if b is not None and len(b) % 2 == 0 else None)


@F.pandas_udf(T.BinaryType())
def encode_f32(vec: pd.Series) -> pd.Series:
    return vec.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def reshape_f32(blob: pd.Series, n: pd.Series) -> pd.Series:
    """A block of n vectors; null where the length does not fit n."""

    def one(b, k):
        if b is None or pd.isna(k) or k <= 0 or len(b) % (4 * int(k)):
            return None
        return list(np.frombuffer(b, "<f4").reshape(int(k), -1))

    return pd.Series([one(b, k) for b, k in zip(blob, n)])


def usable(vec: Column) -> Column:
    """All values finite and not all zero."""
    return F.forall(vec, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)


def decoded(df: DataFrame, column: str, dim: int, kind: str = "f32") -> DataFrame:
    """Rows whose blob has exactly ``dim`` numbers, with ``vec``; the length is checked before any Python runs."""
    width = dim * (4 if kind == "f32" else 2)
    udf = decode_f32 if kind == "f32" else decode_f16
    return df.where(F.octet_length(column) == width).withColumn("vec", udf(column))
