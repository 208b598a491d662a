"""Text to vectors through a pluggable batch column function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscolake.functions.tokens import Normalizer, same_term, terms

DIMENSION = 256
Embedder = Callable[[Column], Column]


def _slot(term: Column, dimension: int) -> Column:
    """Position of a term in the vector, the same in any engine that knows MD5."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(dimension)).cast("int")


def hashed_words(dimension: int = DIMENSION, normalize: Normalizer = same_term) -> Embedder:
    """The default embedder: hashed word counts scaled to unit length."""

    @F.pandas_udf("array<float>")
    def unit_counts(slots: pd.Series) -> pd.Series:
        def one(s) -> np.ndarray:
            counts = np.bincount(np.asarray(s, dtype=np.int64), minlength=dimension).astype(np.float64)
            norm = np.sqrt((counts * counts).sum())
            return (counts / norm if norm else counts).astype(np.float32)
        return slots.map(one)

    def embedder(text: Column) -> Column:
        return unit_counts(F.transform(terms(text, normalize), lambda t: _slot(t, dimension)))

    return embedder


def embed(df: DataFrame, embedder: Embedder | None = None, text: str = "text") -> DataFrame:
    """Add the column ``embedding``. Any batch function from a text column to
    ``array<float>`` will do, for example a model in a pandas UDF."""
    return df.withColumn("embedding", (embedder or hashed_words())(F.coalesce(F.col(text), F.lit(""))))
