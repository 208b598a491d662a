"""What several operators share: reading given tables, words, folds, batches."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handed to Python at once, so that very long texts do not add up.
BATCH_ROWS = 1000


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as make it differ from all columns in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(values: Iterable[Hashable]) -> tuple[np.ndarray, list]:
    """A number for each value, and the different values in the order of their numbers. Unlike factorize() of pandas,
    which ends strings at a null character."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    codes = np.fromiter(map(numbers.__getitem__, values), np.int64)
    return codes, list(numbers)


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased. On bytes both lower() and split() know ASCII only."""
    return text.encode().lower().split() if text else []
