"""Token counts under a byte-level vocabulary of ranked merges.

A text is cut into pieces (words with the blank before them, numbers, signs, white space), and the bytes of a piece are
merged in pairs, the pair of the lowest rank first, until no pair is in the vocabulary.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pattern of pieces that goes with the vocabularies.
PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Different pieces whose counts a worker remembers.
REMEMBERED = 1 << 17

#: Tokens of a vocabulary and their ranks.
Ranks = dict[bytes, int]


def read_ranks(spark: SparkSession, path: str) -> Ranks:
    """A file with a token (in base64) and its rank on each line. A vocabulary does not grow with the data."""
    lines = spark.read.text(path).select(F.split("value", " ").alias("v")).where(F.size("v") == 2)
    return {base64.b64decode(token): int(rank) for token, rank in lines.select(F.get("v", F.lit(0)), F.get("v", F.lit(1))).collect()}


def merged(piece: bytes, ranks: Ranks) -> list[bytes]:
    """Tokens of a piece, in n log n steps for its n bytes."""
    if piece in ranks or len(piece) < 2:
        return [piece] if piece else []
    n = len(piece)
    # A token is named by where it starts; end is -1 where none does any more.
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(ranks[piece[i:i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
    heapify(waiting)

    def offer(start: int, mid: int) -> None:
        rank = ranks.get(piece[start:end[mid]])
        if rank is not None:
            heappush(waiting, (rank, start, mid, end[mid]))

    while waiting:
        _, start, mid, stop = heappop(waiting)
        if end[start] != mid or end[mid] != stop:
            continue
        end[start], end[mid] = stop, -1
        if stop < n:
            before[stop] = start
            offer(start, stop)
        if before[start] >= 0:
            offer(before[start], start)
    out, at = [], 0
    while at < n:
        out.append(piece[at:end[at]])
        at = end[at]
    return out


def token_counter(ranks: Ranks):
    """A function from a text to its number of tokens."""
    piece = regex.compile(PIECE)

    @lru_cache(REMEMBERED)
    def of_short(word: str) -> int:
        return len(merged(word.encode(), ranks))

    def count(text: str) -> int:
        return sum(of_short(w) if len(w) <= 64 else len(merged(w.encode(), ranks)) for w in piece.findall(text))

    return count


def count_tokens(text: Column, ranks: Ranks) -> Column:
    """Number of tokens of a text, null for a null text."""
    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = token_counter(ranks)
        return pd.Series([None if t is None else count(t) for t in texts], dtype="Int64")

    return counted(text)
