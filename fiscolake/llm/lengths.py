"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Each text is encoded whole by a public tokenizer (its file is a parameter) and only its length is kept. Lengths are
counted before the shuffle, so the result of the one pass is a table of (length, documents), small whatever the corpus.
Suffix sums over it give, for every length L that occurs: documents and tokens at L or more, the total with every
document cut at L, and the share of documents at most that long. ``totals`` and ``quantiles`` answer any limit.

Rows: null and empty texts have length 0 and count as documents. Repeated rows count each; ids are not looked at. An
empty table gives an empty histogram. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscolake.llm.common import given, small_batches
from fiscolake.session import written_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Word pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Lengths per bucket of the two-level suffix sums.
BUCKET = 1024
_encoders: dict = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    """The encoder of a vocabulary of ranks, made once per process."""
    import tiktoken

    if path not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def n_tokens(path: str = VOCABULARY, pattern: str = PATTERN):
    """A function of the text column: its encoded length."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(path, pattern).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def histogram(docs: DataFrame, *, by: Sequence[str] = (), path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(by..., n_tokens, docs): how many documents have each length."""
    return docs.select(*by, n_tokens(path, pattern)("text").alias("n_tokens")).groupBy(*by, "n_tokens").agg(
        F.count("*").alias("docs"))


def suffix_sums(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds docs_from, tokens_from (lengths >= n_tokens), truncated_total and docs_share to a histogram.

    Sums run within buckets of 1,024 lengths, and over the buckets' totals, so that no task holds more than those."""
    by = list(by)
    lengths = counts.withColumns({"bucket": F.floor(F.col("n_tokens") / BUCKET), "mass": F.col("n_tokens") * F.col("docs")})
    buckets = lengths.groupBy(*by, "bucket").agg(F.sum("docs").alias("d"), F.sum("mass").alias("t"))
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*(by or [F.lit(0)]))
    buckets = buckets.select(*by, "bucket", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"),
                             F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"),
                             F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"))
    renamed = buckets.select(*[F.col(c).alias(f"__{c}") for c in (*by, "bucket")], "d", "t", "all_docs", "all_tokens")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("bucket") == F.col("__bucket")]
    joined = lengths.join(renamed, same)
    within = Window.partitionBy(*by, "bucket").orderBy(F.desc("n_tokens"))
    return (joined.withColumns({"docs_from": F.col("d") + F.sum("docs").over(within),
                                "tokens_from": F.col("t") + F.sum("mass").over(within)})
            .select(*by, "n_tokens", "docs", "docs_from", "tokens_from",
                    (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_total"),
                    ((F.col("all_docs") - F.col("docs_from") + F.col("docs")) / F.col("all_docs")).alias("docs_share")))


def totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context, docs_over, truncated_total) for any context limits, from the sums without ``by`` columns."""
    asked = [F.struct(F.lit(int(c)).cast("long").alias("context"),
                      F.coalesce(F.max(F.when(F.col("n_tokens") > c, F.col("docs_from"))), F.lit(0)).alias("docs_over"),
                      (F.coalesce(F.max(F.when(F.col("n_tokens") > c, F.col("docs_from"))), F.lit(0)) * c
                       + F.coalesce(F.sum(F.when(F.col("n_tokens") <= c, F.col("n_tokens") * F.col("docs"))), F.lit(0))
                       ).alias("truncated_total")) for c in limits]
    return sums.agg(F.array(*asked).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents does not exceed."""
    asked = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("docs_share") >= q, F.col("n_tokens"))).alias("n_tokens"))
             for q in shares]
    return sums.agg(F.array(*asked).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def op1_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole histogram by source, with its suffix sums."""
    small_batches(spark)
    counts = written_table(histogram(given(spark, sf_dir, "documents"), by=["source"]), "lengths")
    return suffix_sums(counts, by=["source"])
