"""Exact best matches of many queries in a large set, without a row per pair.

Scores are worked out for a block of queries against a block of items at once;
only the best ``k`` items of a query leave a block, and a second step takes the
best of these. A query set small enough goes to every task whole. A larger one
is cut into blocks, and so are the items; each pair of blocks is then one group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scorer: pandas queries and items to a matrix with a row per query. A score that
# is not finite is no hit.
Scorer = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]

DIGITS = 6
MAX_SHARED_QUERIES = 4096
MAX_SHARED_BYTES = 16 << 20
ITEMS_PER_BLOCK = 50_000
BYTES_PER_BLOCK = 64 << 20
_CELLS = 1_000_000
_ROWS = 4096


def _best(queries: pd.DataFrame, items: pd.DataFrame, score: Scorer, k: int,
          positive_only: bool) -> pd.DataFrame:
    """Best ``k`` items of every query; equal scores go by item id."""
    ids, keys = queries["query_id"].to_numpy(), items["item_id"].to_numpy()
    found, rows = [], 0
    step = max(1, min(_ROWS, _CELLS // max(1, len(ids))))
    for at in range(0, len(keys) if len(ids) else 0, step):
        part = items.iloc[at:at + step]
        scores = np.round(score(queries, part), DIGITS)
        n = scores.shape[1]
        floor = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else scores.min(axis=1)
        mask = (scores >= floor[:, None]) & np.isfinite(scores)
        if positive_only:
            mask &= scores > 0
        q, i = np.nonzero(mask)
        found.append(_head(pd.DataFrame({
            "query_id": ids[q], "item_id": keys[at:at + step][i], "score": scores[q, i]}), k))
        rows += len(found[-1])
        if rows > _CELLS and len(found) > 1:
            found = [_head(pd.concat(found, ignore_index=True), k)]
            rows = len(found[0])
    if not found:
        return pd.DataFrame({"query_id": ids[:0], "item_id": keys[:0], "score": np.zeros(0)})
    return _head(pd.concat(found, ignore_index=True), k)


def _head(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = hits.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)


def best_matches(queries: DataFrame, items: DataFrame, score: Scorer, k: int, *,
                 query_bytes: Column, item_bytes: Column, positive_only: bool = False,
                 max_shared_queries: int = MAX_SHARED_QUERIES,
                 max_shared_bytes: int = MAX_SHARED_BYTES,
                 items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``query_id, item_id, score, rank`` of the ``k`` best items of every query.

    ``queries`` has ``query_id`` and ``items`` has ``item_id``; their other
    columns are what ``score`` works on. ``query_bytes`` and ``item_bytes`` are the
    sizes of a query and of an item; both are summed up before anything is held
    in one place.
    """
    spark = queries.sparkSession
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("item_id", items.schema["item_id"].dataType),
        T.StructField("score", T.DoubleType())])

    def measured(df: DataFrame, bytes_of: Column):
        return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(bytes_of), F.lit(0)).alias("b")).first()

    size = measured(queries, query_bytes)

    if size.n <= max_shared_queries and size.b <= max_shared_bytes:
        shared = spark.sparkContext.broadcast(queries.toPandas())

        def match(batches):
            held = None
            for batch in batches:
                hits = _best(shared.value, batch, score, k, positive_only)
                held = hits if held is None else _head(pd.concat([held, hits], ignore_index=True), k)
            if held is not None:
                yield held

        hits = items.mapInPandas(match, schema)
    else:
        def blocks_of(n: int, b: int, rows: int, limit: int) -> int:
            return max(1, -(-n // rows), -(-b // limit))

        stock = measured(items, item_bytes)
        n_query_blocks = blocks_of(size.n, size.b, max_shared_queries, max_shared_bytes)
        n_item_blocks = blocks_of(stock.n, stock.b, items_per_block, BYTES_PER_BLOCK)

        def blocks(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
            return (df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int"))
                    .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))

        left = blocks(queries, "query_id", "_qb", n_query_blocks, "_ib", n_item_blocks)
        right = blocks(items, "item_id", "_ib", n_item_blocks, "_qb", n_query_blocks)

        def match_blocks(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
            return _best(q, i, score, k, positive_only)

        hits = (left.groupBy("_qb", "_ib").cogroup(right.groupBy("_qb", "_ib"))
                .applyInPandas(match_blocks, schema))
    return ranked(hits, k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per query; tasks drop what cannot be among them before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
