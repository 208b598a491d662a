"""Exact top-k search by MaxScore over integer vectors.

A query's terms are its dimensions; the postings of a dimension are the components of all items there. In each
block of items every term has a score bound, the largest product its postings allow. With the k-th best score so far
as the bar, the terms with the smallest bounds that cannot reach it together, beside what the others can add, are
the non-essential ones: the essential postings are traversed for every item, and the others are probed, largest bound
first, only while an item can still reach the bar. Scores are exact integers, so ties (smaller id first) are exact.

Queries are cut into blocks of ``query_rows`` and items into blocks of ``item_rows``; each pair of blocks is one bounded
group, and only its best k per query leave it. The shards are merged by a window that limits before its shuffle.

Rows: vectors that are null or hold null, NaN or infinite components take no part; neither do null ids. An item is
not compared with the query of the same id. Vectors of unlike length are compared over the dimensions both have. Repeated
rows are items each and queries each: every one of them has a list of its own. Empty tables give an empty result; further
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscolake.llm.common import given
from fiscolake.session import written_table

QUERY_ROWS, ITEM_ROWS = 1024, 8192
STEP = 256    # items scored between two looks at the bar
PROBE = 8     # dimensions probed between two looks at what is competitive


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, items: np.ndarray, item_ids: np.ndarray,
                  k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, item id, score) of each query's best k items of a block; ties to smaller ids."""
    order = np.argsort(item_ids, kind="stable")
    items, item_ids = items[order], item_ids[order]
    high, low = items.max(0), items.min(0)
    out: list[tuple[np.ndarray, ...]] = []
    for row, (query, own) in enumerate(zip(queries, query_ids)):
        bounds = np.maximum(query * high, query * low)
        terms = np.argsort(-bounds, kind="stable")
        query, columns, bounds = query[terms], items[:, terms], bounds[terms]
        # What all terms from a place on can add at most.
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start in range(0, len(items), STEP):
            bar = scores[-1] if len(scores) == k else None
            part = np.flatnonzero(item_ids[start:start + STEP] != own) + start
            # Essential: the fewest leading terms such that the others alone stay below the bar.
            essential = len(query) if bar is None else int(np.searchsorted(-rest, -bar, side="right"))
            essential = min(max(essential, 1), len(query))
            got = columns[part, :essential] @ query[:essential]
            at = essential
            while at < len(query) and len(part):
                fit = got + rest[at] >= bar
                part, got = part[fit], got[fit]
                upto = min(at + PROBE, len(query))
                got = got + columns[part, at:upto] @ query[at:upto]
                at = upto
            ids, scores = np.concatenate((ids, item_ids[part])), np.concatenate((scores, got))
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        out.append((np.full(len(ids), row), ids, scores))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


def top_k(queries: DataFrame, items: DataFrame, k: int, *, query_rows: int = QUERY_ROWS,
          item_rows: int = ITEM_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) from (id: long, v: array<long>) rows of queries and items."""
    n_queries, n_items = queries.count(), items.count()
    of_query = max(1, -(-n_queries // query_rows))
    of_item = max(1, -(-n_items // item_rows))

    def dealt(frame: DataFrame, blocks: int) -> DataFrame:
        # By row and not by id, so that rows of one id neither share a block nor a list.
        numbered = frame.select("id", "v", F.monotonically_increasing_id().alias("row"))
        return numbered.select("*", F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).alias("own"))

    asked = dealt(queries, of_query).select("id", "v", "row", F.col("own").alias("q"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(of_item - 1).cast("long"))).alias("i"))
    held = dealt(items, of_item).select("id", "v", F.col("own").alias("i"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(of_query - 1).cast("long"))).alias("q"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = min(len(v) for v in (*left["v"], *right["v"]))
        wide = max(len(v) for v in (*left["v"], *right["v"]))

        def matrix(rows: pd.Series) -> np.ndarray:
            if width == wide:
                return np.stack(rows.to_numpy()).astype(np.int64)
            return np.stack([np.pad(np.asarray(v, np.int64), (0, wide - len(v))) for v in rows])

        ids = left["id"].to_numpy(np.int64)
        row, item, score = best_of_block(matrix(left["v"]), ids, matrix(right["v"]), right["id"].to_numpy(np.int64), k)
        return pd.DataFrame({"row": left["row"].to_numpy(np.int64)[row], "query_id": ids[row], "vec_id": item, "score": score})

    shards = asked.groupBy("q", "i").cogroup(held.groupBy("q", "i")).applyInPandas(
        search, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (shards.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def quantised(vectors: DataFrame) -> DataFrame:
    """(id, v) with v = floor(1024 * x) of whole vectors of finite components."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter("vec_id IS NOT NULL").filter(whole).select(
        F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * 1024)).alias("v"))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = written_table(quantised(given(spark, sf_dir, "embeddings")), "vectors")
    return top_k(items.filter("id % 100 = 0"), items, 10)


OP2_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS row, CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
    SELECT q.row, q.id AS query_id, i.id AS vec_id, CAST(list_inner_product(q.v, i.v) AS BIGINT) AS score
    FROM v q JOIN v i ON q.id % 100 = 0 AND q.id <> i.id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM ranked) x
WHERE rank <= 10
"""
