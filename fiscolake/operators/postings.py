"""BM25 over blocks of postings, of which only those that can matter are taken apart.

A block holds some postings of one term that are worth about the same, and the most any of them is worth. For each query

1. the best blocks of its terms give some items; their exact scores give a floor, the k-th best of them;
2. terms are put in order of the most they can add. The cheapest ones, which together stay below the floor, are not
   essential: an item found by them alone is no hit;
3. blocks of essential terms are taken apart unless the most they are worth and the most of all other terms stay below the
   floor; items whose sum cannot reach it any more go;
4. what the other terms add to the items left is looked up by item and term.

A hit of the whole collection reaches the floor in each of its blocks, so the result is that of scoring everything; no
pair without a common term is ever made. Postings of a common term lie in many blocks, each bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscolake.operators.topk import DIGITS, ranked
from fiscolake.session import written_table

BLOCK_SIZE = 128
#: Steps of worth by which the postings of a term are parted before they are cut into blocks.
LEVELS = 32
#: Items per hit asked for that are scored to find the floor.
FIRST = 4
#: Scores count rounded, so a bound is below the floor only if it is so by more than this.
SLACK = 2 * 10.0 ** -DIGITS
#: Items up to which postings are held against them before they are shuffled.
FEW_ITEMS = 200_000


def posting_blocks(index: DataFrame, size: DataFrame, *, k1: float, b: float, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``term, most, n, items`` (an array of ``item_id, w``) from postings (``item_id, n_terms, term, tf``) and the size of
    the collection. Worths leave out how rare the term is, which changes with every document."""
    tf, mean_length = F.col("tf").cast("double"), size.select("mean_length").scalar()
    worth = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n_terms") / mean_length))
    rated = (index.select("term", "item_id", worth.alias("w"))
             .withColumn("level", F.floor(F.col("w") * (LEVELS / (k1 + 1)))))
    # Postings are shuffled once: numbered within term and level, where they are also put together.
    by_item = Window.partitionBy("term", "level").orderBy("item_id")
    part = F.floor((F.row_number().over(by_item) - 1) / block_size)
    return (rated.withColumn("part", part).groupBy("term", "level", "part")
            .agg(F.max("w").alias("most"), F.count("*").alias("n"), F.collect_list(F.struct("item_id", "w")).alias("items"))
            .select("term", "most", "n", "items"))


def rarity(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def _weighted(asked: DataFrame, blocks: DataFrame, size: DataFrame) -> DataFrame:
    """``query_id, term, weight, bound``: what a worth of one counts for the query, and the most the term can add."""
    stats = (blocks.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term")
             .agg(F.sum("n").alias("df"), F.max("most").alias("top")))
    idf = rarity(size.select("n_docs").scalar(), F.col("df"))
    return asked.join(stats, "term").select("query_id", "term", (F.col("n") * idf).alias("weight"),
                                            (F.col("n") * idf * F.col("top")).alias("bound"))


def _postings(blocks: DataFrame) -> DataFrame:
    return blocks.select("*", F.explode("items").alias("i")).select(
        *[c for c in blocks.columns if c not in ("items", "n", "most")], "i.*")


def _looked_up(pairs: DataFrame, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """``query_id, item_id, s``: what the terms of a query add together to the items paired with it. Pairs meet the postings of
    their item; which of these are their query's is told there, so that no row per pair and term is shuffled."""
    own = _postings(blocks.join(terms.select("term").distinct(), "term", "left_semi"))
    items = written_table(pairs.select("item_id").distinct(), "items")
    if items.count() <= FEW_ITEMS:
        own = own.join(F.broadcast(items), "item_id", "left_semi")
    met = pairs.select("query_id", "item_id").join(own, "item_id").join(terms.select("query_id", "term", "weight"), ["query_id", "term"])
    return met.groupBy("query_id", "item_id").agg(F.sum(F.col("weight") * F.col("w")).alias("s"))


def _floors(terms: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``query_id, least``: a score that ``k`` items of the query reach; no row where that many were not found."""
    by_worth = Window.partitionBy("term").orderBy(F.desc("most"))
    best = (blocks.join(terms.select("term").distinct(), "term", "left_semi")
            .withColumn("r", F.row_number().over(by_worth)).where(F.col("r") <= k).drop("r"))
    met = (_postings(best).join(terms, "term").groupBy("query_id", "item_id")
           .agg(F.sum(F.col("weight") * F.col("w")).alias("score")))
    some = written_table(ranked(met, FIRST * k).select("query_id", "item_id"), "first")
    exact = _looked_up(some, terms, blocks).groupBy("query_id", "item_id").agg(F.sum("s").alias("score"))
    return (ranked(exact, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found"))
            .where(F.col("found") == k).select("query_id", "least"))


def essential_terms(asked: DataFrame, blocks: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """``query_id, term, weight, bound, least, essential, rest, cheap``: each query's terms with its floor, the most its
    other terms can add (``rest``) and the most those that are not essential can add (``cheap``)."""
    terms = written_table(_weighted(asked, blocks, size), "terms")
    upward = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("query_id")
    judged = (terms.join(_floors(terms, blocks, k), "query_id", "left")
              .withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
              .withColumn("essential", F.sum("bound").over(upward) >= F.col("least")))
    return written_table(judged.select("*", (F.sum("bound").over(every) - F.col("bound")).alias("rest"), F.coalesce(
        F.sum(F.when(~F.col("essential"), F.col("bound"))).over(every), F.lit(0.0)).alias("cheap")), "judged")


def blocks_to_read(judged: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks of essential terms that can hold a hit, once for each query they can hold one for."""
    wanted = judged.where("essential").select("query_id", "term", "weight", "least", "rest", "cheap")
    return blocks.join(wanted, "term").where(F.col("weight") * F.col("most") + F.col("rest") >= F.col("least"))


def best_by_blocks(asked: DataFrame, blocks: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """``query_id, item_id, score, rank`` of the ``k`` best items of each query; ``asked`` has ``query_id, term, n``."""
    judged = essential_terms(asked, blocks, size, k)
    found = _postings(blocks_to_read(judged, blocks)).groupBy("query_id", "item_id").agg(
        F.sum(F.col("weight") * F.col("w")).alias("s"), F.any_value("least").alias("least"), F.any_value("cheap").alias("cheap"))
    left = written_table(found.where(F.col("s") + F.col("cheap") >= F.col("least")).select("query_id", "item_id", "s"), "left")
    added = _looked_up(left, judged.where("NOT essential"), blocks)
    scores = left.unionByName(added).groupBy("query_id", "item_id").agg(F.round(F.sum("s"), DIGITS).alias("score"))
    return ranked(scores.where("score > 0"), k)
