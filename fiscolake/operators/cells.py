"""Exact nearest vectors with a coarse index: cells of a distributed k-means, passed over by a bound.

Every vector lies in the cell of its nearest centre, and a cell knows its radius, the largest distance of one of its vectors
from the centre. By the triangle inequality no vector x of a cell scores more with a query q than ``q·c + |q| r``. For each
query the cells that promise most are searched first; the k-th best score found there is a floor, and only cells whose
bound reaches it are searched besides. So the result is that of comparing with every vector.

A cell with very many vectors (many copies, say) is cut into parts, and so are many queries of one cell; a group
is one part against one block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscolake.operators.topk import DIGITS, ITEMS_PER_BLOCK, MAX_SHARED_QUERIES, Scorer, _best, ranked
from fiscolake.session import written_table

#: Centres go to every task and to the driver; this bounds them whatever the collection.
MAX_CELLS = 1024
ROUNDS = 4
#: Queries whose bounds for all cells are held at once.
BOUNDED = 256
SLACK = 2 * 10.0 ** -DIGITS


@dataclass(frozen=True)
class Cells:
    """``items`` is a table of ``cell, part, item_id, embedding``; ``cells`` one of ``cell, n, radius, parts``."""
    centres: np.ndarray
    items: DataFrame
    cells: DataFrame


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and its distance."""
    squares = (centres * centres).sum(axis=1) - 2 * vectors @ centres.T
    cell = squares.argmin(axis=1)
    return cell, np.sqrt(((vectors - centres[cell]) ** 2).sum(axis=1))


def _moved(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centres after one round: the means of their vectors. Sums are made in the tasks, then per cell."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(centres), np.zeros(len(centres))
        for b in batches:
            x = _stacked(b["embedding"])
            cell = _nearest(x, centres)[0]
            np.add.at(total, cell, x)
            n += np.bincount(cell, minlength=len(n))
        met = np.flatnonzero(n)
        if len(met):
            yield pd.DataFrame({"cell": met, "n": n[met], "total": list(total[met])})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": key, "mean": [_stacked(rows["total"]).sum(axis=0) / rows["n"].sum()]})

    means = (vectors.mapInPandas(sums, "cell long, n double, total array<double>")
             .groupBy("cell").applyInPandas(add, "cell long, mean array<double>"))
    moved = centres.copy()
    for row in means.toLocalIterator():  # at most MAX_CELLS
        moved[row["cell"]] = row["mean"]
    return moved


def build_cells(vectors: DataFrame, n_cells: int | None = None, rounds: int = ROUNDS, part_size: int = ITEMS_PER_BLOCK) -> Cells:
    """Index ``item_id, embedding``; items without a vector, or with one that is not finite, are left out. The number of
    cells is the root of that of the vectors, ``MAX_CELLS`` at most."""
    good = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('inf'))"
    given = written_table(vectors.select("item_id", "embedding").where(good), "vectors")
    n = given.count()
    wanted = min(n_cells or max(1, int(n ** 0.5)), MAX_CELLS)
    # Vectors drawn by a digest of their ids, so that the index is the same in every run.
    drawn = given.orderBy(F.xxhash64("item_id"), "item_id").limit(wanted).select("embedding").toPandas()["embedding"]
    centres = np.unique(_stacked(drawn), axis=0) if n else np.zeros((0, 0))
    for _ in range(rounds if n else 0):
        centres = _moved(given, centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, distance = _nearest(_stacked(b["embedding"]), centres)
            yield b.assign(cell=cell, distance=distance)

    kind = given.schema["item_id"].dataType.simpleString()
    placed = written_table(given.mapInPandas(
        place, f"item_id {kind}, embedding {given.schema['embedding'].dataType.simpleString()}, cell long, distance double"), "placed")
    # Distances are rounded, so the radius gets a little more.
    cells = written_table(placed.groupBy("cell").agg(
        F.count("*").alias("n"), (F.max("distance") * (1 + 1e-9) + 1e-9).alias("radius")
    ).withColumn("parts", F.ceil(F.col("n") / part_size)), "cells")
    parts = placed.join(F.broadcast(cells.select("cell", "parts")), "cell")  # MAX_CELLS rows
    items = written_table(parts.select("cell", F.pmod(F.xxhash64("item_id"), F.col("parts")).alias("part"), "item_id", "embedding"), "cell_items")
    return Cells(centres, items, cells)


def cells_to_read(queries: DataFrame, index: Cells, k: int, floors: DataFrame | None = None) -> DataFrame:
    """``query_id, embedding, cell, parts``. Without floors (``query_id, least``), each query's cells of highest bound that
    hold ``k`` vectors; with floors, all others whose bound reaches the floor."""
    known = index.cells.orderBy("cell").toPandas()
    centres = index.centres[known["cell"].to_numpy()]
    further = floors is not None
    number, n, radius = (known[c].to_numpy() for c in ("cell", "n", "radius"))

    @F.pandas_udf("array<long>")
    def choose(embedding: pd.Series, least: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(embedding), BOUNDED):
            q, floor = _stacked(embedding.iloc[at:at + BOUNDED]), least.iloc[at:at + BOUNDED].to_numpy()
            bound = q @ centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius[None, :]
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            first = np.zeros(bound.shape, dtype=bool)
            np.put_along_axis(first, order, before < k, axis=1)
            if further:
                first = ~first & (bound >= floor[:, None] - SLACK)
            out += [number[row] for row in first]
        return pd.Series(out, dtype=object)

    asked = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    # A query that found fewer than k has no floor: all its cells are read already or may hold more.
    asked = (asked.withColumn("least", F.lit(float("-inf"))) if floors is None else
             asked.join(floors, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))))
    # A query has one row, with its cells; a row per cell would hold its vector as often.
    chosen = written_table(asked.select("query_id", "embedding", choose("embedding", "least").alias("cells")), "chosen")
    return (chosen.select("query_id", "embedding", F.explode("cells").alias("cell"))
            .join(F.broadcast(index.cells.select("cell", "parts")), "cell").select("query_id", "embedding", "cell", "parts"))


def _hits(chosen: DataFrame, index: Cells, k: int, score: Scorer, blocks: int) -> DataFrame:
    schema = T.StructType([T.StructField("query_id", chosen.schema["query_id"].dataType),
                           T.StructField("item_id", index.items.schema["item_id"].dataType), T.StructField("score", T.DoubleType())])
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    left = chosen.select("query_id", "embedding", F.col("cell").alias("in_cell"), block,
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("in_part"))
    right = index.items.join(chosen.select("cell").distinct(), "cell", "left_semi").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def match(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        return _best(q, i, score, k, False)

    return (left.groupBy("in_cell", "in_part", "block").cogroup(right.groupBy("cell", "part", "block"))
            .applyInPandas(match, schema))


def best_by_cells(queries: DataFrame, index: Cells, k: int, score: Scorer, block_size: int = MAX_SHARED_QUERIES) -> DataFrame:
    """``query_id, item_id, score, rank`` of the ``k`` best items of each query (``query_id, embedding``)."""
    if not len(index.centres):
        kinds = [f"{c} {f.schema[c].dataType.simpleString()}" for f, c in ((queries, "query_id"), (index.items, "item_id"))]
        return queries.sparkSession.createDataFrame([], ", ".join(kinds) + ", score double, rank int")
    blocks = max(1, -(-queries.count() // block_size))
    some = written_table(_hits(cells_to_read(queries, index, k), index, k, score, blocks), "some")
    floors = (ranked(some, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found"))
              .where(F.col("found") == k).select("query_id", "least"))
    more = _hits(cells_to_read(queries, index, k, written_table(floors, "floors")), index, k, score, blocks)
    return ranked(some.unionByName(more), k)
