"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscolake.session import written_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest of itself and its neighbours to its larger neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.filter("b > a").join(least, F.col("a") == F.col("u"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to itself and its other smaller neighbours."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    handed = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); a component is named by its smallest node.

    Steps end when they change nothing: then each node has one edge, to its smallest. A step is written to the shared
    folder, and one row of sums comes to the driver. Minima combine before the shuffle; the joins with them are
    inner joins that adaptive execution splits when a node has very many edges.
    """
    now = written_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), "edges")
    marks = F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))
    mark = now.agg(*marks).first()
    while mark[0]:
        now = written_table(_small_star(_large_star(now)), "edges")
        before, mark = mark, now.agg(*marks).first()
        if before == mark:
            break
    names = now.groupBy("b").agg(F.lit(1).alias("x")).select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(names)
