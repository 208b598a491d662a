"""Keys that hold a large share of the rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fiscolake.operators import retrieve
from fiscolake.operators.validate import without_rejected
from fiscolake.plans import analytics
from fiscolake.schemas import table_schema


@pytest.fixture
def small_skew(spark):
    """Make adaptive execution see skew on test-sized data."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _lines(spark, n=60_000):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string"))
    return spark.range(0, n, 1, 16).select(
        key.alias("declaration_id"), F.concat(F.lit("Fonte "), "id").alias("nome_fonte_pagadora"),
        F.when(F.col("id") % 3 == 1, 0).otherwise(F.col("id")).cast("decimal(14,2)").alias("rendimentos"))


def _declarations(spark):
    ids = spark.range(500).select(F.col("id").cast("string").alias("declaration_id")).union(
        spark.createDataFrame([("hot",)], "declaration_id string"))
    return ids.select("declaration_id", F.lit("p").alias("file_path"),
                      F.concat("declaration_id", F.lit(".xml")).alias("file_name"), F.lit("s").alias("summary"))


def _final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_of_a_hot_return_is_split(spark, small_skew):
    found = analytics.salary_income({"rendimentos_tributaveis_pj": _lines(spark),
                                     "declarations": _declarations(spark)})
    rows = found.collect()
    assert "skew=true" in _final_plan(found)
    assert len(rows) == 60_000 and sum(r.file_name == "hot.xml" for r in rows) == 20_000
    assert [r.rendimentos for r in rows] == sorted((r.rendimentos for r in rows), reverse=True)


def test_anti_join_of_a_hot_return_is_split(spark, small_skew):
    rejects = spark.createDataFrame([("1",), ("2",)], "declaration_id string")
    kept = without_rejected(_lines(spark), rejects)
    n = len(kept.collect())
    assert "skew=true" in _final_plan(kept)
    assert n == _lines(spark).where("declaration_id NOT IN ('1', '2')").count()


def test_a_value_many_rows_share_is_spread_by_the_sort(spark):
    """A third of the amounts is zero; no sorted partition gets them all."""
    rows = _lines(spark, 30_000)
    tables = {"rendimentos_tributaveis_pj": rows,
              "rendimentos_exclusivos": spark.createDataFrame([], table_schema("rendimentos_exclusivos")),
              "rendimentos_isentos": spark.createDataFrame([], table_schema("rendimentos_isentos"))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = (analytics.income_sources(tables).withColumn("p", F.spark_partition_id())
             .groupBy("p").agg(F.count("*").alias("n"), F.count_if(F.col("valor") == 0).alias("zeros")).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r.n for r in parts) == 30_000
    assert max(r.zeros for r in parts) < 10_000


def test_one_category_with_most_payments(spark):
    rows = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 3 > 0, "01").otherwise("02").alias("codigo"),
                                               F.lit("1.10").cast("decimal(14,2)").alias("valor_pago"))
    got = analytics.payments_by_category({"pagamentos_efetuados": rows})
    assert [tuple(r) for r in got.collect()] == [("01", Decimal("22000.00")), ("02", Decimal("11000.00"))]


def test_many_equal_copies_in_retrieval(spark):
    """A third of the items are copies; ties go by id, on both ways."""
    items = spark.range(0, 3000, 1, 6).select(
        F.col("id").alias("item_id"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0)))
        .otherwise(F.array(F.lit(0.5), F.col("id") / 1e5)).cast("array<float>").alias("embedding"))
    asked = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query_id int, embedding array<float>")
    for limits in ({}, {"max_shared_queries": 2, "items_per_block": 500}):
        hits = retrieve.vector_topk(asked, items, 3, **limits)
        assert {(r.query_id, r.item_id) for r in hits.collect()} == {(q, i) for q in range(5) for i in (0, 3, 6)}


def test_a_term_in_every_document(spark):
    docs = spark.range(0, 3000, 1, 6).select(
        F.col("id").alias("item_id"), F.concat(F.lit("comum w"), (F.col("id") % 700).cast("string")).alias("text"))
    asked = spark.createDataFrame([(1, "comum w5"), (2, "comum")], "query_id int, text string")
    hits = {(r.query_id, r["rank"]): r.item_id for r in retrieve.bm25_topk(asked, docs, 2).collect()}
    assert hits == {(1, 1): 5, (1, 2): 705, (2, 1): 0, (2, 2): 1}
