"""What tables are there, and what is in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.schemas import INCOME_TABLES

REPORT_SCHEMA = "table_name string, table_exists boolean, n_rows bigint, status string, sample array<string>"
SAMPLE_ROWS = 3


def list_tables(spark: SparkSession) -> DataFrame:
    names = [(t.name,) for t in spark.catalog.listTables()]
    return spark.createDataFrame(names, "table_name string").orderBy("table_name")


def existing(spark: SparkSession, names: tuple[str, ...] = INCOME_TABLES) -> DataFrame:
    """Which of the tables exist."""
    rows = [(n, spark.catalog.tableExists(n)) for n in names]
    return spark.createDataFrame(rows, "table_name string, table_exists boolean")


def table_report(spark: SparkSession, names: tuple[str, ...] = INCOME_TABLES) -> DataFrame:
    """Per table: does it exist, how many rows, and three of them as JSON.

    The sample is the first three rows in the order of all columns, so that it
    can be repeated; it is taken by a top-k in every task, not by a sort.
    """
    reports = []
    for name in names:
        if not spark.catalog.tableExists(name):
            reports.append(spark.createDataFrame([(name, False, None, "missing", None)], REPORT_SCHEMA))
            continue
        table = spark.table(name)
        sample = (table.orderBy(*table.columns).limit(SAMPLE_ROWS)
                  .agg(F.sort_array(F.collect_list(
                      F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}))).alias("sample")))
        counted = table.agg(F.count("*").alias("n_rows")).scalar()
        reports.append(sample.select(
            F.lit(name).alias("table_name"), F.lit(True).alias("table_exists"),
            counted.alias("n_rows"),
            F.when(counted == 0, "empty").otherwise("filled").alias("status"), "sample"))
    return reduce(DataFrame.unionByName, reports)
