"""Which files are new or changed since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.schemas import MANIFEST_SCHEMA
from fiscolake.sources.readers import path_exists


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Newest entry of every processed path that is not gone; empty before the
    first run."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    entries = spark.read.schema(MANIFEST_SCHEMA).parquet(path)
    newest = F.max_by(F.struct("modified_at", "processed_at"), "processed_at").alias("e")
    return entries.groupBy("path").agg(newest).select("path", "e.*").where("modified_at IS NOT NULL")


def changed_files(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files missing from the manifest or modified after the version it lists.

    ``change`` is ``new``, ``modified`` or, when forced, ``unchanged``.
    """
    known = manifest.select("path", F.col("modified_at").alias("_seen"))
    change = (F.when(F.col("_seen").isNull(), "new")
              .when(F.col("modified_at") > F.col("_seen"), "modified")
              .otherwise("unchanged"))
    marked = files.join(known, "path", "left").withColumn("change", change).drop("_seen")
    return marked if force else marked.where("change <> 'unchanged'")


def removed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries whose file is gone."""
    return manifest.join(files.select("path"), "path", "left_anti")
