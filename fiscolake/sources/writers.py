"""Sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fiscolake.schemas import ALL_TABLES, COLLECTION_SCHEMA, DECLARED_TABLES
from fiscolake.sources.store import Change, collection_store


def write_csv_tables(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """The served tables as CSV with header, one folder each."""
    paths = {}
    for name in ALL_TABLES:
        if name in tables:
            paths[name] = f"{folder}/{name}"
            (tables[name].write.mode("overwrite").option("header", True)
             .option("escape", '"').csv(paths[name]))
    return paths


def save_tables(tables: Mapping[str, DataFrame], database: str | None = None) -> list[str]:
    """Create or replace the served tables in the catalog, one write per table."""
    names = []
    for name, df in tables.items():
        full = f"{database}.{name}" if database else name
        df.write.mode("overwrite").saveAsTable(full)
        names.append(full)
    return names


def declare_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Declare the six empty tables of a fresh installation, unless the table of
    returns is there already. Keys are checked on the data, not by the tables."""
    prefix = f"{database}." if database else ""
    if spark.catalog.tableExists(prefix + "declarations"):
        return []
    for name, columns in DECLARED_TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet")
    return list(DECLARED_TABLES)


def with_created_at(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", F.current_timestamp())


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Records as JSON lines; returns how many, counted by the write itself."""
    counted = Observation()
    (df.observe(counted, F.count(F.lit(1)).alias("n_rows"))
     .write.mode(mode).option("ignoreNullFields", "false").json(path))
    return counted.get["n_rows"]


def write_manifest(processed: DataFrame, path: str, gone: DataFrame | None = None) -> None:
    """Add processed files to the manifest as a new part; the newest entry of a
    path counts, so nothing that is being read is replaced. Files that are gone
    get an entry without time of change."""
    entries = processed.select("path", "modified_at")
    if gone is not None:
        entries = entries.unionByName(gone.select("path", F.lit(None).cast("timestamp").alias("modified_at")))
    entries.withColumn("processed_at", F.current_timestamp()).write.mode("append").parquet(path)


def upsert_chunks(changed: DataFrame, doc_ids: DataFrame, path: str, buckets: int | None = None) -> int:
    """Replace the stored chunks of the given documents by ``changed``; returns how many chunks were written.

    Chunks and ids may name, as ``source``, the file a document was read from; chunks are then replaced by file. The
    update appends and reads nothing stored, see ``sources/store.py``; ``buckets`` is into how many files it deals its chunks.
    """
    def source(df: DataFrame):
        return F.col("source" if "source" in df.columns else "doc_id").cast("string").alias("source")

    columns = [part.split()[0] for part in COLLECTION_SCHEMA.split(", ")]
    change = Change(changed.select(*columns, source(changed)), doc_ids.select(source(doc_ids)))
    return collection_store(changed.sparkSession, path).update({"chunks": change}, buckets)["chunks"]
