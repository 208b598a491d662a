"""Readers: every source comes with an explicit schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscolake.functions import scalars as S
from fiscolake.functions.files import file_name, file_path
from fiscolake.operators.shred import json_digest, json_returns
from fiscolake.schemas import CORRUPT, json_reading_schema, table_schema
from fiscolake.sources.filesystem import delete_folder, path_exists  # noqa: F401 (part of the readers)
from fiscolake.sources.store import collection_store

# The extensions a knowledge folder is searched for.
KNOWLEDGE_EXTENSIONS = (".pdf", ".json", ".txt", ".doc", ".docx")
TEXT_EXTENSIONS = (".txt", ".html", ".htm", ".md")


#: Changed files read by name; more are found by reading the folder's files of their times.
MAX_NAMED = 10_000


def paths_to_read(changed: DataFrame, folder: str) -> list[str] | str:
    """What to read for the changed files: their names, or the folder where they are more than the driver should hold.
    Reading the folder needs ``only_changed`` behind it."""
    named = [r.path for r in changed.select("path").limit(MAX_NAMED + 1).collect()]
    if len(named) > MAX_NAMED:
        return folder
    return [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in named]  # names, no patterns


def only_changed(rows: DataFrame, changed: DataFrame, path: str = "source_path") -> DataFrame:
    """Rows of changed files."""
    return rows.join(changed.select(F.col("path").alias(path)), path, "left_semi")


def read_json_returns(spark: SparkSession, path: str | list[str], *, key: Column | None = None,
                      multi_line: bool = True, once: bool = True, pattern: str = "*") -> DataFrame:
    """Nested returns from JSON files. A record's own ``file_path`` and
    ``file_name``, those of the document it was extracted from, come before the
    JSON file's; ``source_path`` is the JSON file. Folders are read with all below
    them. Under the default key a record repeated in a file comes out once (unless ``once`` is false). A record that is
    broken, or holds no field of a return, comes out with ``parse_error`` set. ``pattern`` is what file names look like."""
    rows = (spark.read.schema(json_reading_schema()).option("multiLine", multi_line).option("pathGlobFilter", pattern)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("recursiveFileLookup", True).json(path))
    returns = json_returns(placed(rows), key)
    return returns.dropDuplicates(["declaration_id"]) if key is None and once else returns


def placed(rows: DataFrame) -> DataFrame:
    """Records with the file they were read from, the document they come from, and a digest of what the file says."""
    return rows.select(
        json_digest().alias("digest"),
        *[c for c in rows.columns if c not in ("file_path", "file_name")],
        file_path().alias("source_path"),
        F.coalesce("file_path", file_path()).alias("file_path"),
        F.coalesce("file_name", file_name()).alias("file_name"))


def read_extracted_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cached extraction results: text and metadata of each document."""
    schema = "text string, metadata map<string,string>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_table_csv(spark: SparkSession, path: str, table: str,
                   key_type: T.DataType | None = None) -> DataFrame:
    """A served table from CSV with header; codes keep their leading zeros."""
    return (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .schema(table_schema(table, key_type)).csv(path))


def name_pattern(extensions: tuple[str, ...]) -> str:
    return "*{" + ",".join(extensions) + "}"


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = KNOWLEDGE_EXTENSIONS) -> DataFrame:
    """Files below ``root`` with one of the extensions; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", name_pattern(extensions))
            .option("recursiveFileLookup", True).load(root)
            .select("path", F.col("modificationTime").alias("modified_at"), "length"))


def read_texts(spark: SparkSession, root: str | list[str],
               extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> DataFrame:
    """Whole text files below ``root``, one row each."""
    return (spark.read.option("pathGlobFilter", name_pattern(extensions))
            .option("recursiveFileLookup", True).text(root, wholetext=True)
            .select(file_path().alias("path"), F.col("value").alias("text")))


def read_scraped_json(spark: SparkSession, root: str | list[str], record_schema: str,
                      pattern: str = "*.json") -> DataFrame:
    """Scraped records, stored as an array of JSON texts: decoded twice."""
    files = (spark.read.option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).text(root, wholetext=True)
             .select(file_path().alias("path"), "value"))
    records = files.select("path", F.posexplode(F.from_json("value", "array<string>"))
                           .alias("record_no", "record"))
    return records.select("path", "record_no", F.from_json("record", record_schema).alias("r")) \
        .select("path", "record_no", "r.*")


def spread_scan(scan: DataFrame, *key: str) -> DataFrame:
    """A scan whose files split into fewer parts than there are cores, spread over
    all of them by a unique key; any other scan as it is.

    For work that costs far more per row than moving the row does, such as
    taking texts apart.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= 2 * cores:
        return scan
    return scan.repartition(cores, *key)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored web pages."""
    return spread_scan(spark.read.parquet(path).select("url", "html"), "url")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Stored texts with their document ids."""
    return spread_scan(spark.read.parquet(path).select("doc_id", "text"), "doc_id")


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks with embeddings; typed and empty where none are stored yet."""
    return collection_store(spark, path).read("chunks").drop("source")


# The words of a status report.
AVAILABLE = ("disponível", "A declaração está disponível para acesso")
MISSING = ("indisponível", "O arquivo da declaração não foi encontrado")


def file_status(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Per requested path: there or not, size, time of change, message."""
    found = files.select("path", "length", "modified_at")
    there = F.col("length").isNotNull()
    return requested.select("path").join(found, "path", "left").select(
        F.when(there, AVAILABLE[0]).otherwise(MISSING[0]).alias("status"),
        F.col("path").alias("arquivo"),
        F.when(there, S.kilobytes(F.col("length"))).alias("tamanho"),
        F.col("modified_at").alias("ultima_modificacao"),
        F.when(there, AVAILABLE[1]).otherwise(MISSING[1]).alias("mensagem"))
