"""The knowledge base: from changed files to stored chunks with embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.operators import retrieve
from fiscolake.operators.chunk import CHUNK_OVERLAP, CHUNK_SIZE, chunk_sentences
from fiscolake.operators.embed import Embedder, embed
from fiscolake.operators.incremental import changed_files, read_manifest, removed_files
from fiscolake.session import written_table
from fiscolake.sources.readers import (TEXT_EXTENSIONS, list_files, only_changed, path_exists, paths_to_read,
                                       read_collection, read_scraped_json, read_texts)
from fiscolake.sources.writers import upsert_chunks, write_manifest

SCRAPED_SCHEMA = "url string, title string, description string, text string"
BUILT_EXTENSIONS = (*TEXT_EXTENSIONS, ".json")


def folder_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Texts of a folder or of listed files as ``doc_id, path, text``: text files,
    and scraped records."""
    texts = read_texts(spark, paths).select(F.col("path").alias("doc_id"), "path", "text")
    scraped = read_scraped_json(spark, paths, SCRAPED_SCHEMA).where("text <> ''")
    return texts.unionByName(scraped.select(
        F.concat_ws("#", "path", F.col("record_no").cast("string")).alias("doc_id"), "path", "text"))


def collection_rows(docs: DataFrame, embedder: Embedder | None = None,
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Documents (``doc_id, text``) to chunks with embeddings."""
    return embed(chunk_sentences(docs, size, overlap), embedder)


def build_knowledge_base(spark: SparkSession, root: str, collection: str, manifest: str, *,
                         force: bool = False, embedder: Embedder | None = None,
                         size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                         buckets: int | None = None) -> tuple[DataFrame, bool]:
    """Bring the stored collection up to date with a folder.

    Only new and modified files are read; chunks of removed files are dropped. Nothing stored is read or written over.
    Returns the collection and whether anything was done.
    """
    if not path_exists(spark, root):
        return read_collection(spark, collection), False
    known = read_manifest(spark, manifest)
    files = list_files(spark, root, BUILT_EXTENSIONS)
    # File lists are metadata; written down so that later steps see one listing.
    changed = written_table(changed_files(files, known, force), "changed")
    gone = written_table(removed_files(files, known).select("path"), "removed")
    if changed.isEmpty() and gone.isEmpty():
        return read_collection(spark, collection), False

    touched = changed.select("path").unionByName(gone)
    if changed.isEmpty():
        docs = spark.createDataFrame([], "doc_id string, path string, text string")
    else:
        # Where the whole folder is read, the join keeps the changed files.
        docs = only_changed(folder_documents(spark, paths_to_read(changed, root)), changed, "path")
    rows = collection_rows(docs.select("doc_id", "text"), embedder, size, overlap)
    # A scraped record's id is that of its file and a number; no other file's name ends that way.
    placed = rows.withColumn("source", F.regexp_replace("doc_id", r"#[0-9]+$", ""))
    upsert_chunks(placed, touched.withColumnRenamed("path", "source"), collection, buckets)
    write_manifest(changed, manifest, gone)
    return read_collection(spark, collection), True


def query_knowledge_base(spark: SparkSession, collection: str, question: str,
                         k: int = retrieve.TOP_K, embedder: Embedder | None = None) -> DataFrame:
    """Context of one question, best chunk first."""
    asked = spark.createDataFrame([(0, question)], "query_id int, text string")
    return retrieve.ask(asked, read_collection(spark, collection), k, embedder)
