"""Arriving files as streams: the continuous form of the incremental loads.

The stream's checkpoint remembers which files were read. Every micro-batch goes
to a folder of its own, written over when the batch is repeated, so a restart
leaves no row twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fiscolake.functions.files import file_name, file_path
from fiscolake.operators.embed import Embedder
from fiscolake.operators.shred import json_returns
from fiscolake.plans.documents import checked_tables, unreadable
from fiscolake.plans.knowledge import collection_rows
from fiscolake.schemas import CORRUPT, json_reading_schema
from fiscolake.session import written_table
from fiscolake.sources.readers import placed
from fiscolake.sources.writers import upsert_chunks
from fiscolake.sources.xml import READ_OPTIONS, ROOT_TAG, keyed, parse_error, raw_columns, reading_schema


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _write_batch(tables: dict[str, DataFrame], out: str, batch: int) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")


def _once(batch: DataFrame, key: Column | None) -> DataFrame:
    """Under the default key a return repeated in a file counts once; a file is never split over batches."""
    return batch.dropDuplicates(["declaration_id"]) if key is None else batch


def stream_xml_returns(spark: SparkSession, path: str, layout: T.StructType, out: str, checkpoint: str, *,
                       as_of: str, key: Column | None = None, root_tag: str = ROOT_TAG,
                       files_per_batch: int = 1000) -> StreamingQuery:
    """Arriving XML returns to the served tables; rejects go beside them."""
    schema = reading_schema(layout)
    files = (spark.readStream.format("xml").options(**READ_OPTIONS).option("rowTag", root_tag)
             .option("maxFilesPerTrigger", files_per_batch).schema(schema).load(path))
    rows = files.select(file_path(), file_name(), file_path().alias("source_path"),
                        *raw_columns(schema, F.lit(as_of).cast("date")),
                        parse_error())
    returns = keyed(rows, key)

    def load(batch: DataFrame, number: int) -> None:
        kept = written_table(_once(batch, key), "batch")
        tables, rejects = checked_tables(kept.where("parse_error IS NULL"), "xml")
        _write_batch({**tables, "rejects": rejects.unionByName(unreadable(kept))}, out, number)

    return _run(returns, load, checkpoint)


def stream_json_returns(spark: SparkSession, path: str, out: str, checkpoint: str, *,
                        key: Column | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Arriving JSON returns (one per line) to the served tables."""
    files = (spark.readStream.schema(json_reading_schema()).option("maxFilesPerTrigger", files_per_batch)
             .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    returns = json_returns(placed(files), key)

    def load(batch: DataFrame, number: int) -> None:
        kept = written_table(_once(batch, key), "batch")
        tables, rejects = checked_tables(kept.where("parse_error IS NULL"), "json")
        _write_batch({**tables, "rejects": rejects.unionByName(unreadable(kept))}, out, number)

    return _run(returns, load, checkpoint)


def stream_texts(spark: SparkSession, path: str, collection: str, checkpoint: str, *,
                 embedder: Embedder | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Arriving texts to the collection. A batch repeated after a failure replaces
    the chunks it wrote before."""
    files = (spark.readStream.format("text").option("wholetext", True)
             .option("maxFilesPerTrigger", files_per_batch).load(path)
             .select(file_path().alias("doc_id"), F.col("value").alias("text")))

    def load(batch: DataFrame, number: int) -> None:
        upsert_chunks(collection_rows(batch, embedder), batch.select("doc_id"), collection)

    return _run(files, load, checkpoint)


def read_streamed(spark: SparkSession, out: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{table}").drop("batch")
