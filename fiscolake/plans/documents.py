"""Personal documents and return files to the served tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscolake.operators.incremental import changed_files, read_manifest, removed_files
from fiscolake.operators.shred import (declarations_of, return_json, schedule_lines, typed_returns)
from fiscolake.operators.validate import REJECT_SCHEMA, split_declarations, split_lines, without_rejected
from fiscolake.schemas import DECLARATIONS, SCHEDULES, table_schema
from fiscolake.session import written_table
from fiscolake.sources.readers import list_files, name_pattern, only_changed, path_exists, paths_to_read, read_json_returns
from fiscolake.sources.store import Change, Store, Stored, as_struct
from fiscolake.sources.writers import write_manifest
from fiscolake.sources.xml import ROOT_TAG, read_xml_returns


# The served tables, the rejects, and the files each return is held by.
STORED = (DECLARATIONS, *SCHEDULES, "rejects", "origin")


def checked_tables(returns: DataFrame, source: str, strict: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Flat tables of the lines that pass the checks, and the rejects.

    ``strict`` refuses a whole return for one bad field; otherwise only the bad
    lines are left out, and a return without a summary stays, reported.
    """
    declarations = declarations_of(returns)
    tables, rejects = {DECLARATIONS: declarations}, [split_declarations(declarations)[1]]
    for name in SCHEDULES:
        tables[name], bad = split_lines(name, schedule_lines(returns, name, source, with_raw=True))
        rejects.append(bad)
    all_rejects = reduce(DataFrame.unionByName, rejects)
    if strict:
        all_rejects = written_table(all_rejects, "rejects")
        refused = written_table(all_rejects.select("declaration_id").distinct(), "refused")
        tables = {n: without_rejected(df, refused) for n, df in tables.items()}
    return tables, all_rejects


def document_store(spark: SparkSession, out: str, key_type: T.DataType | None = None) -> Store:
    """The tables ``process_documents`` keeps below ``out``. Beside their columns they have ``return_id``, a digest of key
    and content, by which rows are replaced; ``origin`` has a row for each file that holds a return."""
    key = T.StructField("declaration_id", key_type or T.StringType())
    own = T.StructField("return_id", T.StringType())
    rejects = as_struct(spark, REJECT_SCHEMA).fields[1:]
    schemas = {n: table_schema(n, key_type).fields for n in (DECLARATIONS, *SCHEDULES)}
    tables = {n: Stored(T.StructType([*fields, own]), "return_id") for n, fields in {**schemas, "rejects": [key, *rejects]}.items()}
    tables["origin"] = Stored(T.StructType([key, T.StructField("source_path", T.StringType()), own]), "source_path")
    return Store(spark, out, tables)


def extensions(source: str) -> tuple[str, ...]:
    """How names of returns' files end, plain or compressed."""
    return f".{source}", f".{source}.gz"


def process_documents(spark: SparkSession, folder: str, manifest: str, out: str, *, source: str = "json",
                      as_of: str | None = None, force: bool = False, strict: bool = False,
                      key: Column | None = None, key_type: T.DataType | None = None,
                      multi_line: bool = True, buckets: int | None = None) -> bool:
    """Bring the stored tables up to date with a folder of returns, extracted
    ones in JSON or return files in XML (``source="xml"``, with ``as_of``).

    Only new and changed files are read. A return is stored once however many files hold it (the same content under the
    same key), and goes with the last of them; a changed file rewrites only the returns in it that differ. Files that hold
    no return are rejects (``readable``). All tables change together, when the update is complete, and it writes only what
    changed (see ``sources/store.py``); one that fails leaves the old state and can be run again.

    ``multi_line`` is false for JSON files of one return per line; ``key_type`` is the type of a ``key`` that
    is no text; ``buckets`` is how many files an update writes for a table at most. Files may be compressed with gzip
    (``.json.gz``, ``.xml.gz``). Returns whether anything was done.
    """
    if not path_exists(spark, folder):
        return False
    known = read_manifest(spark, manifest)
    files = list_files(spark, folder, extensions(source))
    changed = written_table(changed_files(files, known, force), "changed")
    gone = written_table(removed_files(files, known).select("path"), "removed")
    if changed.isEmpty() and gone.isEmpty():
        return False

    store = document_store(spark, out, key_type)
    returns = _read_changed(spark, folder, changed, source, as_of, key, multi_line)
    if returns is None:
        found = silent = spark.createDataFrame([], store.tables["origin"].schema)
    else:
        found = returns.select("declaration_id", "source_path", "return_id").distinct()
        silent = written_table(_without_return(changed, returns), "silent")
        found = found.unionByName(silent)
    new = written_table(found, "origin")
    touched = changed.select("path").unionByName(gone).withColumnRenamed("path", "source_path")
    before, dropped, fresh = _what_changes(store, new, touched, force)

    rows = {}
    if returns is not None and not fresh.isEmpty():
        rows = _stored_rows(_to_store(returns, None if before is None or force else fresh), source, strict)
        rows["rejects"] = rows["rejects"].unionByName(_unread(silent.join(fresh, "return_id", "left_semi")))
        if buckets:  # All schedules are read for few rows: these are moved, so that a few tasks do not read it all.
            rows["rejects"] = rows["rejects"].repartition(buckets, "return_id")
    changes = {n: Change(rows.get(n), dropped) for n in STORED if n != "origin"}
    if before is not None:
        changes[DECLARATIONS] = _moved_declarations(store, before, new, touched, dropped, changes[DECLARATIONS])
    changes["origin"] = Change(new, None if before is None else touched)
    store.update(changes, buckets)
    write_manifest(changed, manifest, gone)
    return True


def _read_changed(spark: SparkSession, folder: str, changed: DataFrame, source: str, as_of: str | None,
                  key: Column | None, multi_line: bool) -> DataFrame | None:
    """The returns of changed files with their ``return_id``, each content once; ``None`` without any file."""
    if changed.isEmpty():
        return None
    paths = paths_to_read(changed, folder)
    if source == "xml":
        read = read_xml_returns(spark, paths, as_of=as_of, key=key, once=False, pattern=name_pattern(extensions(source)))
    else:
        read = read_json_returns(spark, paths, key=key, multi_line=multi_line, once=False, pattern=name_pattern(extensions(source)))
    if isinstance(paths, str):
        read = only_changed(read, changed)
    kind = read.schema["declaration_id"].dataType
    # What could not be read has no key of its own, and no content to tell it by: it goes by its file.
    broken = F.col("parse_error").isNotNull()
    by_file = F.sha2("source_path", 256) if kind == T.StringType() else F.xxhash64("source_path").cast(kind)
    by_content = F.concat_ws("#", F.col("declaration_id").cast("string"), "digest")
    return written_table(read.select(
        F.when(broken, F.coalesce("declaration_id", by_file)).otherwise(F.col("declaration_id")).alias("declaration_id"),
        F.sha2(F.when(broken, F.concat_ws("#", F.lit("file"), "source_path", "digest")).otherwise(by_content), 256).alias("return_id"),
        F.monotonically_increasing_id().alias("row_id"), *[c for c in read.columns if c not in ("declaration_id", "digest")]), "returns")


def _what_changes(store: Store, new: DataFrame, touched: DataFrame,
                  force: bool) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Origin rows of the touched files as they were; ids of returns whose stored rows go; ids whose rows are to be written.
    The first two are ``None`` where there are none."""
    found = written_table(new.select("return_id").distinct(), "found")
    if not store.version():
        return None, None, found
    stored = store.read("origin")
    asked = stored.join(touched, "source_path", "left_semi").select("return_id").unionByName(found)
    # Who else holds what the touched files held or hold; both sides are needed several times.
    near = written_table(stored.join(asked.distinct(), "return_id", "left_semi"), "near")
    before = near.join(touched, "source_path", "left_semi")
    held = near.join(touched, "source_path", "left_anti").select("return_id").distinct()
    left = before.select("return_id").distinct().join(held, "return_id", "left_anti")
    if force:  # what is read again is written again, with what the checks say now
        dropped = written_table(left.unionByName(found).distinct(), "dropped")
        return before, None if dropped.isEmpty() else dropped, found
    dropped = written_table(left.join(found, "return_id", "left_anti"), "dropped")
    fresh = written_table(found.join(near, "return_id", "left_anti"), "fresh")
    return before, None if dropped.isEmpty() else dropped, fresh


def _moved_declarations(store: Store, before: DataFrame, new: DataFrame, touched: DataFrame, dropped: DataFrame | None,
                        change: Change) -> Change:
    """The change of the returns' table with those added that stay, held by other files, while the file their row names
    does not hold them any more: they name the first of the others now."""
    kept = before.select("return_id").distinct()
    if dropped is not None:
        kept = kept.join(dropped, "return_id", "left_anti")
    kept = written_table(kept, "kept")
    if kept.isEmpty():
        return change
    now = store.read("origin").join(touched, "source_path", "left_anti").unionByName(new)
    holders = written_table(now.join(kept, "return_id", "left_semi").select("return_id", "source_path").distinct(), "holders")
    named = (store.read(DECLARATIONS).join(kept, "return_id", "left_semi")
             .join(touched.select(F.col("source_path").alias("file_path")), "file_path", "left_semi")
             .join(holders.withColumnRenamed("source_path", "file_path"), ["return_id", "file_path"], "left_anti"))
    first = holders.groupBy("return_id").agg(F.min("source_path").alias("first"))
    moved = written_table(named.join(first, "return_id").select(
        *[c for c in named.columns if c not in ("file_path", "file_name")], F.col("first").alias("file_path"),
        F.regexp_extract("first", "([^/]*)$", 1).alias("file_name")), "moved")
    if moved.isEmpty():
        return change
    rows, gone = moved, moved.select("return_id")
    return Change(rows if change.rows is None else change.rows.unionByName(rows),
                  gone if change.gone is None else change.gone.unionByName(gone))


def _to_store(returns: DataFrame, fresh: DataFrame | None) -> DataFrame:
    """The returns to be stored: those of some ids (``None`` for all), each content once, that of the first file that holds it.

    What stays out is found by narrow rows; where there is any, returns are joined and written once, for all tables."""
    order = Window.partitionBy("return_id").orderBy("source_path", "row_id")
    ranked = returns.select("return_id", "source_path", "row_id").withColumn("n", F.row_number().over(order))
    out = ranked.where("n > 1").select("row_id")
    if fresh is not None:
        out = out.unionByName(ranked.where("n = 1").join(fresh, "return_id", "left_anti").select("row_id"))
    out = written_table(out, "out")
    return returns if out.isEmpty() else written_table(returns.join(out, "row_id", "left_anti"), "kept")


def _stored_rows(returns: DataFrame, source: str, strict: bool) -> dict[str, DataFrame]:
    """Every stored table but ``origin`` of some returns."""
    # Checks go return by return, also where several share a key.
    both = returns.withColumn("declaration_id", F.struct("declaration_id", "return_id"))
    tables, rejects = checked_tables(both.where("parse_error IS NULL"), source, strict)
    rows = {**tables, "rejects": rejects.unionByName(unreadable(both))}
    return {n: df.select("declaration_id.*", *[c for c in df.columns if c != "declaration_id"]) for n, df in rows.items()}


def _without_return(changed: DataFrame, returns: DataFrame) -> DataFrame:
    """Origin rows, under a digest of the path, of files that gave no return, such as those of another root."""
    lost = changed.select(F.col("path").alias("source_path")).join(returns.select("source_path"), "source_path", "left_anti")
    kind = returns.schema["declaration_id"].dataType
    digest = F.sha2("source_path", 256) if kind == T.StringType() else F.xxhash64("source_path").cast(kind)
    return lost.select(digest.alias("declaration_id"), "source_path",
                       F.sha2(F.concat_ws("#", F.lit("file"), "source_path"), 256).alias("return_id"))


def _unread(files: DataFrame) -> DataFrame:
    """Rejects for files without a return, by their origin rows."""
    return files.select("declaration_id", "return_id", F.lit(DECLARATIONS).alias("table_name"),
                        F.lit("file_path").alias("column_name"), F.lit("readable").alias("rule"),
                        F.col("source_path").alias("raw_value"))


def read_stored(spark: SparkSession, out: str, table: str, key_type: T.DataType | None = None) -> DataFrame:
    """A stored table of ``process_documents``, typed also while it is empty.
    ``key_type`` is the type of a key of the caller's own."""
    return document_store(spark, out, key_type).read(table).drop("return_id")


def unreadable(returns: DataFrame) -> DataFrame:
    """Rejects for the files that could not be parsed."""
    return returns.where("parse_error IS NOT NULL").select(
        "declaration_id", F.lit(DECLARATIONS).alias("table_name"),
        F.lit("file_path").alias("column_name"), F.lit("readable").alias("rule"),
        F.col("source_path").alias("raw_value"))


def load_xml(spark: SparkSession, path: str | list[str], *, as_of: str, key: Column | None = None,
             strict: bool = False, root_tag: str = ROOT_TAG) -> tuple[dict[str, DataFrame], DataFrame]:
    """Return files in XML to flat tables and rejects. The files are read once
    and kept as a written table, which the seven tables then share. Files without a return are rejects too."""
    returns = written_table(read_xml_returns(spark, path, as_of=as_of, key=key, root_tag=root_tag), "returns")
    tables, rejects = checked_tables(returns.where("parse_error IS NULL"), "xml", strict)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    silent = _unread(_without_return(files, returns)).drop("return_id")
    return tables, rejects.unionByName(unreadable(returns)).unionByName(silent)


# What is said of a return that cannot be read.
NOT_FOUND = "Tax return file not found"
FAILED = "Failed to read tax return: "


def return_documents(spark: SparkSession, path: str | list[str], *, as_of: str,
                     root_tag: str = ROOT_TAG) -> DataFrame:
    """Return files as JSON documents, one row per return: ``file_path, document``.
    An unreadable file gives a document with ``error``."""
    returns = read_xml_returns(spark, path, as_of=as_of, root_tag=root_tag)
    failed = F.to_json(F.struct(F.concat(F.lit(FAILED), F.col("file_path")).alias("error")))
    return return_json(typed_returns(returns, "xml")).select(
        "file_path", F.when(F.col("parse_error").isNull(), F.col("document")).otherwise(failed).alias("document"))


def requested_documents(requested: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents of the requested files (``file_path``); a file that is not
    there gives a document with ``error``."""
    missing = F.lit(json.dumps({"error": NOT_FOUND}))
    return (requested.select("file_path").join(documents, "file_path", "left")
            .select("file_path", F.coalesce("document", missing).alias("document")))


def read_tax_return(spark: SparkSession, path: str, *, as_of: str, root_tag: str = ROOT_TAG) -> DataFrame:
    """A return file as one JSON document, or a document with ``error``."""
    if path_exists(spark, path):
        return return_documents(spark, path, as_of=as_of, root_tag=root_tag)
    nothing = spark.createDataFrame([], "file_path string, document string")
    return requested_documents(spark.createDataFrame([(path,)], "file_path string"), nothing)
