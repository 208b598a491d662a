"""Stored tables that are updated at the cost of what changes.

Nothing stored is ever written over. An update appends, for each table it touches, the new rows and the keys whose
earlier rows no longer count, in folders of its own. It takes effect for all tables at once, when its one-row commit
appears; a run that fails before leaves folders nobody reads, and the old state. Readers take the newest rows of every
key: a row counts unless a later version lists its key among the gone. ``compact`` writes the rows that count as a new base, from
which on versions are read, and ``remove_unused`` deletes what no reader of the newest version needs.

    <root>/commits/store_version=3/                       version, attempt, base, which tables have rows and gone keys
    <root>/<table>/rows/store_version=3/store_attempt=x/  rows of the version
    <root>/<table>/gone/store_version=3/store_attempt=x/  keys whose rows of earlier versions are gone

Two writers may run at once: they append to different folders, and of two commits of one version the one whose file is
older counts; the other writer finds that out when it reads its commit back, and fails with ``ConcurrentUpdate``. Keys
are not null.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscolake.schemas import COLLECTION_SCHEMA
from fiscolake.sources.filesystem import delete_folder, path_exists

VERSION, ATTEMPT = "store_version", "store_attempt"
WRITERS = 4
COMMIT_SCHEMA = f"{VERSION} long, attempt string, base long, filled array<string>, emptied array<string>"


class ConcurrentUpdate(RuntimeError):
    """Another writer committed the same version first."""


@dataclass(frozen=True)
class Stored:
    """A stored table: its columns, and the column by whose values rows are replaced."""
    schema: T.StructType
    key: str


@dataclass(frozen=True)
class Change:
    """New rows of a table and a frame with the keys whose rows of before are gone (in its column of the key's name);
    ``None`` for neither."""
    rows: DataFrame | None = None
    gone: DataFrame | None = None


class Store:
    """A set of tables below one folder, updated together."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Stored]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), dict(tables)

    def commits(self) -> list:
        """The commits that count, oldest first, from the newest base on."""
        path = f"{self.root}/commits"
        if not path_exists(self.spark, path):
            return []
        stored = self.spark.read.schema(COMMIT_SCHEMA).parquet(path).select("*", "_metadata.file_modification_time")
        counting: dict[int, object] = {}  # one short row per update
        for row in sorted(stored.collect(), key=lambda r: (r[VERSION], r.file_modification_time, r.attempt)):
            counting.setdefault(row[VERSION], row)
        base = max((c["base"] for c in counting.values()), default=0)
        return [c for c in counting.values() if c[VERSION] >= base]

    def version(self) -> int:
        """The newest version; 0 before the first update."""
        return max((c[VERSION] for c in self.commits()), default=0)

    def _folders(self, commits: list, name: str, part: str) -> list[str]:
        listed = "filled" if part == "rows" else "emptied"
        return [f"{self.root}/{name}/{part}/{VERSION}={c[VERSION]}/{ATTEMPT}={c.attempt}" for c in commits if name in c[listed]]

    def _part(self, commits: list, name: str, part: str, schema: T.StructType) -> DataFrame | None:
        folders = self._folders(commits, name, part)
        if not folders:
            return None
        versioned = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(ATTEMPT, T.StringType())])
        return self.spark.read.schema(versioned).option("basePath", f"{self.root}/{name}/{part}").parquet(*folders).drop(ATTEMPT)

    def read(self, name: str) -> DataFrame:
        """The rows of a table that count; typed and empty before the first update."""
        return self._read(self.commits(), name)

    def _read(self, commits: list, name: str) -> DataFrame:
        table = self.tables[name]
        rows = self._part(commits, name, "rows", table.schema)
        if rows is None:
            return self.spark.createDataFrame([], table.schema)
        gone = self._part(commits, name, "gone", T.StructType([table.schema[table.key]]))
        if gone is not None:
            later = gone.select(F.col(table.key).alias("gone_key"), F.col(VERSION).alias("gone_at"))
            # Rows that a later version took away; the few keys of usual updates go to every task.
            rows = rows.join(later, (F.col(table.key) == F.col("gone_key")) & (F.col(VERSION) < F.col("gone_at")), "left_anti")
        return rows.select(*table.schema.fieldNames())

    def update(self, changes: Mapping[str, Change], files: int | None = None) -> dict[str, int]:
        """Append the changes and commit them as one version. Returns the rows written by table. Rows that go by a key
        may come back in the same update.

        ``files`` says how many files the rows of a table fill at most; by default as their plan has them. Partitions are
        joined for it, so that rows are not shuffled, and those of one key stay beside each other.
        """
        done = self.commits()
        return self._commit(changes, max((c[VERSION] for c in done), default=0) + 1, max((c["base"] for c in done), default=0), files)

    def _commit(self, changes: Mapping[str, Change], version: int, base: int, files: int | None = None) -> dict[str, int]:
        attempt = uuid.uuid4().hex
        at = f"{VERSION}={version}/{ATTEMPT}={attempt}"

        def write_rows(name: str, rows: DataFrame) -> int:
            counted = Observation()
            kept = rows.select(*self.tables[name].schema.fieldNames())
            (kept.coalesce(files) if files else kept).observe(counted, F.count(F.lit(1)).alias("n")).write.option(
                "compression", "zstd").parquet(f"{self.root}/{name}/rows/{at}")
            return counted.get["n"]

        def write_gone(name: str, gone: DataFrame) -> None:
            gone.select(self.tables[name].key).distinct().write.option("compression", "zstd").parquet(
                f"{self.root}/{name}/gone/{at}")

        # The tables of one update do not wait for each other; small ones would mostly wait.
        with ThreadPoolExecutor(WRITERS) as pool:
            counts = {n: pool.submit(write_rows, n, c.rows) for n, c in changes.items() if c.rows is not None}
            rest = [pool.submit(write_gone, n, c.gone) for n, c in changes.items() if c.gone is not None]
            for done in rest:
                done.result()
            written = {n: c.result() for n, c in counts.items()}
        if any(c[VERSION] >= version for c in self.commits()):
            raise ConcurrentUpdate(f"{self.root}: version {version} is there already")
        commit = [(attempt, base, [n for n, c in changes.items() if c.rows is not None],
                   [n for n, c in changes.items() if c.gone is not None])]
        (self.spark.createDataFrame(commit, "attempt string, base long, filled array<string>, emptied array<string>").coalesce(1)
         .write.mode("append").parquet(f"{self.root}/commits/{VERSION}={version}"))
        if attempt not in [c.attempt for c in self.commits()]:
            raise ConcurrentUpdate(f"{self.root}: version {version} was committed by another writer")
        return written

    def compact(self) -> int:
        """Write the rows that count as a new base; returns its version. Readers of before are not disturbed."""
        commits = self.commits()
        if not commits:
            return 0
        version = max(c[VERSION] for c in commits) + 1
        self._commit({n: Change(self._read(commits, n)) for n in self.tables}, version, version)
        return version

    def remove_unused(self) -> list[str]:
        """Delete folders of versions before the base and of attempts that were never committed. For times without
        writers and without readers of older versions."""
        commits = self.commits()
        kept = {f for n in self.tables for part in ("rows", "gone") for f in self._folders(commits, n, part)}
        found = []
        for name in self.tables:
            for part in ("rows", "gone"):
                top = f"{self.root}/{name}/{part}"
                if path_exists(self.spark, top):
                    # One name per folder of a version, not per file of it.
                    paths = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top)
                             .select(F.regexp_extract("path", f"({VERSION}=[^/]*/{ATTEMPT}=[^/]*)/", 1).alias("f")).distinct())
                    found += [f"{top}/{r.f}" for r in paths.collect()]
        unused = sorted(set(found) - kept)
        for folder in unused:
            delete_folder(self.spark, folder)
        return unused


def as_struct(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema


def collection_store(spark: SparkSession, path: str) -> Store:
    """The chunks below ``path``, replaced by their ``source``: the document, or the file it was read from."""
    schema = as_struct(spark, COLLECTION_SCHEMA + ", source string")
    return Store(spark, path, {"chunks": Stored(schema, "source")})
