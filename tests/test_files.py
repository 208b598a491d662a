"""Readers, sinks and incremental processing."""

import json
import os
import time
from decimal import Decimal

from pyspark.sql import functions as F

from fiscolake.operators.incremental import changed_files, read_manifest, removed_files
from fiscolake.schemas import ALL_TABLES, DECLARED_TABLES, empty_table, table_schema
from fiscolake.session import shared_path, shared_root, written_table
from fiscolake.sources import readers, writers


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared_path(spark, "a") != shared_path(spark, "a")
    df = written_table(spark.range(3), "t")
    assert df.count() == 3 and df.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_root(spark).lstrip("/"))


def _tables(spark):
    tables = {n: empty_table(spark, n) for n in ALL_TABLES}
    tables["doacoes_efetuadas"] = spark.createDataFrame(
        [("k", "01", None, 'Nome "com", aspas\nE linha', Decimal("1.10"))], table_schema("doacoes_efetuadas"))
    return tables


def test_csv_round_trip(spark, tmp_path):
    tables = _tables(spark)
    paths = writers.write_csv_tables(tables, str(tmp_path))
    back = readers.read_table_csv(spark, paths["doacoes_efetuadas"], "doacoes_efetuadas")
    assert back.collect() == tables["doacoes_efetuadas"].collect()
    empty = readers.read_table_csv(spark, paths["bens_direitos"], "bens_direitos")
    assert empty.count() == 0 and empty.schema["valor_2024"].dataType.simpleString() == "decimal(14,2)"


def test_save_and_declare_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS declared")
    assert writers.declare_tables(spark, "declared") == list(DECLARED_TABLES)
    assert writers.declare_tables(spark, "declared") == []
    assert spark.table("declared.bens_direitos").schema["valor_2024"].dataType.simpleString() == "decimal(15,2)"
    row = writers.with_created_at(spark.createDataFrame([(1, "a", "1", 2024)], "a int, b string, c string, d int"))
    assert row.first().created_at is not None
    spark.sql("CREATE DATABASE IF NOT EXISTS served")
    for _ in range(2):
        writers.save_tables(_tables(spark), "served")
    assert spark.table("served.doacoes_efetuadas").count() == 1


def test_json_lines_count_comes_from_the_write(spark, tmp_path):
    df = spark.createDataFrame([("á", None), ("b", "c")], "x string, y string")
    assert writers.write_json_lines(df, str(tmp_path / "j")) == 2
    lines = [json.loads(l) for f in (tmp_path / "j").glob("*.json") for l in f.read_text("utf-8").splitlines()]
    assert {"x": "á", "y": None} in lines


def test_scraped_json_is_decoded_twice(spark, tmp_path):
    records = [json.dumps({"url": "u1", "text": "é"}), json.dumps({"url": "u2", "text": "b", "z": 1})]
    (tmp_path / "s.json").write_text(json.dumps(records, indent=2), encoding="utf-8")
    got = readers.read_scraped_json(spark, str(tmp_path), "url string, text string").collect()
    assert [(r.record_no, r.url, r.text) for r in got] == [(0, "u1", "é"), (1, "u2", "b")]


def test_a_text_file_is_one_row(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.txt").write_text("um\ndois\r\n\ntrês", encoding="utf-8")
    (tmp_path / "b.md").write_text("# b\n", encoding="utf-8")
    (tmp_path / "c.bin").write_text("no")
    assert sorted(r.text for r in readers.read_texts(spark, str(tmp_path)).collect()) == ["# b\n", "um\ndois\r\n\ntrês"]


def _write(root, name, text="x", at=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if at:
        os.utime(path, (at, at))


def test_incremental(spark, tmp_path):
    now = time.time()
    kb, manifest = tmp_path / "kb", str(tmp_path / "manifest")
    _write(kb, "a.txt", at=now - 100)
    _write(kb, "deep/b.json", at=now - 100)
    _write(kb, "deep/c.pdf", at=now - 100)
    _write(kb, "skip.csv")

    def names(df):
        return sorted((r.path.rsplit("/", 1)[1], r.change) for r in df.collect())

    files = readers.list_files(spark, str(kb))
    first = changed_files(files, read_manifest(spark, manifest))
    assert names(first) == [("a.txt", "new"), ("b.json", "new"), ("c.pdf", "new")]
    writers.write_manifest(first, manifest)
    files = readers.list_files(spark, str(kb))
    assert changed_files(files, read_manifest(spark, manifest)).count() == 0
    _write(kb, "a.txt", "y", at=now)
    _write(kb, "d.txt", at=now - 200)  # new, though older than the last run
    (kb / "deep" / "c.pdf").rename(tmp_path / "c.pdf")
    files = readers.list_files(spark, str(kb))
    known = read_manifest(spark, manifest)
    assert names(changed_files(files, known)) == [("a.txt", "modified"), ("d.txt", "new")]
    assert names(changed_files(files, known, force=True))[1] == ("b.json", "unchanged")
    assert [r.path.rsplit("/", 1)[1] for r in removed_files(files, known).collect()] == ["c.pdf"]
    writers.write_manifest(changed_files(files, known), manifest)
    assert changed_files(readers.list_files(spark, str(kb)), read_manifest(spark, manifest)).count() == 0


def test_file_status(spark, tmp_path):
    _write(tmp_path, "r.xml", "a" * 1536)
    files = readers.list_files(spark, str(tmp_path), (".xml",))
    asked = files.select("path").union(spark.createDataFrame([("file:/none.xml",)], "path string"))
    status = {r.status: r for r in readers.file_status(asked, files).collect()}
    assert status["disponível"].tamanho == "1.50 KB" and status["disponível"].ultima_modificacao is not None
    assert status["indisponível"].tamanho is None
    assert readers.path_exists(spark, str(tmp_path)) and not readers.path_exists(spark, "/none")


def _chunks(spark, rows):
    return spark.createDataFrame([(f"{d}-{n}", d, n, t, 1, [1.0]) for d, n, t in rows],
                                 "chunk_id string, doc_id string, chunk_no int, text string, n_tokens int, embedding array<float>")


def test_upsert_chunks(spark, tmp_path):
    path = str(tmp_path / "col")
    assert readers.read_collection(spark, path).count() == 0
    ids = lambda *d: spark.createDataFrame([(x,) for x in d], "doc_id string")
    stored = lambda: sorted((r.doc_id, r.chunk_no, r.text) for r in readers.read_collection(spark, path).collect())
    first = [(f"d{i}", n, "v1") for i in range(20) for n in range(2)]
    assert writers.upsert_chunks(_chunks(spark, first), ids(*{r[0] for r in first}), path, buckets=4) == 40
    assert stored() == sorted(first)
    writers.upsert_chunks(_chunks(spark, [("d3", 0, "v2")]), ids("d3", "d4"), path, buckets=4)
    want = sorted([r for r in first if r[0] not in ("d3", "d4")] + [("d3", 0, "v2")])
    assert stored() == want
    none = _chunks(spark, first).where(F.lit(False))
    assert writers.upsert_chunks(none, ids(), path, buckets=4) == 0 and stored() == want
    # Taking all documents away leaves no bucket with old rows.
    writers.upsert_chunks(none, ids(*[f"d{i}" for i in range(20)]), path, buckets=4)
    assert stored() == []
