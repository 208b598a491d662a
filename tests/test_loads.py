"""Loads by file: what happens to stored returns when files repeat, change, break and go."""

import gzip
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from fiscolake.plans import documents
from fiscolake.plans.documents import document_store, load_xml, process_documents, read_stored
from fiscolake.schemas import DECLARATIONS, SCHEDULES
from fiscolake.sources import readers
from fiscolake.sources.store import Store

XML = ('<declaracao><identificadorDeclaracao cpf="{0}" nome="N{0}"/><pagamentos>'
       '<item codigo="1" cpfBeneficiario="12345678909" valorPago="{1},00"/></pagamentos></declaracao>')


def put(path, text, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    os.utime(path, (at or time.time(),) * 2)


def record(name, paid="1.00", **more):
    return {"summary": {"text": name}, "pagamentos_efetuados": [
        {"codigo": "10", "cpf_beneficiario": "12345678909", "valor_pago": paid}], **more}


class Folder:
    def __init__(self, spark, root, **options):
        self.spark, self.root, self.options, self.now = spark, root, options, time.time() - 1000

    def put(self, name, text):
        self.now += 10
        put(self.root / "in" / name, text if isinstance(text, str) else json.dumps(text), self.now)

    def move(self, name):
        (self.root / "in" / name).rename(self.root / f"gone-{name}")

    def run(self, **more):
        return process_documents(self.spark, str(self.root / "in"), str(self.root / "log"), str(self.root / "out"),
                                 **{**self.options, **more})

    def rows(self, name, *columns):
        stored = read_stored(self.spark, str(self.root / "out"), name, self.options.get("key_type"))
        return sorted(tuple(str(x).rsplit("/", 1)[-1] for x in r) for r in stored.select(*columns).collect())


def test_files_repeat_change_break_and_go(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.put("a.json", [record("um"), record("dois"), record("um")])
    f.put("b.json", record("um"))
    f.put("broken.json", '{"summary": ')
    f.put("foreign.json", {"other": 1})
    f.put("nothing.json", [])
    assert f.run() and not f.run()
    assert f.rows("declarations", "file_path", "summary") == [("a.json", "dois"), ("a.json", "um"), ("b.json", "um")]
    assert f.rows("pagamentos_efetuados", "codigo") == [("10",)] * 3
    lost = [("readable", "broken.json"), ("readable", "foreign.json"), ("readable", "nothing.json")]
    assert f.rows("rejects", "rule", "raw_value") == lost
    # The first of two files with one record goes: the other's return stays.
    f.move("a.json")
    f.put("broken.json", record("inteiro", "2.00"))
    f.put("b.json", [record("um"), {"pagamentos_efetuados": record("x")["pagamentos_efetuados"]}])
    assert f.run()
    assert f.rows("declarations", "file_path", "summary") == [("b.json", ""), ("b.json", "um"), ("broken.json", "inteiro")]
    assert f.rows("pagamentos_efetuados", "valor_pago") == [("1.00",), ("1.00",), ("2.00",)]
    assert f.rows("rejects", "rule", "raw_value") == [("not_empty", ""), *lost[1:]]
    for name in ("b.json", "broken.json", "foreign.json", "nothing.json"):
        f.move(name)
    f.put("c.txt", "no return")
    assert f.run()
    assert all(f.rows(n, "declaration_id") == [] for n in documents.STORED)


def test_a_shared_return_goes_with_its_last_file(spark, tmp_path):
    f = Folder(spark, tmp_path, source="xml", as_of="2025-05-31", key=F.col("cpf"))
    f.put("a.xml", XML.format("111", 1))
    f.put("b.xml", XML.format("111", 1))
    f.put("c.xml", XML.format("111", 5))
    f.put("other.xml", "<other/>")
    f.put("cut.xml", "<declaracao><bens>")
    assert f.run()
    assert f.rows("declarations", "declaration_id", "file_name") == [("111", "a.xml"), ("111", "c.xml")]
    assert f.rows("pagamentos_efetuados", "valor_pago") == [("1.00",), ("5.00",)]
    assert f.rows("rejects", "rule", "raw_value") == [("readable", "cut.xml"), ("readable", "other.xml")]
    assert f.rows("origin", "source_path") == [("a.xml",), ("b.xml",), ("c.xml",), ("cut.xml",), ("other.xml",)]
    f.move("a.xml")
    f.put("c.xml", XML.format("111", 1))
    assert f.run()
    assert f.rows("declarations", "declaration_id", "file_name") == [("111", "b.xml")]
    assert f.rows("pagamentos_efetuados", "valor_pago") == [("1.00",)]
    f.move("b.xml")
    assert f.run() and f.rows("declarations", "file_name") == [("c.xml",)]
    assert f.run(force=True) and f.rows("pagamentos_efetuados", "valor_pago") == [("1.00",)]
    f.move("c.xml")
    assert f.run() and f.rows("declarations", "file_name") == [] and f.rows("pagamentos_efetuados", "codigo") == []


def test_a_shared_json_return_names_the_file_that_holds_it(spark, tmp_path):
    f = Folder(spark, tmp_path, key=F.lit("k"))
    f.put("a.json", [record("um"), record("dois", file_path="/doc/d.pdf", file_name="d.pdf")])
    f.put("b.json", [record("um"), record("dois", file_path="/doc/d.pdf", file_name="d.pdf")])
    assert f.run()
    assert f.rows("declarations", "file_path", "summary") == [("a.json", "um"), ("d.pdf", "dois")]
    f.move("a.json")
    assert f.run()
    assert f.rows("declarations", "file_name", "summary") == [("b.json", "um"), ("d.pdf", "dois")]
    assert len(f.rows("pagamentos_efetuados", "codigo")) == 2


def test_a_touched_file_rewrites_only_what_differs(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.put("a.json", [record(f"n{i}") for i in range(20)])
    assert f.run()
    f.put("a.json", [record(f"n{i}", "1.00" if i else "9.00") for i in range(20)])
    assert f.run()
    store = document_store(spark, str(tmp_path / "out"))
    last = store._folders(store.commits()[-1:], "pagamentos_efetuados", "rows")
    assert spark.read.parquet(*last).count() == 1
    assert len(f.rows("pagamentos_efetuados", "valor_pago")) == 20 and ("9.00",) in f.rows("pagamentos_efetuados", "valor_pago")
    store.compact()
    assert len(f.rows("declarations", "summary")) == 20 and not f.run()


def test_a_failed_load_can_be_run_again(spark, tmp_path, monkeypatch):
    f = Folder(spark, tmp_path)
    f.put("a.json", record("um"))
    assert f.run()
    f.put("a.json", record("dois"))

    def stop(*args, **kwargs):
        raise RuntimeError("stopped")
    monkeypatch.setattr(documents, "write_manifest", stop)  # after the tables, before the list of files
    with pytest.raises(RuntimeError):
        f.run()
    monkeypatch.undo()
    assert f.rows("declarations", "summary") == [("dois",)]
    assert f.run() and f.rows("declarations", "summary") == [("dois",)] and f.rows("pagamentos_efetuados", "codigo") == [("10",)]


def test_more_files_than_the_driver_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MAX_NAMED", 1)
    f = Folder(spark, tmp_path)
    for i in range(3):
        f.put(f"{i}.json", record(f"n{i}"))
    f.put("x.txt", "{}")
    assert f.run()
    f.put("1.json", record("neu"))
    f.put("2.json", record("neu"))
    assert f.run()
    assert f.rows("declarations", "file_name", "summary") == [("0.json", "n0"), ("1.json", "neu"), ("2.json", "neu")]


def test_load_xml_reports_files_without_a_return(spark, tmp_path):
    for name, text in (("a.xml", XML.format("1", 1)), ("other.xml", "<other/>")):
        put(tmp_path / name, text)
    tables, rejects = load_xml(spark, str(tmp_path), as_of="2025-05-31")
    assert tables["declarations"].count() == 1
    assert [(r.rule, r.raw_value.rsplit("/", 1)[1]) for r in rejects.collect()] == [("readable", "other.xml")]


def test_compressed_files_are_loaded(spark, tmp_path):
    for source, text, options in (("json", json.dumps(record("um")), {}),
                                  ("xml", XML.format("111", 1), {"as_of": "2025-05-31", "key": F.col("cpf")})):
        f = Folder(spark, tmp_path / source, source=source, **options)
        (tmp_path / source / "in").mkdir(parents=True)
        (tmp_path / source / "in" / f"a.{source}.gz").write_bytes(gzip.compress(text.encode()))
        assert f.run() and not f.run()
        assert f.rows("pagamentos_efetuados", "codigo", "valor_pago") == [("10" if source == "json" else "01", "1.00")]
        assert f.rows("rejects", "rule") == []


def test_a_first_load_moves_no_lines(spark, tmp_path, monkeypatch):
    """Lines are written from the tasks that read their returns: no table's plan has a shuffle or a join."""
    f, plans = Folder(spark, tmp_path), {}
    f.put("a.json", [record(f"n{i}") for i in range(20)])
    update = Store.update

    def seen(store, changes, files=None):
        for name, change in changes.items():
            if name in (DECLARATIONS, *SCHEDULES):
                plans[name] = change.rows._jdf.queryExecution().executedPlan().toString()
        return update(store, changes, files)

    monkeypatch.setattr(Store, "update", seen)
    assert f.run(buckets=2)
    assert len(plans["pagamentos_efetuados"]) > 0 and len(f.rows("pagamentos_efetuados", "codigo")) == 20
    assert not [n for n, p in plans.items() if "Exchange" in p or "Join" in p]


def test_rejects_are_not_looked_for_in_the_few_tasks_that_write(spark, tmp_path, monkeypatch):
    """With few files per table, joined partitions would have one task read whole schedules for a handful of rejects."""
    plans, update = {}, Store.update

    def watched(self, changes, files=None):
        plans.update({n: c.rows._jdf.queryExecution().optimizedPlan().toString() for n, c in changes.items() if c.rows is not None})
        return update(self, changes, files)

    monkeypatch.setattr(Store, "update", watched)
    f = Folder(spark, tmp_path, buckets=2)
    f.put("a.json", [record("um"), record("dois", paid="x"), record("três", paid=None)])
    f.run()
    assert plans["rejects"].startswith(("RepartitionByExpression", "Repartition"))
    # Lines that break no rule are not given a list of what is wrong.
    assert "array" not in plans["pagamentos_efetuados"].split("Generate")[0]
    assert f.rows("pagamentos_efetuados", "valor_pago") == [("1.00",)]
    assert f.rows("rejects", "column_name", "rule", "raw_value") == [
        ("valor_pago", "money", "x"), ("valor_pago", "required", "None")]
