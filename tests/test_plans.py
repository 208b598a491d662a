"""End-to-end loads, streams and set-up."""

import json
import os
import time

from pyspark.sql import functions as F

from fiscolake.operators.shred import shred
from fiscolake.plans.bootstrap import set_up
from fiscolake.plans.documents import process_documents, read_stored
from fiscolake.plans.knowledge import build_knowledge_base, query_knowledge_base
from fiscolake.schemas import ALL_TABLES
from fiscolake.sources.readers import read_collection, read_json_returns
from fiscolake.sources.xml import learn_layout, read_xml_returns
from fiscolake.streaming import arrivals
from tests.test_xml import BAD, FULL, SPARSE


def _put(path, text, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    if at:
        os.utime(path, (at, at))


def _texts(df):
    return sorted(r.text for r in df.collect())


def test_knowledge_base(spark, tmp_path):
    kb, store, log = tmp_path / "kb", str(tmp_path / "col"), str(tmp_path / "log")
    assert build_knowledge_base(spark, str(kb), store, log)[1] is False
    now = time.time()
    _put(kb / "a ção+1 [x] 100%.txt", "prazo de entrega", now - 50)
    _put(kb / "sub" / "b.md", "bens e direitos", now - 50)
    _put(kb / "s.json", json.dumps([json.dumps({"url": "u", "text": "página raspada"}),
                                    json.dumps({"url": "v", "text": "outra página"})]), now - 50)
    collection, done = build_knowledge_base(spark, str(kb), store, log)
    assert done and _texts(collection) == ["bens e direitos", "outra página", "prazo de entrega", "página raspada"]
    assert build_knowledge_base(spark, str(kb), store, log)[1] is False
    _put(kb / "a ção+1 [x] 100%.txt", "prazo adiado", now)
    _put(kb / "s.json", json.dumps([json.dumps({"url": "u", "text": "página nova"})]), now)
    collection, done = build_knowledge_base(spark, str(kb), store, log)
    assert done and _texts(collection) == ["bens e direitos", "prazo adiado", "página nova"]
    (kb / "sub" / "b.md").rename(tmp_path / "b.md")
    collection, done = build_knowledge_base(spark, str(kb), store, log)
    assert done and _texts(collection) == ["prazo adiado", "página nova"]
    assert build_knowledge_base(spark, str(kb), store, log)[1] is False
    assert build_knowledge_base(spark, str(kb), store, log, force=True)[1]
    assert _texts(read_collection(spark, store)) == ["prazo adiado", "página nova"]
    best = query_knowledge_base(spark, store, "qual o prazo?", k=1).first()
    assert best.context == "prazo adiado"


RETURN = {"summary": {"text": "s"}, "data_documento": "2025-01-01", "pagamentos_efetuados": [
    {"codigo": "10", "cpf_beneficiario": "12345678909", "valor_pago": "1.00"},
    {"codigo": "10", "cpf_beneficiario": "1", "valor_pago": "1.00"}]}


def test_process_documents(spark, tmp_path):
    src, log, out = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "out")
    assert process_documents(spark, str(src), log, out) is False
    now = time.time()
    _put(src / "a ç [1]+.json", json.dumps(RETURN), now - 50)
    assert process_documents(spark, str(src), log, out) is True
    assert read_stored(spark, out, "pagamentos_efetuados").count() == 1
    assert read_stored(spark, out, "rejects").first().rule == "length"
    assert process_documents(spark, str(src), log, out) is False
    assert process_documents(spark, str(src), log, out, force=True) is True
    _put(src / "b.json", json.dumps(RETURN), now)
    assert process_documents(spark, str(src), log, out) is True
    assert read_stored(spark, out, "declarations").count() == 2
    # One changed file: the other's rows stay, its own are replaced.
    _put(src / "b.json", json.dumps([{**RETURN, "pagamentos_efetuados": []}, {**RETURN, "summary": "dois"}]), now + 5)
    assert process_documents(spark, str(src), log, out) is True
    names = [r.file_name for r in read_stored(spark, out, "declarations").collect()]
    assert sorted(names) == ["a ç [1]+.json", "b.json", "b.json"]
    assert read_stored(spark, out, "pagamentos_efetuados").count() == 2
    # A removed file takes its rows along.
    (src / "a ç [1]+.json").rename(tmp_path / "a.json")
    assert process_documents(spark, str(src), log, out) is True
    assert process_documents(spark, str(src), log, out) is False
    assert read_stored(spark, out, "declarations").count() == 2
    _put(src / "b.json", json.dumps({**RETURN, "pagamentos_efetuados": []}), now + 9)
    _put(src / "c.json", json.dumps(RETURN), now + 9)
    assert process_documents(spark, str(src), log, out, strict=True) is True
    assert [r.file_name for r in read_stored(spark, out, "declarations").collect()] == ["b.json"]
    assert read_stored(spark, out, "rejects").count() == 1


def test_process_xml_documents(spark, tmp_path):
    src, log, out = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "out")
    _put(src / "full.xml", FULL)
    _put(src / "broken.xml", "<declaracao><bens><item></bens></declaracao>")

    def run():
        return process_documents(spark, str(src), log, out, source="xml", as_of="2025-05-31")
    assert run() is True and run() is False
    assert read_stored(spark, out, "bens_direitos").count() == 2
    assert [r.rule for r in read_stored(spark, out, "rejects").collect()] == ["readable"]
    _put(src / "broken.xml", SPARSE, time.time() + 9)
    assert run() is True
    assert read_stored(spark, out, "declarations").count() == 2
    assert read_stored(spark, out, "rejects").count() == 0


def _same(spark, out, batch):
    for name, df in batch.items():
        got = arrivals.read_streamed(spark, out, name).select(df.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, df.collect())), name


def test_xml_stream_equals_batch(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    _put(src / "full.xml", FULL)
    layout = learn_layout(spark, str(src))
    _put(src / "sparse.xml", SPARSE)

    def run():
        arrivals.stream_xml_returns(spark, str(src), layout, out, mark, as_of="2025-05-31",
                                    files_per_batch=1).awaitTermination()
    run()
    returns = read_xml_returns(spark, str(src), as_of="2025-05-31", layout=layout)
    _same(spark, out, shred(returns, "xml"))
    run()  # nothing new: nothing changes
    _same(spark, out, shred(returns, "xml"))
    _put(src / "bad.xml", BAD)
    run()
    assert arrivals.read_streamed(spark, out, "declarations").count() == 3
    assert arrivals.read_streamed(spark, out, "rejects").count() > 0


def test_json_stream_equals_batch(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    good = {**RETURN, "pagamentos_efetuados": RETURN["pagamentos_efetuados"][:1]}
    for i in range(3):
        _put(src / f"{i}.json", json.dumps(good))
    arrivals.stream_json_returns(spark, str(src), out, mark, files_per_batch=2).awaitTermination()
    _same(spark, out, shred(read_json_returns(spark, str(src)), "json"))


def test_text_stream(spark, tmp_path):
    src, store, mark = tmp_path / "in", str(tmp_path / "col"), str(tmp_path / "mark")
    for i in range(3):
        _put(src / f"{i}.txt", f"texto {i}.\nOutra linha")
    for _ in range(2):
        arrivals.stream_texts(spark, str(src), store, mark, files_per_batch=2).awaitTermination()
    assert _texts(read_collection(spark, store)) == [f"texto {i}. Outra linha" for i in range(3)]


def test_set_up(spark, tmp_path):
    for name in ALL_TABLES:  # views other tests left
        spark.catalog.dropTempView(name)
    done = set_up(spark, knowledge=str(tmp_path / "kb"), documents=str(tmp_path / "in"), store=str(tmp_path / "st"))
    assert (done.knowledge_updated, done.documents_processed) == (False, False) and len(done.declared) in (0, 6)
    assert {r.status for r in done.report.collect()} == {"empty"}
    _put(tmp_path / "in" / "a.json", json.dumps(RETURN))
    _put(tmp_path / "kb" / "a ção+1 [x] 100%.txt", "texto")
    done = set_up(spark, knowledge=str(tmp_path / "kb"), documents=str(tmp_path / "in"), store=str(tmp_path / "st"))
    assert done.knowledge_updated and done.documents_processed and done.declared == []
    assert spark.table("pagamentos_efetuados").where(F.col("codigo") == "10").count() == 1


def test_load_loses_and_doubles_nothing(spark, tmp_path):
    """Sub-folders, several returns per file under the default key, a repeated return, a file of another root, one without any element."""
    src = tmp_path / "in" / "below"
    src.mkdir(parents=True)
    one = ('<declaracao><identificadorDeclaracao cpf="{0}" nome="N{0}"/><pagamentos><item codigo="1" valorPago="1,00"/>'
           "</pagamentos></declaracao>")
    (src / "two.xml").write_text("<all>" + one.format("11111111111") + one.format("22222222222") + one.format("11111111111") + "</all>")
    (src.parent / "one.xml").write_text(one.format("33333333333"))
    (src / "other.xml").write_text("<other><x/></other>")
    (src / "bare.xml").write_text("<!-- nothing -->")
    out = str(tmp_path / "out")
    from fiscolake.plans.documents import process_documents, read_stored
    assert process_documents(spark, str(tmp_path / "in"), str(tmp_path / "manifest"), out, source="xml", as_of="2025-05-31")
    assert read_stored(spark, out, "declarations").count() == 3
    assert read_stored(spark, out, "declarations").select("declaration_id").distinct().count() == 3
    unread = read_stored(spark, out, "rejects").where("rule = 'readable'").collect()
    assert sorted(r.raw_value.rsplit("/", 1)[1] for r in unread) == ["bare.xml", "other.xml"]
    assert not process_documents(spark, str(tmp_path / "in"), str(tmp_path / "manifest"), out, source="xml", as_of="2025-05-31")
