"""Nested JSON returns, assembling, checks."""

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks import render
from fiscolake.operators import shred, validate
from fiscolake.plans.documents import checked_tables
from fiscolake.schemas import ALL_TABLES, SCHEDULES, empty_table, table_schema
from fiscolake.sources.readers import read_extracted_documents, read_json_returns

RETURNS = [
    {"bens_direitos": [
        {"grupo": "01", "codigo": "11", "localizacao_pais": "249", "discriminacao": "Casa",
         "situacao_31_12_2023": 10.5, "situacao_31_12_2024": "12.00", "extra": 1},
        {"grupo": "02", "codigo": "01", "discriminacao": "Carro", "valor_2023": "7.00", "valor_2024": None,
         "repetir_valor": True},
        {"grupo": "02", "codigo": "01", "discriminacao": "Moto", "valor_2023": "7.00", "valor_2024": "3.00",
         "repetir_valor": True},
        {"grupo": "02", "codigo": "01", "discriminacao": "Sem valor", "valor_2023": "7.00"}],
     "data_documento": "2025-03-01", "summary": "Resumo simples", "unknown": {"a": 1},
     "pagamentos_efetuados": [{"codigo": "10", "cpf_beneficiario": "123.456.789-09", "valor_pago": 3}]},
    {"summary": {"text": "Resumo em objeto é"}, "data_documento": "2025-03-02", "bens_direitos": [],
     "doacoes_efetuadas": None, "rendimentos_tributaveis_pj": [
         {"cpf_cnpj_fonte_pagadora": "1.2", "nome_fonte_pagadora": "F", "cpf_beneficiario": "12345678909",
          "rendimentos": "1.999"}]},
]


@pytest.fixture(scope="module")
def returns(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("json")
    for i, r in enumerate(RETURNS):
        (root / f"r{i}.json").write_text(json.dumps([r], ensure_ascii=False), encoding="utf-8")
    return read_json_returns(spark, str(root), key=F.regexp_extract("file_name", "^(.*)[.]json$", 1))


def test_json_tables(returns):
    t = shred.shred(returns, "json")
    d = {r.declaration_id: r for r in t["declarations"].collect()}
    assert d["r0"].summary == "Resumo simples" and d["r1"].summary == "Resumo em objeto é"
    assert d["r0"].file_name == "r0.json" and d["r0"].file_path.endswith("/r0.json")
    b = {r.discriminacao: r for r in t["bens_direitos"].collect()}
    assert (b["Casa"].pais, b["Casa"].valor_2023, b["Casa"].valor_2024) == ("249", Decimal("10.50"), Decimal("12.00"))
    assert (b["Carro"].pais, b["Carro"].valor_2024) == ("105", Decimal("7.00"))
    assert b["Moto"].valor_2024 == Decimal("3.00") and b["Sem valor"].valor_2024 is None
    (p,) = t["pagamentos_efetuados"].collect()
    assert (p.declaration_id, p.cpf_beneficiario, p.parcela_nao_dedutivel) == ("r0", "12345678909", Decimal("0.00"))
    assert t["doacoes_efetuadas"].count() == 0
    for name in ALL_TABLES:
        assert set(t[name].columns) == set(table_schema(name).fieldNames())
        assert {f.name: f.dataType for f in t[name].schema} == {f.name: f.dataType for f in table_schema(name)}


def test_json_rejects(returns):
    tables, rejects = checked_tables(returns, "json")
    assert {tuple(r) for r in rejects.collect()} == {
        ("r0", "bens_direitos", "valor_2024", "required", None),
        ("r1", "rendimentos_tributaveis_pj", "rendimentos", "money", "1.999")}
    assert tables["bens_direitos"].count() == 3


def _flat(spark, n_lines):
    own = [(i, f"/in/{i}.xml", f"{i}.xml", f"resumo {i}") for i in range(3)]
    tables = {n: empty_table(spark, n, table_schema(n, None)["declaration_id"].dataType) for n in SCHEDULES}
    tables["declarations"] = spark.createDataFrame(
        [(str(a), b, c, d) for a, b, c, d in own], table_schema("declarations"))
    tables["doacoes_efetuadas"] = spark.createDataFrame(
        [(str(0 if i % 3 else i % 2 + 1), str(i), None, f"n {i}", Decimal(i)) for i in range(n_lines)],
        table_schema("doacoes_efetuadas"))
    return tables


@pytest.mark.parametrize("max_lines", [100_000, 10])
def test_assemble_then_flatten_is_identity(spark, max_lines):
    """Return 0 holds two thirds of the lines; with small pages it is split."""
    tables = _flat(spark, 300)
    typed = shred.assemble(tables, data_documento=F.lit("2025-01-01").cast("date"), max_lines=max_lines)
    sizes = [r.n for r in typed.select(F.size("doacoes_efetuadas").alias("n")).collect()]
    assert max(sizes) <= (300 if max_lines > 300 else 40) and sum(sizes) == 300
    assert typed.count() == 3 if max_lines > 300 else typed.count() > 20
    back = shred.flatten_returns(typed)
    for name in ALL_TABLES:
        cols = table_schema(name).fieldNames()
        assert (sorted(map(str, back[name].select(cols).collect()))
                == sorted(map(str, tables[name].select(cols).collect()))), name


def test_assemble_drops_lines_without_return(spark):
    tables = _flat(spark, 30)
    tables["declarations"] = tables["declarations"].where("declaration_id = '1'")
    typed = shred.assemble(tables, data_documento=F.lit(None).cast("date"))
    assert [r.declaration_id for r in typed.collect()] == ["1"]


def test_return_json(spark):
    tables = _flat(spark, 3)
    typed = shred.assemble(tables, data_documento=F.lit("2025-01-01").cast("date"))
    docs = {r.declaration_id: json.loads(r.document) for r in shred.return_json(typed).collect()}
    line = docs["0"]["doacoes_efetuadas"][0]
    assert line["cnpj_proponente"] is None and line["valor_pago"] in ("1.00", "2.00")
    assert docs["0"]["data_documento"] == "2025-01-01" and docs["0"]["bens_direitos"] == []


def test_money_as_double(spark):
    df = shred.money_as_double(_flat(spark, 3)["doacoes_efetuadas"])
    assert df.schema["valor_pago"].dataType.typeName() == "double"
    nested = shred.money_as_double(shred.assemble(_flat(spark, 3), data_documento=F.lit(None).cast("date")))
    assert "decimal" not in nested.schema.simpleString()


def test_dense_ids(spark):
    rows = [(f"k{i}", f"/in/{(i * 37) % 101:03d}", "f", "s") for i in range(101)]
    ids = shred.dense_ids(spark.createDataFrame(rows, table_schema("declarations"))).collect()
    assert [r.declaration_id for r in sorted(ids, key=lambda r: r.file_path)] == list(range(101))


def test_keys(spark):
    lines = spark.createDataFrame([(1,)] * 50 + [(2,), (9,), (9,)], "declaration_id int")
    parents = spark.createDataFrame([(1,), (2,)], "declaration_id int")
    assert [tuple(r) for r in validate.orphan_keys(lines, parents).collect()] == [(9, 2)]
    assert validate.orphan_lines(lines, parents).count() == 2
    assert sorted(tuple(r) for r in validate.duplicate_keys(lines, "declaration_id").collect()) == [(1, 50), (9, 2)]


def test_empty_summary_is_rejected(spark):
    d = spark.createDataFrame([("a", "p", "n", ""), ("b", "p", "n", "x"), ("c", "p", "n", None)],
                              table_schema("declarations"))
    good, bad = validate.split_declarations(d)
    assert [r.declaration_id for r in good.collect()] == ["b"]
    assert sorted(r.declaration_id for r in bad.collect()) == ["a", "c"]


def test_extracted_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"text": "olá", "metadata": {"file_name": "x.pdf"}, "id": 1}]))
    (r,) = read_extracted_documents(spark, str(tmp_path)).collect()
    assert r.text == "olá" and r.metadata == {"file_name": "x.pdf"}


def test_date_of_a_json_return(returns):
    assert {r.data_documento for r in returns.collect()} == {datetime.date(2025, 3, 1), datetime.date(2025, 3, 2)}


def test_documents_without_some_schedules(spark):
    own = spark.createDataFrame([(1, "/in/a.xml", "a.xml", "s")], "declaration_id long, file_path string, file_name string, summary string")
    returns = render.nested({"declarations": own}, date=F.lit("2025-01-01").cast("date"))
    docs = shred.return_json(returns, without=("doacoes_efetuadas", "bens_direitos"))
    found = json.loads(docs.first().document)
    assert set(found) == {*SCHEDULES, "data_documento", "summary"} - {"doacoes_efetuadas", "bens_direitos"}
    assert render.json_documents(returns, "doacoes_efetuadas", "bens_direitos").collect() == docs.collect()
