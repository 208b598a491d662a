from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.render import write_xml
from fiscolake.operators.shred import flatten_returns, return_json, shred, typed_returns
from fiscolake.plans.documents import load_xml, read_tax_return, requested_documents, return_documents
from fiscolake.schemas import SCHEDULES
from fiscolake.sources.xml import ROOT_TAG, learn_layout, read_xml_returns

FULL = """<?xml version="1.0" encoding="UTF-8"?>
<declaracao xmlns="http://www.receita.example/declaracao" versao="1">
  <identificadorDeclaracao cpf="12345678909" nome="Ana &amp; Filhos"/>
  <dataDeclaracao tipo="d">2025-04-07</dataDeclaracao>
  <patrimonio total="9">
    <bens total="3"><item grupo="1" codigo="105" pais="249" discriminacao=" Casa &lt;azul&gt; "
        valorExercicioAnterior="1.234,56" valorExercicioAtual="2.000,00"/>
      <!-- <item grupo="9"/> -->
      <item codigo="2" valorExercicioAtual="10"/></bens>
  </patrimonio>
  <pagamentos><item codigo="9" tipo="d" niBeneficiario="11.222.333/0001-44" nomeBeneficiario="Clínica"
      valorPago="300,10" parcelaNaoDedutivel=""/></pagamentos>
  <doacoes><item codigo="40" cnpjProponente="1" valorPago="5"/><item codigo="43" valorPago="6,5"/></doacoes>
  <rendPJ><colecaoRendPJTitular><item NIFontePagadora="12.345" nomeFontePagadora="Empresa"
      rendRecebidoPJ="100,00" decimoTerceiro="8,33" cpfBeneficiario=""/></colecaoRendPJTitular>
    <colecaoRendPJDependente total="1"><item NIFontePagadora="77" nomeFontePagadora="Outra"
      cpfBeneficiario="11111111111" rendRecebidoPJ="50"/></colecaoRendPJDependente></rendPJ>
  <rendIsentos total="7">
    <bolsasQuadroAuxiliar total="1"><item tipoBeneficiario="A" valor="1,00" descricaoRendimento="Bolsa"
        cpfBeneficiario="222.222.222-22"/></bolsasQuadroAuxiliar>
    <outros><item valor="99,00"/></outros>
    <nivel><poupancaQuadroAuxiliar><item valor="2,00" nomeFonte="Banco A &amp; B"/><item valor="3,00"/>
      </poupancaQuadroAuxiliar></nivel>
  </rendIsentos>
  <rendTributacaoExclusiva><item valor="4,00" nomeFonte="Direta" cnpjEmpresa="9"/>
    <aplicacoes><fundos><item valor="5,00" nomeFonte="Funda" cnpjEmpresa="8"/></fundos></aplicacoes>
  </rendTributacaoExclusiva>
</declaracao>"""
SPARSE = """<declaracao xmlns="http://www.receita.example/declaracao"><bens/><pagamentos></pagamentos>
<doacoes><item/></doacoes></declaracao>"""
BAD = """<declaracao xmlns="http://www.receita.example/declaracao">
<identificadorDeclaracao cpf="9"/><dataDeclaracao>07/04/2025</dataDeclaracao>
<pagamentos><item codigo="1" cpfBeneficiario="123" valorPago="1,239"/><item codigo="2" valorPago="x"/></pagamentos>
<rendPJ><colecaoRendPJTitular><item nomeFontePagadora="Sem id" rendRecebidoPJ="1"/></colecaoRendPJTitular></rendPJ>
<rendTributacaoExclusiva><q><item valor="1" nomeFonte="N"/></q></rendTributacaoExclusiva></declaracao>"""
BROKEN = "<declaracao><bens><item grupo='1'></bens></declaracao>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("xml")
    for name, text in (("full", FULL), ("sparse", SPARSE), ("bad", BAD), ("broken", BROKEN)):
        (root / f"{name}.xml").write_text(text, encoding="utf-8")
    prefixed = FULL.replace("xmlns=", "xmlns:rf=").replace("</", "</rf:")
    for tag in ("declaracao", "identificadorDeclaracao", "dataDeclaracao", "patrimonio", "bens", "item", "pagamentos",
                "doacoes", "rendPJ", "colecaoRendPJTitular", "colecaoRendPJDependente", "rendIsentos",
                "bolsasQuadroAuxiliar", "outros", "nivel", "poupancaQuadroAuxiliar", "rendTributacaoExclusiva",
                "aplicacoes", "fundos"):
        for end in (" ", ">", "/"):
            prefixed = prefixed.replace(f"<{tag}{end}", f"<rf:{tag}{end}")
    (root / "prefixed.xml").write_text(prefixed, encoding="utf-8")
    return root


def by_name():
    return F.regexp_extract("file_path", r"([a-z]+)[.]xml$", 1)


@pytest.fixture(scope="module")
def tables(spark, folder):
    returns = read_xml_returns(spark, str(folder), as_of="2025-05-31", key=by_name())
    return {n: df.collect() for n, df in shred(returns.where("parse_error IS NULL"), "xml").items()}


def rows(tables, name, key="full"):
    return [r for r in tables[name] if r.declaration_id == key]


def test_assets(tables):
    a, b = rows(tables, "bens_direitos")
    assert (a.grupo, a.codigo, a.pais, a.discriminacao) == ("01", "105", "249", "Casa <azul>")
    assert (a.valor_2023, a.valor_2024, a.repetir_valor) == (Decimal("1234.56"), Decimal("2000.00"), False)
    assert (b.grupo, b.codigo, b.pais, b.discriminacao, b.valor_2023) == ("00", "02", "105", "", Decimal("0.00"))


def test_payments_and_donations(tables):
    (p,) = rows(tables, "pagamentos_efetuados")
    assert (p.codigo, p.pessoa_beneficiada, p.cpf_beneficiario) == ("09", "dependente", "11222333000144")
    assert (p.cpf_cnpj_prestador, p.nome_prestador, p.nome_beneficiario) == ("11222333000144", "Clínica", "Clínica")
    assert (p.descricao, p.valor_pago, p.parcela_nao_dedutivel) == (None, Decimal("300.10"), Decimal("0.00"))
    d = rows(tables, "doacoes_efetuadas")
    assert [(x.codigo, x.cnpj_proponente, x.valor_pago) for x in d] == [
        ("40", "1", Decimal("5.00")), ("43", None, Decimal("6.50"))]


def test_salary_of_holder_and_dependant(tables):
    h, d = sorted(rows(tables, "rendimentos_tributaveis_pj"), key=lambda r: r.rendimentos, reverse=True)
    assert (h.cpf_cnpj_fonte_pagadora, h.cpf_beneficiario, h.beneficiario) == ("12345", "0" * 11, "")
    assert (h.decimo_terceiro, h.imposto_retido) == (Decimal("8.33"), Decimal("0.00"))
    assert (d.nome_fonte_pagadora, d.cpf_beneficiario) == ("Outra", "1" * 11)


def test_income_kinds_come_from_the_tag_around(tables):
    e = {(r.tipo_rendimento, r.valor): r for r in rows(tables, "rendimentos_isentos")}
    assert set(e) == {("bolsasQuadroAuxiliar", Decimal("1.00")), ("poupancaQuadroAuxiliar", Decimal("2.00")),
                      ("poupancaQuadroAuxiliar", Decimal("3.00"))}
    first = e["bolsasQuadroAuxiliar", Decimal("1.00")]
    assert (first.nome_fonte_pagadora, first.tipo_beneficiario, first.cpf_beneficiario) == (
        "Bolsa", "alimentando", "22222222222")
    assert e["poupancaQuadroAuxiliar", Decimal("2.00")].nome_fonte_pagadora == "Banco A & B"
    x = {r.tipo_rendimento: r.nome_fonte_pagadora for r in rows(tables, "rendimentos_exclusivos")}
    assert x == {"rendTributacaoExclusiva": "Direta", "fundos": "Funda"}


def test_prefixed_namespace_reads_the_same(tables):
    for name in SCHEDULES:
        strip = [[tuple(r)[1:] for r in rows(tables, name, k)] for k in ("full", "prefixed")]
        assert sorted(map(str, strip[0])) == sorted(map(str, strip[1])), name


def test_sparse_return(spark, folder, tables):
    assert [len(rows(tables, n, "sparse")) for n in SCHEDULES] == [0, 1, 0, 0, 0, 0]
    returns = read_xml_returns(spark, str(folder / "sparse.xml"), as_of="2025-05-31")
    r = returns.collect()[0]
    assert str(r.data_documento) == "2025-05-31"
    assert r.summary == "Declaração IRPF-2025 de declarante (CPF ???)."
    assert len(r.declaration_id) == 64


def test_rejects(spark, folder):
    tables, rejects = load_xml(spark, str(folder), as_of="2025-05-31", key=by_name())
    got = {(r.declaration_id, r.table_name, r.column_name, r.rule, r.raw_value) for r in rejects.collect()}
    mine = {g[1:] for g in got if g[0] == "bad"}
    assert mine == {
        ("pagamentos_efetuados", "cpf_beneficiario", "length", "123"),
        ("pagamentos_efetuados", "valor_pago", "money", "1,239"),
        ("pagamentos_efetuados", "valor_pago", "money", "x"),
        ("rendimentos_tributaveis_pj", "cpf_cnpj_fonte_pagadora", "required", None),
        ("rendimentos_exclusivos", "cnpj_fonte_pagadora", "required", None)}
    assert {g[1:4] for g in got if g[0] == "broken"} == {("declarations", "file_path", "readable")}
    assert tables["pagamentos_efetuados"].where("declaration_id = 'bad'").count() == 0
    strict, _ = load_xml(spark, str(folder), as_of="2025-05-31", key=by_name(), strict=True)
    assert {r.declaration_id for r in strict["declarations"].collect()} == {"full", "sparse", "prefixed"}


def test_layout_may_be_passed_in(spark, folder):
    layout = learn_layout(spark, str(folder / "full.xml"))
    given = read_xml_returns(spark, str(folder / "sparse.xml"), as_of="2025-05-31", layout=layout)
    assert given.select(F.size("doacoes_efetuadas")).first()[0] == 1


def test_read_tax_return(spark, folder):
    import json
    ok = json.loads(read_tax_return(spark, str(folder / "full.xml"), as_of="2025-05-31").first().document)
    assert ok["summary"] == {"text": "Declaração IRPF-2025 de Ana & Filhos (CPF 12345678909)."}
    assert ok["data_documento"] == "2025-04-07"
    assert ok["bens_direitos"][0]["valor_2023"] == "1234.56"
    assert ok["pagamentos_efetuados"][0]["descricao"] is None
    missing = read_tax_return(spark, str(folder / "none.xml"), as_of="2025-05-31").first().document
    assert json.loads(missing) == {"error": "Tax return file not found"}
    broken = json.loads(read_tax_return(spark, str(folder / "broken.xml"), as_of="2025-05-31").first().document)
    assert broken["error"].startswith("Failed to read tax return")


def test_requested_documents(spark, folder):
    import json
    documents = return_documents(spark, f"{folder}/*.xml", as_of="2025-05-31")
    asked = spark.createDataFrame([(f"file:{folder}/full.xml",), ("file:/none.xml",)], "file_path string")
    got = {r.file_path: json.loads(r.document) for r in requested_documents(asked, documents).collect()}
    assert got["file:/none.xml"] == {"error": "Tax return file not found"}
    assert len(got[f"file:{folder}/full.xml"]["doacoes_efetuadas"]) == 2


def test_typed_returns_and_flat_tables_agree(spark, folder):
    returns = read_xml_returns(spark, str(folder), as_of="2025-05-31", key=by_name()).where("parse_error IS NULL")
    flat, again = shred(returns, "xml"), flatten_returns(typed_returns(returns, "xml"))
    for name in flat:
        assert sorted(map(str, flat[name].collect())) == sorted(map(str, again[name].collect())), name
    assert return_json(typed_returns(returns, "xml")).count() == 4


def test_latin_files(spark, tmp_path):
    text = '<?xml version="1.0" encoding="ISO-8859-1"?><declaracao><identificadorDeclaracao nome="João" cpf="1"/><bens><item grupo="1" discriminacao="ação"/></bens></declaracao>'
    (tmp_path / "l.xml").write_bytes(text.encode("latin-1"))
    tables, _ = load_xml(spark, str(tmp_path), as_of="2025-05-31")
    assert tables["bens_direitos"].first().discriminacao == "ação"
    assert tables["declarations"].first().summary == "Declaração IRPF-2025 de João (CPF 1)."


def test_written_returns_are_compressed(spark, tmp_path):
    ident = F.struct(F.col("id").cast("string").alias("_cpf"), F.lit("Ana").alias("_nome")).alias("identificadorDeclaracao")
    path = str(tmp_path / "xml")
    write_xml(spark.range(500).select(F.struct(F.lit("x").alias("_xmlns"), ident).alias(ROOT_TAG)), path)
    assert all(p.name.endswith(".xml.gz") for p in (tmp_path / "xml").glob("part-*"))
    back = read_xml_returns(spark, path, as_of="2025-05-31", key=F.col("cpf").cast("long"))
    assert sorted(r.declaration_id for r in back.select("declaration_id").collect()) == list(range(500))
