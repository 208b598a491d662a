"""Returns rendered as XML or JSON text, the input of the round-trip queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscolake.operators.shred import assemble, return_json
from fiscolake.schemas import ALL_TABLES, SCHEDULES, empty_table
from fiscolake.sources.xml import ROOT_TAG

# Line numbers of the given tables run from 1 to 7; each is one kind of income.
KINDS = [f"rend{n}QuadroAuxiliar" for n in range(1, 8)]


def br_money(c: Column) -> Column:
    """1234.56 as ``1.234,56``."""
    return F.translate(F.format_number(c, 2), ",.", ".,")


def _money_items(lines: str, text: dict[str, str], amounts: dict[str, str], where=None,
                 fixed: dict[str, Column] | None = None) -> Column:
    kept = F.filter(lines, where) if where else F.col(lines)
    return F.transform(kept, lambda x: F.struct(
        *[x[c].alias("_" + a) for a, c in text.items()],
        *[br_money(x[c]).alias("_" + a) for a, c in amounts.items()],
        *[v(x).alias("_" + a) for a, v in (fixed or {}).items()])).alias("item")


def _flag(label: Column) -> Column:
    return (F.when(label == "dependente", "d").when(label == "alimentando", "A").otherwise("T"))


def _other_income(table: str) -> list[Column]:
    text = {"cpfBeneficiario": "cpf_beneficiario", "cnpjEmpresa": "cnpj_fonte_pagadora",
            "nomeFonte": "nome_fonte_pagadora"}

    def section(kind: str) -> Column:
        lines = _money_items(table, text, {"valor": "valor"}, lambda x: x["tipo_rendimento"] == kind,
                             {"tipoBeneficiario": lambda x: _flag(x["tipo_beneficiario"])})
        return F.struct(F.lit("0,00").alias("_totalQuadro"), lines).alias(kind)

    return [section(kind) for kind in KINDS]


def _salary(tag: str, remainder: int) -> Column:
    """Payers with an even number pay the holder, the others the dependant."""
    return F.struct(_money_items(
        "rendimentos_tributaveis_pj",
        {"NIFontePagadora": "cpf_cnpj_fonte_pagadora", "nomeFontePagadora": "nome_fonte_pagadora",
         "cpfBeneficiario": "cpf_beneficiario"},
        {"rendRecebidoPJ": "rendimentos", "contribuicaoPrevOficial": "contribuicao_previdenciaria",
         "impostoRetidoFonte": "imposto_retido", "decimoTerceiro": "decimo_terceiro",
         "IRRFDecimoTerceiro": "irrf_decimo_terceiro"},
        lambda x: x["cpf_cnpj_fonte_pagadora"].cast("long") % 2 == remainder)).alias(tag)


SECTIONS = {
    "bens_direitos": lambda: F.struct(F.lit("9").alias("_total"), _money_items(
        "bens_direitos", {"grupo": "grupo", "codigo": "codigo", "pais": "pais",
                          "discriminacao": "discriminacao"},
        {"valorExercicioAnterior": "valor_2023", "valorExercicioAtual": "valor_2024"})).alias("bens"),
    "pagamentos_efetuados": lambda: F.struct(_money_items(
        "pagamentos_efetuados",
        {"codigo": "codigo", "cpfBeneficiario": "cpf_beneficiario",
         "niBeneficiario": "cpf_cnpj_prestador", "nomeBeneficiario": "nome_beneficiario"},
        {"valorPago": "valor_pago", "parcelaNaoDedutivel": "parcela_nao_dedutivel"},
        fixed={"tipo": lambda x: _flag(x["pessoa_beneficiada"])})).alias("pagamentos"),
    "doacoes_efetuadas": lambda: F.struct(_money_items(
        "doacoes_efetuadas", {"codigo": "codigo", "cnpjProponente": "cnpj_proponente",
                              "nomeProponente": "nome_proponente"},
        {"valorPago": "valor_pago"})).alias("doacoes"),
    "rendimentos_tributaveis_pj": lambda: F.struct(
        _salary("colecaoRendPJTitular", 0), _salary("colecaoRendPJDependente", 1)).alias("rendPJ"),
    "rendimentos_isentos": lambda: F.struct(
        F.lit("1").alias("_versao"), *_other_income("rendimentos_isentos")).alias("rendIsentos"),
    "rendimentos_exclusivos": lambda: F.struct(
        *_other_income("rendimentos_exclusivos")).alias("rendTributacaoExclusiva"),
}


def nested(tables: dict[str, DataFrame], *, date: Column, max_lines: int = 100_000) -> DataFrame:
    """Nested returns from some of the tables; the other schedules are empty."""
    spark = tables["declarations"].sparkSession
    key = tables["declarations"].schema["declaration_id"].dataType
    full = {n: tables.get(n) for n in ALL_TABLES}
    full = {n: empty_table(spark, n, key) if df is None else df for n, df in full.items()}
    return assemble(full, data_documento=date, max_lines=max_lines)


def xml_returns(returns: DataFrame, *sections: str) -> DataFrame:
    """``declaration_id, declaracao``: the return as a struct laid out like its XML."""
    cpf = F.lpad(F.col("declaration_id").cast("string"), 11, "0")
    document = F.struct(
        F.lit("http://www.receita.example/declaracao").alias("_xmlns"),
        F.struct(cpf.alias("_cpf"), F.regexp_replace("file_name", "[.]xml$", "").alias("_nome"))
        .alias("identificadorDeclaracao"),
        F.struct(F.lit("data").alias("_tipo"), F.col("data_documento").cast("string").alias("_VALUE"))
        .alias("dataDeclaracao"),
        *[SECTIONS[s]() for s in sections])
    return returns.select("declaration_id", document.alias(ROOT_TAG))


def xml_texts(documents: DataFrame) -> tuple[DataFrame, T.StructType]:
    """``declaration_id, xml`` and the layout of the text."""
    text = F.to_xml(ROOT_TAG, {"rowTag": ROOT_TAG, "indent": ""})
    return documents.select("declaration_id", text.alias("xml")), documents.schema[ROOT_TAG].dataType


def write_xml(documents: DataFrame, path: str) -> None:
    """Files of many returns each, below a common root. As gzip: tags are most of their text."""
    (documents.select(f"{ROOT_TAG}.*").write.format("xml").option("rootTag", "lote")
     .option("rowTag", ROOT_TAG).option("compression", "gzip").save(path))


def json_documents(returns: DataFrame, *drop: str) -> DataFrame:
    """``declaration_id, document``; the named schedules are left out of the text."""
    return return_json(returns, without=drop)


def docs_schema() -> T.StructType:
    lists = [T.StructField(n, T.ArrayType(T.StructType([
        T.StructField(f.name, T.StringType()) for f in s.fields]))) for n, s in SCHEDULES.items()]
    return T.StructType([*lists, T.StructField("data_documento", T.StringType()),
                         T.StructField("summary", T.StructType([T.StructField("text", T.StringType())]))])
