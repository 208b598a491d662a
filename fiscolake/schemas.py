"""Explicit schemas of the tax data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
STORED_MONEY = "decimal(15,2)"

_KINDS = {"string": T.StringType(), "decimal(14,2)": MONEY, "boolean": T.BooleanType()}


def _struct(columns: str) -> T.StructType:
    """The struct of a plain list of columns; no session is needed to read it."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


# The columns of the six schedules. A line of a schedule is one struct.
SCHEDULES: dict[str, T.StructType] = {
    "bens_direitos": _struct(
        "grupo string, codigo string, pais string, discriminacao string, valor_2023 decimal(14,2), "
        "valor_2024 decimal(14,2), repetir_valor boolean"),
    "doacoes_efetuadas": _struct(
        "codigo string, cnpj_proponente string, nome_proponente string, valor_pago decimal(14,2)"),
    "pagamentos_efetuados": _struct(
        "codigo string, pessoa_beneficiada string, cpf_beneficiario string, nome_beneficiario string, "
        "cpf_cnpj_prestador string, nome_prestador string, descricao string, valor_pago decimal(14,2), "
        "parcela_nao_dedutivel decimal(14,2)"),
    "rendimentos_exclusivos": _struct(
        "tipo_rendimento string, tipo_beneficiario string, beneficiario string, cpf_beneficiario string, "
        "cnpj_fonte_pagadora string, nome_fonte_pagadora string, valor decimal(14,2)"),
    "rendimentos_isentos": _struct(
        "tipo_rendimento string, tipo_beneficiario string, beneficiario string, cpf_beneficiario string, "
        "cnpj_fonte_pagadora string, nome_fonte_pagadora string, valor decimal(14,2)"),
    "rendimentos_tributaveis_pj": _struct(
        "cpf_cnpj_fonte_pagadora string, nome_fonte_pagadora string, beneficiario string, cpf_beneficiario string, "
        "rendimentos decimal(14,2), contribuicao_previdenciaria decimal(14,2), imposto_retido decimal(14,2), "
        "decimo_terceiro decimal(14,2), irrf_decimo_terceiro decimal(14,2)"),
}

INCOME_TABLES = ("rendimentos_tributaveis_pj", "rendimentos_exclusivos", "rendimentos_isentos")
DECLARATIONS = "declarations"
ALL_TABLES = (DECLARATIONS, *SCHEDULES)


def declarations_schema(key_type: T.DataType | None = None) -> T.StructType:
    return T.StructType([
        T.StructField("declaration_id", key_type or T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("summary", T.StringType()),
    ])


def table_schema(name: str, key_type: T.DataType | None = None) -> T.StructType:
    """Flat schema of a served table: the return's key, then the line's columns."""
    if name == DECLARATIONS:
        return declarations_schema(key_type)
    key = T.StructField("declaration_id", key_type or T.StringType())
    return T.StructType([key, *SCHEDULES[name].fields])


def empty_table(spark: SparkSession, name: str, key_type: T.DataType | None = None) -> DataFrame:
    """A typed table without rows, for a schedule nobody filled in."""
    return spark.createDataFrame([], table_schema(name, key_type))


# Money may be written as a JSON number or as text, so it is read as text and
# typed afterwards. Aliases are the names under which a return may carry a field.
JSON_ALIASES = {
    "bens_direitos": {"pais": "localizacao_pais", "valor_2023": "situacao_31_12_2023",
                      "valor_2024": "situacao_31_12_2024"},
    "rendimentos_tributaveis_pj": {"decimo_terceiro": "decimo_terceiro_salario"},
}


def json_schema() -> T.StructType:
    """Reading schema for nested return JSON; fields outside it are ignored."""
    lists = []
    for name, line in SCHEDULES.items():
        names = line.fieldNames() + list(JSON_ALIASES.get(name, {}).values())
        struct = T.StructType([T.StructField(n, T.StringType()) for n in names])
        lists.append(T.StructField(name, T.ArrayType(struct)))
    plain = [T.StructField(n, T.StringType())
             for n in ("data_documento", "summary", "file_path", "file_name")]
    return T.StructType(lists + plain)


#: Column that takes the text of a record that could not be read.
CORRUPT = "_corrupt_record"


def json_reading_schema() -> T.StructType:
    """The schema of records in files: the text of a broken record comes out beside the fields."""
    return json_schema().add(CORRUPT, T.StringType())


# Attributes of one XML line element, per schedule.
XML_ATTRIBUTES = {
    "bens_direitos": ("grupo", "codigo", "pais", "discriminacao", "valorExercicioAnterior", "valorExercicioAtual"),
    "doacoes_efetuadas": ("codigo", "cnpjProponente", "nomeProponente", "valorPago"),
    "pagamentos_efetuados": ("codigo", "tipo", "cpfBeneficiario", "niBeneficiario", "cpfPrestador", "nomeBeneficiario",
                             "nomePrestador", "descricao", "valorPago", "parcelaNaoDedutivel"),
    "rendimentos_exclusivos": ("tipoBeneficiario", "cpfBeneficiario", "cnpjEmpresa", "nomeFonte", "valor"),
    "rendimentos_isentos": ("tipoBeneficiario", "cpfBeneficiario", "cnpjEmpresa", "nomeFonte", "descricaoRendimento", "valor"),
    "rendimentos_tributaveis_pj": ("NIFontePagadora", "nomeFontePagadora", "cpfBeneficiario", "rendRecebidoPJ",
                                   "contribuicaoPrevOficial", "impostoRetidoFonte", "decimoTerceiro", "IRRFDecimoTerceiro"),
}


def xml_line_schema(name: str) -> T.StructType:
    """All-text struct of one line element; attributes carry a leading underscore."""
    return T.StructType([T.StructField("_" + a, T.StringType())
                         for a in XML_ATTRIBUTES[name]])


# Six tables a fresh installation declares before any data arrives.
_REF = "id INT, declaration_id INT"
_SOURCE = f"{_REF}, nome_fonte_pagadora STRING, cnpj_fonte STRING"
DECLARED_TABLES = {
    "declarations": ("declaration_id INT, file_name STRING, cpf STRING, year INT, "
                     "created_at TIMESTAMP"),
    "rendimentos_tributaveis_pj": f"{_SOURCE}, rendimentos {STORED_MONEY}",
    "rendimentos_exclusivos": f"{_SOURCE}, valor {STORED_MONEY}",
    "rendimentos_isentos": f"{_SOURCE}, valor {STORED_MONEY}",
    "pagamentos_efetuados": (f"{_REF}, codigo STRING, nome_beneficiario STRING, "
                             f"cpf_cnpj_beneficiario STRING, valor_pago {STORED_MONEY}"),
    "bens_direitos": (f"{_REF}, codigo STRING, grupo STRING, descricao STRING, "
                      f"valor_2023 {STORED_MONEY}, valor_2024 {STORED_MONEY}"),
}

CHUNK_SCHEMA = "chunk_id string, doc_id string, chunk_no int, text string, n_tokens int"
COLLECTION_SCHEMA = CHUNK_SCHEMA + ", embedding array<float>"
MANIFEST_SCHEMA = "path string, modified_at timestamp, processed_at timestamp"
PAGE_SCHEMA = "url string, title string, description string, text string"
