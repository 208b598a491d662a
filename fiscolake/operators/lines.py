"""Schedule lines: from raw text attributes to typed columns.

Each builder takes ``get``, which returns the raw text column of an attribute,
so that one definition serves flat rows as well as structs inside arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiscolake.functions import scalars as S
from fiscolake.schemas import JSON_ALIASES, MONEY, SCHEDULES

Getter = Callable[[str], Column]

MONEY_COLUMNS = {name: [f.name for f in line.fields if f.dataType == MONEY]
                 for name, line in SCHEDULES.items()}


def _zero_id(c: Column) -> Column:
    return F.coalesce(S.not_blank(c), F.lit(S.ZERO_ID))


def _xml_asset(get: Getter) -> dict[str, Column]:
    return {
        "grupo": S.pad_code(S.or_default(get("grupo"), "00")),
        "codigo": S.pad_code(S.or_default(get("codigo"), "00")),
        "pais": F.coalesce(get("pais"), F.lit("105")),
        "discriminacao": F.coalesce(S.strip(get("discriminacao")), F.lit("")),
        "valor_2023": S.parse_money(get("valorExercicioAnterior")),
        "valor_2024": S.parse_money(get("valorExercicioAtual")),
        "repetir_valor": F.lit(False),
    }


def _xml_donation(get: Getter) -> dict[str, Column]:
    return {
        "codigo": F.coalesce(get("codigo"), F.lit("")),
        "cnpj_proponente": get("cnpjProponente"),
        "nome_proponente": get("nomeProponente"),
        "valor_pago": S.parse_money(get("valorPago")),
    }


def _xml_payment(get: Getter) -> dict[str, Column]:
    beneficiary = S.first_nonempty(get("cpfBeneficiario"), get("niBeneficiario"),
                                   get("cpfPrestador"), default=S.ZERO_ID)
    return {
        "codigo": S.pad_code(F.coalesce(get("codigo"), F.lit(""))),
        "pessoa_beneficiada": S.beneficiary_label(get("tipo")),
        "cpf_beneficiario": S.only_digits(beneficiary),
        "nome_beneficiario": S.first_nonempty(get("nomeBeneficiario")),
        "cpf_cnpj_prestador": S.only_digits(
            S.first_nonempty(get("niBeneficiario"), get("cpfPrestador"))),
        "nome_prestador": S.first_nonempty(get("nomeBeneficiario"), get("nomePrestador")),
        "descricao": S.not_blank(get("descricao")),
        "valor_pago": S.parse_money(get("valorPago")),
        "parcela_nao_dedutivel": S.parse_money(get("parcelaNaoDedutivel")),
    }


def _xml_other_income(get: Getter, payer: Column) -> dict[str, Column]:
    return {
        "tipo_rendimento": get("kind"),
        "tipo_beneficiario": S.beneficiary_label(get("tipoBeneficiario")),
        "beneficiario": get("cpfBeneficiario"),
        "cpf_beneficiario": S.only_digits(_zero_id(get("cpfBeneficiario"))),
        "cnpj_fonte_pagadora": S.only_digits(get("cnpjEmpresa")),
        "nome_fonte_pagadora": payer,
        "valor": S.parse_money(get("valor")),
    }


def _xml_exclusive(get: Getter) -> dict[str, Column]:
    return _xml_other_income(get, get("nomeFonte"))


def _xml_exempt(get: Getter) -> dict[str, Column]:
    return _xml_other_income(
        get, S.first_nonempty(get("nomeFonte"), get("descricaoRendimento")))


def _xml_salary(get: Getter) -> dict[str, Column]:
    return {
        "cpf_cnpj_fonte_pagadora": S.only_digits(get("NIFontePagadora")),
        "nome_fonte_pagadora": get("nomeFontePagadora"),
        "beneficiario": get("cpfBeneficiario"),
        "cpf_beneficiario": _zero_id(get("cpfBeneficiario")),
        "rendimentos": S.parse_money(get("rendRecebidoPJ")),
        "contribuicao_previdenciaria": S.parse_money(get("contribuicaoPrevOficial")),
        "imposto_retido": S.parse_money(get("impostoRetidoFonte")),
        "decimo_terceiro": S.parse_money(get("decimoTerceiro")),
        "irrf_decimo_terceiro": S.parse_money(get("IRRFDecimoTerceiro")),
    }


_FROM_XML = {
    "bens_direitos": _xml_asset,
    "doacoes_efetuadas": _xml_donation,
    "pagamentos_efetuados": _xml_payment,
    "rendimentos_exclusivos": _xml_exclusive,
    "rendimentos_isentos": _xml_exempt,
    "rendimentos_tributaveis_pj": _xml_salary,
}

# Where the raw text of a checked column comes from in XML: the first attribute
# that is not empty.
XML_RAW = {
    "bens_direitos": {"valor_2023": "valorExercicioAnterior", "valor_2024": "valorExercicioAtual"},
    "doacoes_efetuadas": {"codigo": "codigo", "valor_pago": "valorPago"},
    "pagamentos_efetuados": {"codigo": "codigo", "valor_pago": "valorPago",
                             "cpf_beneficiario": "cpfBeneficiario niBeneficiario cpfPrestador",
                             "parcela_nao_dedutivel": "parcelaNaoDedutivel"},
    "rendimentos_exclusivos": {"cpf_beneficiario": "cpfBeneficiario",
                               "cnpj_fonte_pagadora": "cnpjEmpresa",
                               "nome_fonte_pagadora": "nomeFonte", "valor": "valor"},
    "rendimentos_isentos": {"cpf_beneficiario": "cpfBeneficiario", "valor": "valor"},
    "rendimentos_tributaveis_pj": {
        "cpf_cnpj_fonte_pagadora": "NIFontePagadora", "nome_fonte_pagadora": "nomeFontePagadora",
        "cpf_beneficiario": "cpfBeneficiario", "rendimentos": "rendRecebidoPJ",
        "contribuicao_previdenciaria": "contribuicaoPrevOficial",
        "imposto_retido": "impostoRetidoFonte", "decimo_terceiro": "decimoTerceiro",
        "irrf_decimo_terceiro": "IRRFDecimoTerceiro"},
}

# Columns cut down to digits when a return arrives as JSON.
_DIGIT_COLUMNS = {
    "pagamentos_efetuados": ("cpf_beneficiario", "cpf_cnpj_prestador"),
    "rendimentos_exclusivos": ("cpf_beneficiario", "cnpj_fonte_pagadora"),
    "rendimentos_isentos": ("cpf_beneficiario", "cnpj_fonte_pagadora"),
    "rendimentos_tributaveis_pj": ("cpf_cnpj_fonte_pagadora",),
}
_JSON_DEFAULTS = {
    "bens_direitos": {"pais": "105"},
    "pagamentos_efetuados": {"parcela_nao_dedutivel": "0.00"},
    "rendimentos_tributaveis_pj": dict.fromkeys(
        ("contribuicao_previdenciaria", "imposto_retido", "decimo_terceiro",
         "irrf_decimo_terceiro"), "0.00"),
}


def from_xml(table: str, get: Getter) -> dict[str, Column]:
    """Typed columns of one line given by XML attributes."""
    return _FROM_XML[table](get)


def json_raw(table: str, column: str, get: Getter) -> Column:
    """Raw text of a JSON field under its own name or its alias."""
    alias = JSON_ALIASES.get(table, {}).get(column)
    return F.coalesce(get(column), get(alias)) if alias else get(column)


def from_json(table: str, get: Getter) -> dict[str, Column]:
    """Typed columns of one line given by JSON fields."""
    out: dict[str, Column] = {}
    defaults = _JSON_DEFAULTS.get(table, {})
    for field in SCHEDULES[table].fields:
        raw = json_raw(table, field.name, get)
        if field.name in defaults:
            raw = F.coalesce(raw, F.lit(defaults[field.name]))
        if field.dataType == MONEY:
            out[field.name] = S.plain_money(raw)
        elif field.name == "repetir_valor":
            out[field.name] = F.coalesce(raw.try_cast("boolean"), F.lit(False))
        elif field.name in _DIGIT_COLUMNS.get(table, ()):
            out[field.name] = S.only_digits(raw)
        else:
            out[field.name] = raw
    if table == "bens_direitos":
        out["valor_2024"] = S.copy_forward(out["repetir_valor"], out["valor_2023"], out["valor_2024"])
    return out
