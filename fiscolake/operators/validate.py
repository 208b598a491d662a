"""Row checks of the tax model: rule list, rejects, keys."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscolake.operators.lines import MONEY_COLUMNS

REJECT_SCHEMA = "declaration_id string, table_name string, column_name string, rule string, raw_value string"

_REQUIRED_TEXT = {
    "bens_direitos": ("grupo", "codigo", "discriminacao"),
    "doacoes_efetuadas": ("codigo",),
    "pagamentos_efetuados": ("codigo", "cpf_beneficiario"),
    "rendimentos_exclusivos": ("tipo_rendimento", "cpf_beneficiario", "cnpj_fonte_pagadora",
                               "nome_fonte_pagadora"),
    "rendimentos_isentos": ("tipo_rendimento", "cpf_beneficiario"),
    "rendimentos_tributaveis_pj": ("cpf_cnpj_fonte_pagadora", "nome_fonte_pagadora",
                                   "cpf_beneficiario"),
}
_WITH_CPF = ("pagamentos_efetuados", "rendimentos_exclusivos", "rendimentos_isentos",
             "rendimentos_tributaveis_pj")


@dataclass(frozen=True)
class Rule:
    column: str
    name: str
    broken: Column


def rules(table: str, raw: Mapping[str, Column]) -> list[Rule]:
    """Checks of one schedule; ``raw`` gives the text a money column came from."""
    out = []
    for name in MONEY_COLUMNS[table]:
        given = raw[name].isNotNull() if name in raw else F.lit(False)
        out.append(Rule(name, "money", F.col(name).isNull() & given))
        out.append(Rule(name, "required", F.col(name).isNull() & ~given))
    out += [Rule(c, "required", F.col(c).isNull()) for c in _REQUIRED_TEXT[table]]
    if table in _WITH_CPF:
        out.append(Rule("cpf_beneficiario", "length",
                        ~F.length("cpf_beneficiario").between(11, 14)))
    return out


def _raw_texts(lines: DataFrame) -> dict[str, Column]:
    if "_raw" not in lines.columns:
        return {}
    return {n: F.col("_raw")[n] for n in lines.schema["_raw"].dataType.fieldNames()}


def flag_lines(table: str, lines: DataFrame) -> DataFrame:
    """Add ``errors``, one struct per broken rule. ``lines`` may hold a struct
    ``_raw`` with the text of the checked columns."""
    raw = _raw_texts(lines)
    found = [F.when(r.broken, F.struct(
        F.lit(r.column).alias("column_name"), F.lit(r.name).alias("rule"),
        raw.get(r.column, F.lit(None)).cast("string").alias("raw_value")))
        for r in rules(table, raw)]
    return lines.withColumn("errors", F.array_compact(F.array(*found)))


def split_lines(table: str, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that pass every rule, and one row per broken rule of the others. What is wrong is only put down
    for lines that break one."""
    broken = reduce(lambda a, b: a | b, [F.coalesce(r.broken, F.lit(False)) for r in rules(table, _raw_texts(lines))])
    valid = lines.where(~broken).drop("_raw")
    rejects = (flag_lines(table, lines.where(broken))
               .select("declaration_id", F.lit(table).alias("table_name"), F.inline("errors")))
    return valid, rejects


def split_declarations(declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns with a summary text, and rejects for those without."""
    bad = F.coalesce(F.length("summary"), F.lit(0)) < 1
    rejects = declarations.where(bad).select(
        "declaration_id", F.lit("declarations").alias("table_name"),
        F.lit("summary").alias("column_name"), F.lit("not_empty").alias("rule"),
        F.col("summary").alias("raw_value"))
    return declarations.where(~bad), rejects


def without_rejected(declarations: DataFrame, rejects: DataFrame) -> DataFrame:
    """Only the returns none of whose lines were rejected: the strict reading,
    in which one bad field refuses the whole return. ``rejects`` is joined as it
    is: behind an aggregate, adaptive execution could not split a large return."""
    return declarations.join(rejects.select("declaration_id"), "declaration_id", "left_anti")


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Primary-key check: key values that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def orphan_keys(lines: DataFrame, parents: DataFrame, key: str = "declaration_id") -> DataFrame:
    """Foreign-key check: key values without a parent, and how many lines they have.

    Lines are counted per key before the join, so a key that holds a large
    share of the lines reaches the join as one row.
    """
    counted = lines.groupBy(key).agg(F.count("*").alias("n_rows"))
    return counted.join(parents.select(key), key, "left_anti")


def orphan_lines(lines: DataFrame, parents: DataFrame, key: str = "declaration_id") -> DataFrame:
    return lines.join(parents.select(key), key, "left_anti")
