"""The ready-made analyses over the served tables."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.functions.scalars import percent_change
from fiscolake.schemas import INCOME_TABLES, empty_table

logger = logging.getLogger(__name__)
Tables = Mapping[str, DataFrame]

# Labels of the kinds of income, and the message without any table.
SALARY_LABEL = "Tributável PJ"
SALARY_LABEL_GROUPED = "Tributável"
EXCLUSIVE_LABEL = "Exclusivo"
EXEMPT_LABEL = "Isento"
NO_INCOME_MESSAGE = "Nenhuma tabela de receitas encontrada no banco de dados"


def _descending(df: DataFrame, measure: str, *spread: str) -> DataFrame:
    """Sort by the measure. The further columns fix the order of equal values,
    and let range partitioning split a value that many rows share."""
    return df.orderBy(F.desc(measure), *spread)


def salary_income(tables: Tables) -> DataFrame:
    """Salary lines with the file they came from, largest first."""
    lines = tables["rendimentos_tributaveis_pj"].select(
        "declaration_id", "nome_fonte_pagadora", "rendimentos")
    files = tables["declarations"].select("declaration_id", "file_name")
    joined = lines.join(files, "declaration_id", "inner")
    ordered = _descending(joined, "rendimentos", "nome_fonte_pagadora", "declaration_id")
    return ordered.select("file_name", "nome_fonte_pagadora", "rendimentos")


def payments_by_category(tables: Tables, total: str = "total_value") -> DataFrame:
    """Payments summed per code, largest first."""
    sums = tables["pagamentos_efetuados"].groupBy("codigo").agg(F.sum("valor_pago").alias(total))
    return _descending(sums, total, "codigo")


def asset_statistics(tables: Tables) -> DataFrame:
    """Assets per group: count, sum, mean, least and greatest value."""
    v = "valor_2024"
    stats = tables["bens_direitos"].groupBy("grupo").agg(
        F.count("*").alias("count"), F.sum(v).alias("total_value_2024"),
        F.avg(v).alias("avg_value_2024"), F.min(v).alias("min_value_2024"),
        F.max(v).alias("max_value_2024"))
    return _descending(stats, "total_value_2024", "grupo")


def asset_change(tables: Tables) -> DataFrame:
    """Assets per group: both years, difference and percent change."""
    stats = tables["bens_direitos"].groupBy("grupo").agg(
        F.count("*").alias("num_assets"), F.sum("valor_2023").alias("total_2023"),
        F.sum("valor_2024").alias("total_2024"),
        F.sum(F.col("valor_2024") - F.col("valor_2023")).alias("value_change"))
    stats = stats.withColumn("percent_change",
                             percent_change(F.col("total_2023"), F.col("total_2024")))
    return _descending(stats, "total_2024", "grupo")


def _income_rows(tables: Tables, salary_label: str, drop_null_source: bool) -> DataFrame:
    def branch(table: str, label: str, measure: str) -> DataFrame:
        rows = tables[table]
        if drop_null_source and label == EXEMPT_LABEL:
            rows = rows.where(F.col("nome_fonte_pagadora").isNotNull())
        return rows.select(F.lit(label).alias("tipo"), F.col("nome_fonte_pagadora").alias("fonte"),
                           F.col(measure).alias("valor"), "declaration_id")

    return (branch("rendimentos_tributaveis_pj", salary_label, "rendimentos")
            .unionByName(branch("rendimentos_exclusivos", EXCLUSIVE_LABEL, "valor"))
            .unionByName(branch("rendimentos_isentos", EXEMPT_LABEL, "valor")))


def income_sources(tables: Tables) -> DataFrame:
    """Every income line of the three kinds with kind and source, largest first."""
    rows = _income_rows(tables, SALARY_LABEL, drop_null_source=True)
    return _descending(rows, "valor", "tipo", "fonte", "declaration_id").select("tipo", "fonte", "valor")


def income_by_source(tables: Tables) -> DataFrame:
    """Income summed per source and kind; lines without a source form a group."""
    rows = _income_rows(tables, SALARY_LABEL_GROUPED, drop_null_source=False)
    sums = (rows.groupBy(F.col("fonte").alias("nome_fonte_pagadora"),
                         F.col("tipo").alias("tipo_rendimento"))
            .agg(F.sum("valor").alias("total_valor")))
    return _descending(sums, "total_valor", "nome_fonte_pagadora", "tipo_rendimento")


def income_sources_from_catalog(spark: SparkSession) -> DataFrame:
    """The same list over the catalog's tables. Without any of the three income
    tables it is one row with a message; a single missing one counts as empty."""
    present = [t for t in INCOME_TABLES if spark.catalog.tableExists(t)]
    if not present:
        return spark.createDataFrame([(NO_INCOME_MESSAGE,)], "mensagem string")
    key_type = spark.table(present[0]).schema["declaration_id"].dataType
    return income_sources({t: spark.table(t) if t in present else empty_table(spark, t, key_type)
                           for t in INCOME_TABLES})


def register_views(tables: Tables) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, text: str, on_error: str = "raise") -> DataFrame:
    """Run a reading statement over the catalog's tables and views.

    The text is used as a subquery, where the grammar admits nothing that
    writes. ``on_error="empty"`` logs a failing statement and gives a frame without
    rows. Analysis errors show at once; run-time errors show when the caller
    acts on the result.
    """
    try:
        return spark.sql(f"SELECT * FROM (\n{text.rstrip().rstrip(';')}\n)")
    except Exception as error:
        if on_error != "empty":
            raise
        logger.error("query failed: %s", error)
        return spark.createDataFrame([], "result string")


ANALYSES: dict[str, Callable[[Tables], DataFrame]] = {
    "salary_income": salary_income,
    "payments_by_category": payments_by_category,
    "asset_statistics": asset_statistics,
    "asset_change": asset_change,
    "income_sources": income_sources,
    "income_by_source": income_by_source,
}
