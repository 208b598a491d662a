"""Tax tables derived from the given test tables, in Spark and in plain SQL.

Both sides follow one rule per column; whole tables are used throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.schemas import ALL_TABLES, MONEY, table_schema

AS_OF = "2025-05-31"


def given(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def share(c: Column, part: str) -> Column:
    return (c * F.lit(part).cast("decimal(4,2)")).cast(MONEY)


def padded(c: Column | str, width: int) -> Column:
    return F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), width, "0")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    orders = given(spark, sf, "orders").select("o_orderkey", "o_custkey")
    items = given(spark, sf, "lineitem")
    return items.join(orders, items.l_orderkey == orders.o_orderkey)


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("c_name", F.lit(".xml"))
    return given(spark, sf, "customer").select(
        F.col("c_custkey").alias("declaration_id"),
        F.concat(F.lit("/in/"), name).alias("file_path"), name.alias("file_name"),
        F.concat(F.lit("Declaração IRPF-2025 de "), "c_name", F.lit(" (CPF "),
                 padded("c_custkey", 11), F.lit(").")).alias("summary"))


def salary(spark: SparkSession, sf: str) -> DataFrame:
    o = given(spark, sf, "orders").withColumn("v", money("o_totalprice"))
    source = (F.col("o_orderkey") % 500).cast("string")
    return o.select(
        F.col("o_custkey").alias("declaration_id"), padded(source, 14).alias("cpf_cnpj_fonte_pagadora"),
        F.concat(F.lit("Fonte "), source).alias("nome_fonte_pagadora"),
        padded("o_custkey", 11).alias("beneficiario"), padded("o_custkey", 11).alias("cpf_beneficiario"),
        F.col("v").alias("rendimentos"), share(F.col("v"), "0.11").alias("contribuicao_previdenciaria"),
        share(F.col("v"), "0.15").alias("imposto_retido"), share(F.col("v"), "0.08").alias("decimo_terceiro"),
        share(F.col("v"), "0.01").alias("irrf_decimo_terceiro"))


def _other_income(spark: SparkSession, sf: str, flag: str, nameless: Column) -> DataFrame:
    l = _lines(spark, sf).where(F.col("l_returnflag") == flag)
    supplier = F.col("l_suppkey").cast("string")
    return l.select(
        F.col("o_custkey").alias("declaration_id"),
        F.concat(F.lit("rend"), F.col("l_linenumber").cast("string"), F.lit("QuadroAuxiliar")).alias("tipo_rendimento"),
        F.when(F.col("l_linestatus") == "F", "titular").otherwise("dependente").alias("tipo_beneficiario"),
        padded("o_custkey", 11).alias("beneficiario"), padded("o_custkey", 11).alias("cpf_beneficiario"),
        F.when(~nameless, padded("l_suppkey", 14)).alias("cnpj_fonte_pagadora"),
        F.when(~nameless, F.concat(F.lit("Irmãos & Cia <"), supplier, F.lit(">"))).alias("nome_fonte_pagadora"),
        money("l_extendedprice").alias("valor"))


def exclusive(spark: SparkSession, sf: str) -> DataFrame:
    return _other_income(spark, sf, "A", F.lit(False))


def exempt(spark: SparkSession, sf: str) -> DataFrame:
    return _other_income(spark, sf, "R", F.col("l_suppkey") % 10 == 0)


def payments(spark: SparkSession, sf: str) -> DataFrame:
    l = _lines(spark, sf).where(F.col("l_returnflag") == "N")
    supplier = F.col("l_suppkey").cast("string")
    return l.select(
        F.col("o_custkey").alias("declaration_id"), padded("l_linenumber", 2).alias("codigo"),
        F.when(F.col("l_linestatus") == "F", "alimentando").otherwise("titular").alias("pessoa_beneficiada"),
        padded("o_custkey", 11).alias("cpf_beneficiario"),
        F.concat(F.lit("Prestador "), supplier).alias("nome_beneficiario"),
        padded("l_suppkey", 14).alias("cpf_cnpj_prestador"),
        F.concat(F.lit("Prestador "), supplier).alias("nome_prestador"),
        F.lit(None).cast("string").alias("descricao"), money("l_extendedprice").alias("valor_pago"),
        share(money("l_extendedprice"), "0.10").alias("parcela_nao_dedutivel"))


def donations(spark: SparkSession, sf: str) -> DataFrame:
    l = _lines(spark, sf).where((F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "F"))
    return l.select(
        F.col("o_custkey").alias("declaration_id"),
        (40 + F.col("l_suppkey") % 4).cast("string").alias("codigo"),
        padded("l_suppkey", 14).alias("cnpj_proponente"),
        F.concat(F.lit("Projeto "), F.col("l_suppkey").cast("string")).alias("nome_proponente"),
        money("l_extendedprice").alias("valor_pago"))


def assets(spark: SparkSession, sf: str) -> DataFrame:
    p = given(spark, sf, "part")
    v = money("p_retailprice")
    grown = (v * (10 + F.col("p_partkey") % 5).cast("decimal(3,0)") * F.lit("0.1").cast("decimal(2,1)")).cast(MONEY)
    return p.select(
        F.col("p_partkey").alias("declaration_id"), padded(F.col("p_size") % 10, 2).alias("grupo"),
        padded(F.col("p_partkey") % 20, 2).alias("codigo"), F.lit("105").alias("pais"),
        F.col("p_name").alias("discriminacao"),
        F.when(F.col("p_size") % 10 == 0, money(F.lit("0.00"))).otherwise(v).alias("valor_2023"),
        grown.alias("valor_2024"), F.lit(False).alias("repetir_valor"))


_BUILDERS = {
    "declarations": declarations, "bens_direitos": assets, "doacoes_efetuadas": donations,
    "pagamentos_efetuados": payments, "rendimentos_exclusivos": exclusive,
    "rendimentos_isentos": exempt, "rendimentos_tributaveis_pj": salary,
}


def tables(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    """The derived tables, all or some, with the columns of the served schema."""
    out = {}
    for name in names or ALL_TABLES:
        df = _BUILDERS[name](spark, sf)
        out[name] = df.select(*table_schema(name).fieldNames())
    return out


# ------------------------------------------------------------------ the same in SQL

def _pad(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS VARCHAR), {width}, '0')"


def _dec(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(14,2))"


def _share(expr: str, part: str) -> str:
    return f"CAST({_dec(expr)} * CAST({part} AS DECIMAL(4,2)) AS DECIMAL(14,2))"


def _other_income_sql(flag: str, nameless: str) -> str:
    return f"""SELECT o_custkey AS declaration_id,
        'rend' || l_linenumber || 'QuadroAuxiliar' AS tipo_rendimento,
        CASE WHEN l_linestatus = 'F' THEN 'titular' ELSE 'dependente' END AS tipo_beneficiario,
        {_pad('o_custkey', 11)} AS beneficiario, {_pad('o_custkey', 11)} AS cpf_beneficiario,
        CASE WHEN NOT ({nameless}) THEN {_pad('l_suppkey', 14)} END AS cnpj_fonte_pagadora,
        CASE WHEN NOT ({nameless}) THEN 'Irmãos & Cia <' || l_suppkey || '>' END AS nome_fonte_pagadora,
        {_dec('l_extendedprice')} AS valor
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = '{flag}'"""


SQL_TABLES = {
    "declarations": f"""SELECT c_custkey AS declaration_id, '/in/' || c_name || '.xml' AS file_path,
        c_name || '.xml' AS file_name,
        'Declaração IRPF-2025 de ' || c_name || ' (CPF ' || {_pad('c_custkey', 11)} || ').' AS summary
        FROM customer""",
    "rendimentos_tributaveis_pj": f"""SELECT o_custkey AS declaration_id,
        {_pad('o_orderkey % 500', 14)} AS cpf_cnpj_fonte_pagadora,
        'Fonte ' || (o_orderkey % 500) AS nome_fonte_pagadora,
        {_pad('o_custkey', 11)} AS beneficiario, {_pad('o_custkey', 11)} AS cpf_beneficiario,
        {_dec('o_totalprice')} AS rendimentos,
        {_share('o_totalprice', '0.11')} AS contribuicao_previdenciaria,
        {_share('o_totalprice', '0.15')} AS imposto_retido,
        {_share('o_totalprice', '0.08')} AS decimo_terceiro,
        {_share('o_totalprice', '0.01')} AS irrf_decimo_terceiro FROM orders""",
    "rendimentos_exclusivos": _other_income_sql("A", "false"),
    "rendimentos_isentos": _other_income_sql("R", "l_suppkey % 10 = 0"),
    "pagamentos_efetuados": f"""SELECT o_custkey AS declaration_id, {_pad('l_linenumber', 2)} AS codigo,
        CASE WHEN l_linestatus = 'F' THEN 'alimentando' ELSE 'titular' END AS pessoa_beneficiada,
        {_pad('o_custkey', 11)} AS cpf_beneficiario, 'Prestador ' || l_suppkey AS nome_beneficiario,
        {_pad('l_suppkey', 14)} AS cpf_cnpj_prestador, 'Prestador ' || l_suppkey AS nome_prestador,
        CAST(NULL AS VARCHAR) AS descricao, {_dec('l_extendedprice')} AS valor_pago,
        {_share('l_extendedprice', '0.10')} AS parcela_nao_dedutivel
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N'""",
    "doacoes_efetuadas": f"""SELECT o_custkey AS declaration_id,
        CAST(40 + l_suppkey % 4 AS VARCHAR) AS codigo, {_pad('l_suppkey', 14)} AS cnpj_proponente,
        'Projeto ' || l_suppkey AS nome_proponente, {_dec('l_extendedprice')} AS valor_pago
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_linenumber = 1 AND l_linestatus = 'F'""",
    "bens_direitos": f"""SELECT p_partkey AS declaration_id, {_pad('p_size % 10', 2)} AS grupo,
        {_pad('p_partkey % 20', 2)} AS codigo, '105' AS pais, p_name AS discriminacao,
        CASE WHEN p_size % 10 = 0 THEN {_dec('0')} ELSE {_dec('p_retailprice')} END AS valor_2023,
        CAST({_dec('p_retailprice')} * CAST(10 + p_partkey % 5 AS DECIMAL(3,0))
             * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(14,2)) AS valor_2024,
        false AS repetir_valor FROM part""",
}


def sql_with(*names: str) -> str:
    """A WITH clause that defines the derived tables."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL_TABLES[n]})" for n in names) + "\n"
