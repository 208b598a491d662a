from decimal import Decimal

import pytest

from fiscolake.plans import analytics, catalog
from fiscolake.schemas import INCOME_TABLES, empty_table, table_schema


def make(spark, name, rows):
    """Rows given as dicts; columns not named are null."""
    schema = table_schema(name)
    return spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in rows], schema)


@pytest.fixture(scope="module")
def tables(spark):
    d = Decimal
    return {
        "declarations": make(spark, "declarations", [{"declaration_id": "1", "file_name": "a.xml"}]),
        "rendimentos_tributaveis_pj": make(spark, "rendimentos_tributaveis_pj", [
            {"declaration_id": "1", "nome_fonte_pagadora": "F", "rendimentos": d(5)},
            {"declaration_id": "2", "nome_fonte_pagadora": "G", "rendimentos": d(9)}]),
        "rendimentos_exclusivos": make(spark, "rendimentos_exclusivos", [
            {"declaration_id": "1", "nome_fonte_pagadora": None, "valor": d(7)}]),
        "rendimentos_isentos": make(spark, "rendimentos_isentos", [
            {"declaration_id": "1", "nome_fonte_pagadora": None, "valor": d(8)},
            {"declaration_id": "1", "nome_fonte_pagadora": "F", "valor": d(1)},
            {"declaration_id": "1", "nome_fonte_pagadora": "F", "valor": None}]),
        "pagamentos_efetuados": make(spark, "pagamentos_efetuados", [
            {"codigo": "01", "valor_pago": d(1)}, {"codigo": "02", "valor_pago": d(3)},
            {"codigo": "01", "valor_pago": d("1.5")}]),
        "bens_direitos": make(spark, "bens_direitos", [
            {"grupo": "01", "valor_2023": d(0), "valor_2024": d(4)},
            {"grupo": "02", "valor_2023": d(10), "valor_2024": d(15)},
            {"grupo": "02", "valor_2023": d(10), "valor_2024": d(10)}]),
    }


def values(df):
    return [tuple(r) for r in df.collect()]


def test_analyses(tables):
    d = Decimal
    assert values(analytics.salary_income(tables)) == [("a.xml", "F", d(5))]
    assert values(analytics.payments_by_category(tables)) == [("02", d(3)), ("01", d("2.5"))]
    assert analytics.payments_by_category(tables, "total_pago").columns == ["codigo", "total_pago"]
    assert values(analytics.asset_statistics(tables)) == [
        ("02", 2, d(25), d("12.5"), d(10), d(15)), ("01", 1, d(4), d(4), d(4), d(4))]
    assert values(analytics.asset_change(tables)) == [
        ("02", 2, d(20), d(25), d(5), 25.0), ("01", 1, d(0), d(4), d(4), None)]


def test_income(tables):
    d = Decimal
    assert values(analytics.income_sources(tables)) == [
        ("Tributável PJ", "G", d(9)), ("Exclusivo", None, d(7)), ("Tributável PJ", "F", d(5)),
        ("Isento", "F", d(1)), ("Isento", "F", None)]
    assert values(analytics.income_by_source(tables)) == [
        ("G", "Tributável", d(9)), (None, "Isento", d(8)), (None, "Exclusivo", d(7)),
        ("F", "Tributável", d(5)), ("F", "Isento", d(1))]


def test_empty_tables_give_empty_results(spark):
    tables = {n: empty_table(spark, n) for n in ("declarations", "bens_direitos", "pagamentos_efetuados", *INCOME_TABLES)}
    for name, analysis in analytics.ANALYSES.items():
        assert analysis(tables).count() == 0, name


def test_guard(spark, tables):
    for name in INCOME_TABLES:
        spark.catalog.dropTempView(name)
    assert values(analytics.income_sources_from_catalog(spark)) == [(analytics.NO_INCOME_MESSAGE,)]
    analytics.register_views({n: tables[n] for n in INCOME_TABLES[:1]})
    assert len(values(analytics.income_sources_from_catalog(spark))) == 2
    analytics.register_views({n: tables[n] for n in INCOME_TABLES})
    assert len(values(analytics.income_sources_from_catalog(spark))) == 5


def test_free_sql(spark, tables):
    analytics.register_views({"pagamentos_efetuados": tables["pagamentos_efetuados"]})
    assert analytics.query(spark, " select count(*) AS n from pagamentos_efetuados").first().n == 3
    ordered = analytics.query(spark, "SELECT valor_pago AS v FROM pagamentos_efetuados ORDER BY v DESC; ")
    assert [r.v for r in ordered.collect()] == [Decimal("3.00"), Decimal("1.50"), Decimal("1.00")]
    assert "Sort" in ordered._jdf.queryExecution().optimizedPlan().toString()
    spark.sql("CREATE TABLE IF NOT EXISTS guarded (a INT) USING parquet")
    writing = ("WITH x AS (SELECT 1 AS a) INSERT INTO guarded SELECT a FROM x", "INSERT INTO guarded VALUES (1)",
               "SELECT 1 AS a); DROP TABLE guarded; SELECT * FROM (SELECT 1")
    for bad in ("SELECT * FROM no_such_table", "DROP TABLE guarded", "SELEC 1", "", *writing):
        assert analytics.query(spark, bad, on_error="empty").count() == 0
        with pytest.raises(Exception):
            analytics.query(spark, bad)
    assert spark.table("guarded").count() == 0


def test_table_report(spark, tables):
    analytics.register_views({"cheia": tables["pagamentos_efetuados"], "vazia": empty_table(spark, "bens_direitos")})
    report = {r.table_name: r for r in catalog.table_report(spark, ("cheia", "vazia", "nenhuma")).collect()}
    assert (report["cheia"].n_rows, report["cheia"].status, len(report["cheia"].sample)) == (3, "filled", 3)
    assert (report["vazia"].n_rows, report["vazia"].status, report["vazia"].sample) == (0, "empty", [])
    assert (report["nenhuma"].table_exists, report["nenhuma"].n_rows) == (False, None)
    assert "cheia" in {r.table_name for r in catalog.list_tables(spark).collect()}
    assert [r.table_exists for r in catalog.existing(spark, ("cheia", "nenhuma")).collect()] == [True, False]
