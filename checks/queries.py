"""Registered queries: every operator over whole given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import bridge, render
from checks.bridge import AS_OF, given, money
from fiscolake.functions import scalars as S
from fiscolake.functions import urls as U
from fiscolake.functions.merges import read_ranks
from fiscolake.functions.stems import english_stems
from fiscolake.operators import crawl, incremental, retrieve, shred, validate
from fiscolake.operators.cells import build_cells
from fiscolake.operators.chunk import chunk_sentences, chunk_tokens, chunk_words
from fiscolake.operators.embed import embed
from fiscolake.operators.postings import posting_blocks
from fiscolake.plans import analytics, catalog, documents
from fiscolake.plans.knowledge import build_knowledge_base, collection_rows
from fiscolake.plans.web import crawl_to_json
from fiscolake.schemas import INCOME_TABLES, SCHEDULES, xml_line_schema
from fiscolake.session import shared_path, written_table
from fiscolake.sources import readers, writers
from fiscolake.sources.filesystem import move_file
from fiscolake.sources.xml import parse_xml_column, read_xml_returns
from fiscolake.streaming import arrivals

Spark = SparkSession

#: A vocabulary of ranked merges, outside the repository.
VOCABULARY = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as floating point, so that both engines give one type."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if f.dataType.typeName() == "decimal" else F.col(f.name)
                       for f in df.schema.fields])


# ---------------------------------------------------------------- analyses

def income_sources(spark: Spark, sf: str) -> DataFrame:
    return plain(analytics.income_sources(bridge.tables(spark, sf, *INCOME_TABLES)))


def income_sources_grouped(spark: Spark, sf: str) -> DataFrame:
    return plain(analytics.income_by_source(bridge.tables(spark, sf, *INCOME_TABLES)))


def income_sources_guard(spark: Spark, sf: str) -> DataFrame:
    analytics.register_views(bridge.tables(spark, sf, *INCOME_TABLES))
    return plain(analytics.income_sources_from_catalog(spark))


def salary_income(spark: Spark, sf: str) -> DataFrame:
    return plain(analytics.salary_income(
        bridge.tables(spark, sf, "declarations", "rendimentos_tributaveis_pj")))


def payments_by_category(spark: Spark, sf: str) -> DataFrame:
    return plain(analytics.payments_by_category(bridge.tables(spark, sf, "pagamentos_efetuados")))


def payments_by_category_alt(spark: Spark, sf: str) -> DataFrame:
    return plain(analytics.payments_by_category(
        bridge.tables(spark, sf, "pagamentos_efetuados"), total="total_pago"))


def asset_stats(spark: Spark, sf: str) -> DataFrame:
    stats = analytics.asset_statistics(bridge.tables(spark, sf, "bens_direitos"))
    return plain(stats.withColumn("avg_value_2024", F.round("avg_value_2024", 4)))


def asset_change(spark: Spark, sf: str) -> DataFrame:
    change = analytics.asset_change(bridge.tables(spark, sf, "bens_direitos"))
    return plain(change.withColumn("percent_change", F.round("percent_change", 4)))


FREE_SQL = """
WITH paid AS (
    SELECT declaration_id, codigo, SUM(valor_pago) AS total FROM pagamentos_efetuados
    GROUP BY declaration_id, codigo)
SELECT d.file_name, p.codigo, CAST(p.total AS DOUBLE) AS total
FROM paid p JOIN declarations d ON d.declaration_id = p.declaration_id
ORDER BY total DESC, d.file_name, p.codigo
"""


def free_sql(spark: Spark, sf: str) -> DataFrame:
    analytics.register_views(bridge.tables(spark, sf, "declarations", "pagamentos_efetuados"))
    return analytics.query(spark, FREE_SQL)


def table_report(spark: Spark, sf: str) -> DataFrame:
    analytics.register_views(bridge.tables(spark, sf, *INCOME_TABLES))
    report = catalog.table_report(spark, (*INCOME_TABLES, "tabela_inexistente"))
    keys = F.transform("sample", lambda s: F.get_json_object(s, "$.declaration_id").cast("long"))
    return report.select("table_name", "table_exists", "n_rows", "status",
                         F.array_join(F.sort_array(keys), ",").alias("sample_keys"))


# ---------------------------------------------------------------- scalar functions

def parse_money(spark: Spark, sf: str) -> DataFrame:
    key = F.col("l_orderkey")
    price = render.br_money(money("l_extendedprice"))
    raw = (F.when(key % 11 == 0, F.concat(price, F.lit("7"))).when(key % 13 == 0, F.concat(F.lit("R$"), price))
           .when(key % 17 == 0, "").when(key % 19 == 0, None).when(key % 23 == 0, F.concat(F.lit(" -"), price))
           .otherwise(price))
    return plain(given(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
                 .withColumn("value", S.parse_money(F.col("raw"))))


def only_digits(spark: Spark, sf: str) -> DataFrame:
    cpf = F.regexp_replace(bridge.padded("c_custkey", 11), "^(...)(...)(...)(..)$", "$1.$2.$3-$4")
    return given(spark, sf, "customer").select("c_custkey", S.only_digits(cpf).alias("cpf"),
                                               S.only_digits(F.col("c_name")).alias("name_digits"))


def pad_code(spark: Spark, sf: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 9 == 0, "").otherwise((F.col("p_partkey") % 120).cast("string"))
    return given(spark, sf, "part").select("p_partkey", S.pad_code(raw).alias("codigo"))


def first_nonempty(spark: Spark, sf: str) -> DataFrame:
    a = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag"))
    b = F.when(F.col("l_suppkey") % 2 == 0, F.lit(None)).otherwise(F.col("l_linestatus"))
    return given(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.first_nonempty(a, b, default="00000000000").alias("chosen"))


def flag_label(spark: Spark, sf: str) -> DataFrame:
    flag = F.element_at(F.array(*[F.lit(x) for x in ("T", "d", "A", "v", "", "X")]).cast("array<string>"),
                        (F.col("l_suppkey") % 6 + 1).cast("int"))
    given_flag = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(flag)
    return given(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", S.beneficiary_label(given_flag).alias("label"))


def doc_date(spark: Spark, sf: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-M-d")
    key = F.col("o_orderkey")
    text = (F.when(key % 7 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
            .when(key % 11 == 0, "2024-13-01").when(key % 13 == 0, None).otherwise(day))
    return given(spark, sf, "orders").select(
        "o_orderkey", S.document_date(text, F.lit(AS_OF).cast("date")).alias("data_documento"))


def summary_sentence(spark: Spark, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    sentence = S.summary_sentence(F.when(key % 5 != 0, F.col("c_name")),
                                  F.when(key % 7 != 0, bridge.padded("c_custkey", 11)))
    wrapped = (F.when(key % 2 == 0, F.to_json(F.struct(sentence.alias("text"))))
               .otherwise(sentence))
    return given(spark, sf, "customer").select("c_custkey", S.summary_text(wrapped).alias("summary"))


def copy_forward(spark: Spark, sf: str) -> DataFrame:
    key = F.col("declaration_id")
    current = (F.when(key % 4 == 0, money(F.lit("0"))).when(key % 4 == 1, F.lit(None).cast("decimal(14,2)"))
               .otherwise(F.col("valor_2024")))
    return plain(bridge.tables(spark, sf, "bens_direitos")["bens_direitos"].select(
        "declaration_id", S.copy_forward(key % 3 == 0, F.col("valor_2023"), current).alias("valor_2024")))


def local_names(spark: Spark, sf: str) -> DataFrame:
    tag = (F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("{http://x.example/ns}"), "p_brand"))
           .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("rf:"), "p_brand")).otherwise(F.col("p_brand")))
    return given(spark, sf, "part").select("p_partkey", S.local_name(tag).alias("tag"))


# ---------------------------------------------------------------- checks

def _raw_lines(df: DataFrame, table: str, **attributes: Column) -> DataFrame:
    """One raw line per row, attributes not named left out."""
    fields = [attributes.get(f.name[1:], F.lit(None)).cast("string").alias(f.name)
              for f in xml_line_schema(table).fields]
    kind = attributes.get("kind", F.lit("k")).alias("_kind")
    return df.select("declaration_id", F.array(F.struct(kind, *fields)).alias(table))


def validate_rejects(spark: Spark, sf: str) -> DataFrame:
    t = bridge.tables(spark, sf, "declarations", "pagamentos_efetuados", "rendimentos_exclusivos",
                      "rendimentos_tributaveis_pj")
    paid = render.br_money(F.col("valor_pago"))
    pays = _raw_lines(
        t["pagamentos_efetuados"], "pagamentos_efetuados", codigo=F.col("codigo"),
        cpfBeneficiario=F.when(F.col("declaration_id") % 9 == 0, F.substring("cpf_beneficiario", 1, 5))
        .otherwise(F.col("cpf_beneficiario")),
        valorPago=F.when(F.col("cpf_cnpj_prestador").cast("long") % 7 == 0, F.concat(paid, F.lit("5")))
        .otherwise(paid))
    exclusive = _raw_lines(
        t["rendimentos_exclusivos"], "rendimentos_exclusivos", kind=F.col("tipo_rendimento"),
        cpfBeneficiario=F.col("cpf_beneficiario"), nomeFonte=F.col("nome_fonte_pagadora"),
        cnpjEmpresa=F.when(F.col("cnpj_fonte_pagadora").cast("long") % 5 != 0, F.col("cnpj_fonte_pagadora")),
        valor=render.br_money(F.col("valor")))
    number = F.col("cpf_cnpj_fonte_pagadora").cast("long")
    salary = _raw_lines(
        t["rendimentos_tributaveis_pj"], "rendimentos_tributaveis_pj",
        NIFontePagadora=F.col("cpf_cnpj_fonte_pagadora"),
        nomeFontePagadora=F.when(number % 8 != 0, F.col("nome_fonte_pagadora")),
        cpfBeneficiario=F.col("cpf_beneficiario"),
        rendRecebidoPJ=F.when(number % 25 == 0, "abc").otherwise(render.br_money(F.col("rendimentos"))))
    rejects = [validate.split_lines(n, shred.schedule_lines(df, n, "xml", with_raw=True))[1]
               for n, df in (("pagamentos_efetuados", pays), ("rendimentos_exclusivos", exclusive),
                             ("rendimentos_tributaveis_pj", salary))]
    blank = t["declarations"].withColumn(
        "summary", F.when(F.col("declaration_id") % 6 == 0, "").otherwise(F.col("summary")))
    rejects.append(validate.split_declarations(blank)[1])
    return reduce(DataFrame.unionByName, rejects)


def pk_duplicates(spark: Spark, sf: str) -> DataFrame:
    return validate.duplicate_keys(given(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


def fk_orphans(spark: Spark, sf: str) -> DataFrame:
    t = bridge.tables(spark, sf)
    found = [validate.orphan_keys(t[n], t["declarations"]).withColumn("table_name", F.lit(n))
             for n in SCHEDULES]
    return reduce(DataFrame.unionByName, found)


# ---------------------------------------------------------------- XML and JSON

def _doc_date() -> Column:
    return F.date_add(F.lit("2025-01-01").cast("date"), (F.col("declaration_id") % 100).cast("int"))


def _one_section(spark: Spark, sf: str, table: str) -> DataFrame:
    t = bridge.tables(spark, sf, "declarations", table)
    if table == "bens_direitos":
        t["declarations"] = t["declarations"].join(
            t[table].select("declaration_id").distinct(), "declaration_id", "left_semi")
    return render.xml_returns(render.nested(t, date=_doc_date()), table)


def _xml_in_column(table: str):
    def query(spark: Spark, sf: str) -> DataFrame:
        texts, layout = render.xml_texts(_one_section(spark, sf, table))
        returns = parse_xml_column(texts, "xml", as_of=AS_OF, layout=layout)
        return plain(shred.schedule_lines(returns, table, "xml"))
    return query


def _written_xml(spark: Spark, documents: DataFrame) -> DataFrame:
    path = shared_path(spark, "xml")
    render.write_xml(documents, path)
    return read_xml_returns(spark, path, as_of=AS_OF, key=F.col("cpf").cast("long"))


def _xml_in_files(table: str):
    def query(spark: Spark, sf: str) -> DataFrame:
        returns = _written_xml(spark, _one_section(spark, sf, table))
        return plain(shred.schedule_lines(returns, table, "xml"))
    return query


def xml_returns(spark: Spark, sf: str) -> DataFrame:
    t = bridge.tables(spark, sf, "declarations", "doacoes_efetuadas")
    date = F.when(F.col("declaration_id") % 10 != 0, _doc_date())
    documents = render.xml_returns(render.nested(t, date=date), "doacoes_efetuadas")
    returns = _written_xml(spark, documents)
    return returns.select("declaration_id", "cpf", "data_documento", "summary",
                          F.size("doacoes_efetuadas").alias("n_donations"))


def _label_amounts(tables: dict[str, DataFrame]) -> DataFrame:
    """All schedules in one shape: table, return, one text column, one amount."""
    picked = {"bens_direitos": ("discriminacao", "valor_2024"),
              "doacoes_efetuadas": ("nome_proponente", "valor_pago"),
              "pagamentos_efetuados": ("codigo", "valor_pago"),
              "rendimentos_exclusivos": ("nome_fonte_pagadora", "valor"),
              "rendimentos_isentos": ("nome_fonte_pagadora", "valor"),
              "rendimentos_tributaveis_pj": ("nome_fonte_pagadora", "rendimentos")}
    rows = [tables[n].select(F.lit(n).alias("table_name"), "declaration_id", F.col(label).alias("label"),
                             F.col(amount).cast("double").alias("amount"))
            for n, (label, amount) in picked.items()]
    return reduce(DataFrame.unionByName, rows)


def _parsed(docs: DataFrame) -> DataFrame:
    """Parsed returns, written down for the six schedules to read their part of."""
    return written_table(shred.parse_json_column(docs, "document", key=F.col("declaration_id")), "returns")


def json_shred(spark: Spark, sf: str) -> DataFrame:
    docs = render.json_documents(render.nested(bridge.tables(spark, sf), date=_doc_date()))
    return _label_amounts(shred.shred(_parsed(docs), "json"))


def _document_totals(docs: DataFrame, *own: str) -> DataFrame:
    """What JSON documents of returns hold, by columns of theirs; a very large return has several documents, which
    together hold its lines."""
    back = docs.withColumn("r", F.from_json("document", render.docs_schema()))

    def total(table: str, column: str) -> Column:
        cents = F.transform(F.col(f"r.{table}.{column}"), lambda v: (v.cast("decimal(14,2)") * 100).cast("long"))
        return F.aggregate(cents, F.lit(0).cast("long"), lambda a, v: a + v)

    own = (*own, "data_documento", "summary")
    pages = back.select(
        *own[:-2], F.col("r.data_documento").alias("data_documento"),
        F.col("r.summary.text").alias("summary"),
        *[F.size(f"r.{n}").alias("n_" + n) for n in SCHEDULES],
        total("pagamentos_efetuados", "valor_pago").alias("paid_cents"),
        total("rendimentos_tributaveis_pj", "imposto_retido").alias("tax_cents"),
        F.size(F.filter("r.rendimentos_isentos", lambda x: x["nome_fonte_pagadora"].isNull())).alias("n_nameless"))
    return pages.groupBy(*own).agg(*[F.sum(c).alias(c) for c in pages.columns if c not in own])


def return_to_json(spark: Spark, sf: str) -> DataFrame:
    docs = shred.return_json(render.nested(bridge.tables(spark, sf), date=_doc_date()))
    return _document_totals(docs, "declaration_id")


def return_documents(spark: Spark, sf: str) -> DataFrame:
    """Return files to JSON documents, added up by date and summary."""
    path = shared_path(spark, "xml")
    render.write_xml(render.xml_returns(render.nested(bridge.tables(spark, sf), date=_doc_date()), *SCHEDULES), path)
    return _document_totals(documents.return_documents(spark, path, as_of=AS_OF))


def typed_empty_schedule(spark: Spark, sf: str) -> DataFrame:
    docs = render.json_documents(
        render.nested(bridge.tables(spark, sf), date=_doc_date()), "doacoes_efetuadas", "bens_direitos")
    rows = _label_amounts(shred.shred(_parsed(docs), "json"))
    counts = [F.count_if(F.col("table_name") == n).alias(n) for n in SCHEDULES]
    return rows.agg(*counts, F.round(F.sum("amount"), 2).alias("amount"))


def csv_round_trip(spark: Spark, sf: str) -> DataFrame:
    tables = bridge.tables(spark, sf)
    paths = writers.write_csv_tables(tables, shared_path(spark, "csv"))
    key = tables["declarations"].schema["declaration_id"].dataType
    back = {n: readers.read_table_csv(spark, p, n, key) for n, p in paths.items()}
    names = back["declarations"].select("declaration_id", "file_name")
    return _label_amounts(back).join(names, "declaration_id", "left")


def money_double(spark: Spark, sf: str) -> DataFrame:
    nested = render.nested(bridge.tables(spark, sf, "declarations", "doacoes_efetuadas"), date=_doc_date())
    return (shred.money_as_double(nested).select("declaration_id", F.inline("doacoes_efetuadas"))
            .select("declaration_id", "codigo", "valor_pago"))


def dense_ids(spark: Spark, sf: str) -> DataFrame:
    return shred.dense_ids(bridge.tables(spark, sf, "declarations")["declarations"]).select(
        F.col("declaration_id").cast("long").alias("declaration_id"), "file_path")


def load_xml(spark: Spark, sf: str) -> DataFrame:
    returns = render.nested(bridge.tables(spark, sf), date=_doc_date())
    path = shared_path(spark, "xml")
    render.write_xml(render.xml_returns(returns, *SCHEDULES), path)
    tables, _ = documents.load_xml(spark, path, as_of=AS_OF, key=F.col("cpf").cast("long"))
    return _label_amounts(tables)


def load_documents(spark: Spark, sf: str) -> DataFrame:
    """Extracted returns from a folder to the stored tables, then a second run
    that finds nothing to do."""
    docs = render.json_documents(render.nested(bridge.tables(spark, sf), date=_doc_date()))
    root = shared_path(spark, "load")
    # The file name carries the key of a return, which its lines come back with.
    (docs.select(F.from_json("document", render.docs_schema()).alias("r"),
                 F.col("declaration_id").cast("string").alias("file_name"))
     .select("r.*", "file_name").write.option("compression", "gzip").json(f"{root}/in"))
    key = F.col("file_name").cast("long")
    for _ in range(2):
        documents.process_documents(spark, f"{root}/in", f"{root}/log", f"{root}/out", key=key,
                                    key_type=T.LongType(), multi_line=False, buckets=4)
    return _label_amounts({n: documents.read_stored(spark, f"{root}/out", n, T.LongType()) for n in SCHEDULES})


def load_changes(spark: Spark, sf: str) -> DataFrame:
    """Returns in files, some in two, beside a broken and a foreign file; then a file of those goes, one without copy goes,
    and one is written anew without its donations. Under default keys and under keys of the returns' own."""
    t = bridge.tables(spark, sf, "declarations", "doacoes_efetuadas", "pagamentos_efetuados")
    docs = render.json_documents(render.nested(t, date=_doc_date()))
    records = written_table(docs.select(
        F.from_json("document", render.docs_schema()).alias("r"),
        F.concat(F.lit("c"), F.col("declaration_id").cast("string")).alias("file_name"),
        F.pmod("declaration_id", F.lit(4)).alias("part")).select("r.*", "file_name", "part"), "records")
    root = shared_path(spark, "changes")

    def put(rows: DataFrame, name: str) -> None:
        rows.drop("part").write.option("compression", "gzip").json(f"{root}/in/{name}")

    for k in range(4):
        put(records.where(F.col("part") == k), f"part{k}")
    put(records.where("part = 0"), "copy")
    given(spark, sf, "region").coalesce(1).select(F.concat(F.lit('{"summary": '), "r_name").alias("value")).write.text(f"{root}/texts")
    given(spark, sf, "region").coalesce(1).write.json(f"{root}/in/foreign")
    for n, text in enumerate(spark.read.text(f"{root}/texts").inputFiles()):
        move_file(spark, text, f"{root}/in/broken/{n}.json")
    keys = {"own": None, "given": F.expr("try_cast(substring(file_name, 2) AS long)")}

    def state(step: str) -> DataFrame:
        parts = []
        for name, key in keys.items():
            kind = T.LongType() if name == "given" else None
            documents.process_documents(spark, f"{root}/in", f"{root}/log-{name}", f"{root}/out-{name}", key=key,
                                        key_type=kind, multi_line=False, buckets=4)
            stored = {n: documents.read_stored(spark, f"{root}/out-{name}", n, kind)
                      for n in ("declarations", "doacoes_efetuadas", "pagamentos_efetuados", "rejects")}
            whose = stored["declarations"].select("declaration_id", F.col("summary").alias("name"))
            rows = [whose.select(F.lit("declarations").alias("table_name"), "name", F.lit(None).cast("decimal(14,2)").alias("v")),
                    stored["rejects"].select(F.lit("rejects").alias("table_name"), F.col("rule").alias("name"),
                                             F.lit(None).cast("decimal(14,2)").alias("v"))]
            rows = [r.withColumn("n", F.lit(1).cast("long")).withColumn("v", F.col("v").cast("decimal(24,2)")) for r in rows]
            # Lines are added up by return before they meet its name, so that few rows are joined.
            rows += [stored[n].groupBy("declaration_id").agg(F.count("*").alias("n"), F.sum("valor_pago").alias("v"))
                     .join(whose, "declaration_id").select(F.lit(n).alias("table_name"), "name", "v", "n")
                     for n in ("doacoes_efetuadas", "pagamentos_efetuados")]
            parts.append(reduce(DataFrame.unionByName, rows).groupBy("table_name", "name").agg(
                F.sum("n").alias("n"), F.sum("v").cast("double").alias("amount"))
                .select(F.lit(step).alias("step"), F.lit(name).alias("keys"), "*"))
        return written_table(parts[0].unionByName(parts[1]), "state")

    first = state("first")
    for gone in ("part0", "part1", "part2"):
        readers.delete_folder(spark, f"{root}/in/{gone}")
    put(records.where("part = 2").withColumn("doacoes_efetuadas", F.lit(None).cast(records.schema["doacoes_efetuadas"].dataType)), "part2")
    return first.unionByName(state("second"))


# ---------------------------------------------------------------- files

def file_changes(spark: Spark, sf: str) -> DataFrame:
    """Documents as files; the labelled ones were processed before, and the files
    of those of low quality have changed since."""
    base = F.lit("2025-01-01").cast("timestamp")
    labels = given(spark, sf, "labels").select("doc_id", "quality")
    docs = (given(spark, sf, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
            .withColumn("path", F.concat(F.lit("/kb/"), "source", F.lit("/"),
                                         F.col("doc_id").cast("string"), F.lit(".txt"))))
    later = F.make_interval(days=F.when(F.col("quality") == 0, 60).otherwise(0))
    files = docs.select("path", (base + later).alias("modified_at"))
    manifest = docs.where("quality IS NOT NULL").select(
        "path", base.alias("modified_at"), F.lit("2025-02-01").cast("timestamp").alias("processed_at"))
    return incremental.changed_files(files, manifest).select("path", "change")


def file_status(spark: Spark, sf: str) -> DataFrame:
    """Return files of all customers; only those with a positive balance have one."""
    c = given(spark, sf, "customer").withColumn("path", F.concat(F.lit("/in/"), "c_name", F.lit(".xml")))
    there = c.where("c_acctbal >= 0").select(
        "path", (F.col("c_custkey") * 37).alias("length"), F.lit("2025-01-01").cast("timestamp").alias("modified_at"))
    return readers.file_status(c.select("path"), there).drop("ultima_modificacao")


def stream_arrivals(spark: Spark, sf: str) -> DataFrame:
    t = bridge.tables(spark, sf, "declarations", "pagamentos_efetuados")
    docs = render.json_documents(render.nested(t, date=_doc_date()))
    root = shared_path(spark, "stream")
    # The file name carries the key of a return, which its lines come back with.
    named = docs.select(F.expr("concat(left(document, length(document) - 1), ',\"file_name\":\"', "
                               "declaration_id, '\"}')").alias("value"))
    named.repartition(6).write.text(f"{root}/in")
    arrivals.stream_json_returns(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint",
                                 key=F.col("file_name").cast("long"), files_per_batch=2).awaitTermination()
    return plain(arrivals.read_streamed(spark, f"{root}/out", "pagamentos_efetuados"))


# ---------------------------------------------------------------- retrieval

def _docs(spark: Spark, sf: str) -> DataFrame:
    return readers.read_documents(spark, f"{sf}/documents.parquet")


def _questions(spark: Spark, sf: str) -> DataFrame:
    return given(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _chunk_view(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("doc_id").cast("long").alias("doc_id"), "chunk_no", "n_tokens",
                         F.md5("text").alias("text_md5"))


def chunk_words_query(spark: Spark, sf: str) -> DataFrame:
    return _chunk_view(chunk_words(_docs(spark, sf)))


def chunk_sentences_query(spark: Spark, sf: str) -> DataFrame:
    return _chunk_view(chunk_sentences(_docs(spark, sf)))


def chunk_tokens_query(spark: Spark, sf: str) -> DataFrame:
    return _chunk_view(chunk_tokens(_docs(spark, sf), read_ranks(spark, VOCABULARY)))


def bm25_topk(spark: Spark, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumnRenamed("doc_id", "item_id")
    return retrieve.bm25_topk(_questions(spark, sf), docs)


def bm25_stemmed(spark: Spark, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumnRenamed("doc_id", "item_id")
    return retrieve.bm25_topk(_questions(spark, sf), docs, normalize=english_stems)


def vector_topk(spark: Spark, sf: str) -> DataFrame:
    """For each label, the vectors nearest to the mean of its vectors."""
    vectors = given(spark, sf, "embeddings")
    means = (vectors.select("label", F.posexplode("embedding").alias("p", "v"))
             .groupBy("label", "p").agg(F.avg(F.col("v").cast("double")).alias("m"))
             .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("s"))
             .select(F.col("label").alias("query_id"), F.col("s.m").alias("embedding")))
    items = vectors.select(F.col("vec_id").alias("item_id"), "embedding")
    return retrieve.vector_topk(means, items)


def vector_cells(spark: Spark, sf: str) -> DataFrame:
    """Every tenth vector against all of them, by the index of cells."""
    vectors = given(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.vector_topk(asked, build_cells(vectors.select(F.col("vec_id").alias("item_id"), "embedding")), 5)


def bm25_stored(spark: Spark, sf: str) -> DataFrame:
    """The questions against stored blocks of the postings of all documents."""
    docs = _docs(spark, sf).withColumnRenamed("doc_id", "item_id")
    index, size = retrieve.stored_postings(docs)
    blocks = written_table(posting_blocks(index, size, k1=retrieve.K1, b=retrieve.B), "blocks")
    return retrieve.bm25_topk(_questions(spark, sf), docs, size=size, blocks=blocks)


def _doc_vectors(spark: Spark, sf: str) -> DataFrame:
    return embed(_docs(spark, sf)).select(F.col("doc_id").alias("item_id"), "embedding")


def hybrid_hits(spark: Spark, sf: str) -> DataFrame:
    asked = embed(_questions(spark, sf)).select("query_id", "embedding")
    vector = retrieve.vector_topk(asked, _doc_vectors(spark, sf))
    return retrieve.hybrid_topk(vector, bm25_topk(spark, sf))


def embed_hashed(spark: Spark, sf: str) -> DataFrame:
    return (_doc_vectors(spark, sf).select(F.col("item_id").alias("doc_id"),
                                           F.posexplode_outer("embedding").alias("slot", "v"))
            .where("v > 0").select("doc_id", "slot", F.round(F.col("v").cast("double"), 5).alias("value")))


def kb_context(spark: Spark, sf: str) -> DataFrame:
    collection = written_table(collection_rows(_docs(spark, sf)), "collection")
    return retrieve.ask(_questions(spark, sf), collection).select(
        "query_id", "rank", "score", F.col("doc_id").cast("long").alias("doc_id"), "chunk_no",
        F.md5("context").alias("context_md5"))


def collection_upsert(spark: Spark, sf: str) -> DataFrame:
    """All documents stored; then the French ones edited and the Spanish removed."""
    docs = _docs(spark, sf)
    lang = given(spark, sf, "documents").select("doc_id", "lang")
    path = shared_path(spark, "collection")

    def rows(df: DataFrame) -> DataFrame:
        return chunk_words(df).withColumn("embedding", F.array(F.col("n_tokens").cast("float")))

    writers.upsert_chunks(rows(docs), docs, path, buckets=16)
    french = docs.join(lang.where("lang = 'fr'"), "doc_id", "left_semi")
    edited = french.withColumn("text", F.concat(F.lit("nova versão "), "text"))
    touched = lang.where("lang IN ('fr', 'es')").select(F.col("doc_id").cast("string").alias("doc_id"))
    writers.upsert_chunks(rows(edited), touched, path, buckets=16)
    return _chunk_view(readers.read_collection(spark, path))


# ---------------------------------------------------------------- pages

def _pages(spark: Spark, sf: str) -> DataFrame:
    return readers.read_pages(spark, f"{sf}/pages.parquet")


def page_links(spark: Spark, sf: str) -> DataFrame:
    return crawl.link_table(_pages(spark, sf), "example.com")


def page_record(spark: Spark, sf: str) -> DataFrame:
    return crawl.page_records(_pages(spark, sf))


def page_main_text(spark: Spark, sf: str) -> DataFrame:
    return crawl.structured_pages(_pages(spark, sf))


def url_forms(spark: Spark, sf: str) -> DataFrame:
    url = F.col("url")
    links = F.array(*[F.lit(h) for h in ("../up", "x/./y", "/root", "//other.example:80/z", "?q=1",
                                         "#frag", "mailto:a@b.example", "")])
    return _pages(spark, sf).select("url", F.explode(links).alias("href")).select(
        "url", "href", U.resolve(url, F.col("href")).alias("resolved"),
        U.authority(U.resolve(url, F.col("href"))).alias("host"),
        U.without_fragment(url).alias("page"))


SITE = "https://site.example/p/"


def _site(spark: Spark, sf: str) -> DataFrame:
    """Pages of one site: each links to two later ones, to itself, back, to a
    page outside the prefix and to a missing one; its own text is kept."""
    n = F.col("page_id")

    def link(href: Column) -> Column:
        return F.concat(F.lit('<a class="n" href="'), href, F.lit('">x</a>'))

    back = F.when(n > 2, link(F.concat(F.lit("/p/"), F.floor((n - 1) / 2).cast("string"), F.lit("#up")))).otherwise("")
    markup = F.concat(
        link(F.concat(F.lit("../p/"), (2 * n + 1).cast("string"))),
        link(F.concat((2 * n + 2).cast("string"), F.lit("#top"))), link(F.lit("#self")), back,
        link(F.lit("https://site.example/q/0")), link(F.concat(F.lit("/p/none"), n.cast("string"))), "html")
    return readers.spread_scan(given(spark, sf, "pages"), "page_id").select(
        F.concat(F.lit(SITE), n.cast("string")).alias("url"), markup.alias("html"))


def _linked_site(spark: Spark, sf: str) -> DataFrame:
    """The site with a front page, whose url is the prefix of all others."""
    front = given(spark, sf, "pages").agg(F.count("*").alias("n")).select(
        F.lit(SITE).alias("url"),
        F.concat(F.lit('<a href="1">first</a><!-- '), F.col("n").cast("string"), F.lit(" -->")).alias("html"))
    return _site(spark, sf).unionByName(front)


def page_reachable(spark: Spark, sf: str) -> DataFrame:
    return crawl.reachable(_linked_site(spark, sf), SITE, "site.example")


def site_records(spark: Spark, sf: str) -> DataFrame:
    """Crawl, extraction and the JSON file, read back."""
    path = shared_path(spark, "site")
    crawl_to_json(_linked_site(spark, sf), path, SITE, "site.example")
    return spark.read.schema("url string, host string, title string, description string, text string").json(path)


def scraped_json(spark: Spark, sf: str) -> DataFrame:
    """Page records in files of the scraper's form, lists of JSON texts, read back."""
    pages = _pages(spark, sf)
    records = crawl.structured_pages(pages).select(
        "url", F.to_json(F.struct("url", "title", "text")).alias("record"))
    part = F.pmod(F.xxhash64("url"), F.lit(max(1, pages.count() // 100))).alias("part")
    path = shared_path(spark, "scraped")
    (records.groupBy(part).agg(F.to_json(F.collect_list("record")).alias("value"))
     .repartition("part").write.partitionBy("part").text(path))
    back = readers.read_scraped_json(spark, path, "url string, title string, text string", "*.txt")
    return back.select("url", "title", F.md5("text").alias("text_md5"))


def knowledge_base(spark: Spark, sf: str) -> DataFrame:
    """A folder of text files to a stored collection; the second run finds
    nothing to do."""
    root = shared_path(spark, "knowledge")
    (given(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id")
     .write.partitionBy("item_id").text(f"{root}/texts"))
    for _ in range(2):
        collection, _done = build_knowledge_base(spark, f"{root}/texts", f"{root}/collection", f"{root}/manifest",
                                                 buckets=4)
    item = F.regexp_extract("doc_id", "item_id=([0-9]+)", 1).cast("long")
    return _chunk_view(collection.withColumn("doc_id", item))


QUERIES = {
    "income_sources": income_sources,
    "income_sources_grouped": income_sources_grouped,
    "income_sources_guard": income_sources_guard,
    "salary_income": salary_income,
    "payments_by_category": payments_by_category,
    "payments_by_category_alt": payments_by_category_alt,
    "asset_stats": asset_stats,
    "asset_change": asset_change,
    "free_sql": free_sql,
    "table_report": table_report,
    "parse_money": parse_money,
    "only_digits": only_digits,
    "pad_code": pad_code,
    "first_nonempty": first_nonempty,
    "flag_label": flag_label,
    "doc_date": doc_date,
    "summary_sentence": summary_sentence,
    "copy_forward": copy_forward,
    "local_names": local_names,
    "validate_rejects": validate_rejects,
    "pk_duplicates": pk_duplicates,
    "fk_orphans": fk_orphans,
    "xml_assets": _xml_in_column("bens_direitos"),
    "xml_payments": _xml_in_column("pagamentos_efetuados"),
    "xml_donations": _xml_in_column("doacoes_efetuadas"),
    "xml_salary": _xml_in_column("rendimentos_tributaveis_pj"),
    "xml_exempt": _xml_in_files("rendimentos_isentos"),
    "xml_exclusive": _xml_in_files("rendimentos_exclusivos"),
    "xml_returns": xml_returns,
    "json_shred": json_shred,
    "return_to_json": return_to_json,
    "return_documents": return_documents,
    "typed_empty_schedule": typed_empty_schedule,
    "csv_round_trip": csv_round_trip,
    "money_double": money_double,
    "dense_ids": dense_ids,
    "load_xml": load_xml,
    "load_documents": load_documents,
    "load_changes": load_changes,
    "file_changes": file_changes,
    "file_status": file_status,
    "stream_arrivals": stream_arrivals,
    "chunk_words": chunk_words_query,
    "chunk_sentences": chunk_sentences_query,
    "chunk_tokens": chunk_tokens_query,
    "bm25_topk": bm25_topk,
    "bm25_stemmed": bm25_stemmed,
    "vector_topk": vector_topk,
    "vector_cells": vector_cells,
    "bm25_stored": bm25_stored,
    "hybrid_hits": hybrid_hits,
    "embed_hashed": embed_hashed,
    "kb_context": kb_context,
    "collection_upsert": collection_upsert,
    "knowledge_base": knowledge_base,
    "page_links": page_links,
    "page_record": page_record,
    "page_main_text": page_main_text,
    "url_forms": url_forms,
    "page_reachable": page_reachable,
    "site_records": site_records,
    "scraped_json": scraped_json,
}
