"""First set-up: knowledge base, documents, declared tables, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fiscolake.plans.catalog import table_report
from fiscolake.plans.documents import process_documents, read_stored
from fiscolake.plans.knowledge import build_knowledge_base
from fiscolake.schemas import ALL_TABLES
from fiscolake.sources.readers import path_exists
from fiscolake.sources.writers import declare_tables


@dataclass(frozen=True)
class SetUp:
    knowledge_updated: bool
    documents_processed: bool
    declared: list[str]
    report: DataFrame


def set_up(spark: SparkSession, *, knowledge: str, documents: str, store: str,
           force: bool = False) -> SetUp:
    """Run every preparation step; ``store`` is the folder all results go to.

    Loaded tables become views; without any, the empty tables are declared.
    """
    _, knowledge_updated = build_knowledge_base(
        spark, knowledge, f"{store}/collection", f"{store}/manifest/knowledge", force=force)
    processed = process_documents(
        spark, documents, f"{store}/manifest/documents", f"{store}/tables", force=force)
    declared = []
    if path_exists(spark, f"{store}/tables"):
        for name in ALL_TABLES:
            read_stored(spark, f"{store}/tables", name).createOrReplaceTempView(name)
    else:
        declared = declare_tables(spark)
    return SetUp(knowledge_updated, processed, declared, table_report(spark))
