"""The corpus pipeline: each stage takes what the one before kept, written as Parquet, and its decisions take effect.

Toxic documents go, later copies of lines go, one document of each group of near-duplicates stays, documents that
hold benchmark items go, and the rest is drawn so that its tokens meet the target margins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fiscolake.llm import decontaminate, lines, minhash, mixing, toxicity
from fiscolake.session import written_table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", lines.stage),
    ("near_duplicates", minhash.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: Models, hashes and draws are part of the stages, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; what a stage returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written_table(stage(spark, docs, sf_dir), name)
    return docs
