"""The pipeline and the registered queries on the smallest given tables."""

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from checks.compare import connect, difference
from fiscolake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries())
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SF), SF, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_a_row_per_row(spark, name):
    out = QUERIES[name](spark, SF)
    if name == "op1_length_histogram":
        assert out.agg({"docs": "sum"}).first()[0] == 200
    else:
        assert out.count() == (50 if name in ("op7_page_text", "op8_url_filter") else 200)


def test_stages_hand_on_what_they_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.columns[:len(columns)] == columns and (name == "mixing" or len(docs.columns) == len(columns))
        docs.write.mode("overwrite").saveAsTable(f"stage_{name}")
        docs = spark.table(f"stage_{name}")
        assert 0 < docs.count() <= before
        before = docs.count()
