"""Versioned tables: what counts, what an update writes, what a failed one leaves."""

import pytest
from pyspark.sql import functions as F

from fiscolake.sources import store as st
from fiscolake.sources.store import Change, ConcurrentUpdate, Store, Stored


@pytest.fixture
def tables(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), {
        "a": Stored(st.as_struct(spark, "k string, v int"), "k"), "b": Stored(st.as_struct(spark, "k string, w string"), "k")})


def rows(spark, pairs, kind="int"):
    return spark.createDataFrame(pairs, f"k string, {'v' if kind == 'int' else 'w'} {kind}")


def held(store, name):
    return sorted(tuple(r) for r in store.read(name).collect())


def size(path, *parts):
    return sum(f.stat().st_size for f in path.joinpath(*parts).rglob("*.parquet"))


def test_updates_replace_add_and_remove(spark, tables):
    assert tables.version() == 0 and held(tables, "a") == [] and tables.read("a").columns == ["k", "v"]
    assert tables.update({"a": Change(rows(spark, [("x", 1), ("x", 2), ("y", 3)])), "b": Change(rows(spark, [("x", "p")], "string"))}) == {"a": 3, "b": 1}
    tables.update({"a": Change(rows(spark, [("x", 9)]), rows(spark, [("x", 0)])), "b": Change(None, rows(spark, [("x", 0)]))})
    assert held(tables, "a") == [("x", 9), ("y", 3)] and held(tables, "b") == []
    tables.update({"a": Change(None, rows(spark, [("y", 0), ("none", 0)]))})
    tables.update({"a": Change(rows(spark, [("y", 4)]))})
    assert held(tables, "a") == [("x", 9), ("y", 4)] and tables.version() == 4


def test_a_failed_update_leaves_the_old_state(spark, tables, monkeypatch):
    tables.update({"a": Change(rows(spark, [("x", 1)])), "b": Change(rows(spark, [("x", "p")], "string"))})
    broken = rows(spark, [("x", 5)]).withColumn("v", F.raise_error(F.lit("stop")).cast("int"))
    for change in ({"a": Change(rows(spark, [("x", 2)]), rows(spark, [("x", 0)])), "b": Change(broken.withColumnRenamed("v", "w"))},
                   {"b": Change(None, rows(spark, [("x", 0)])), "a": Change(broken)}):
        with pytest.raises(Exception, match="stop"):
            tables.update(change)
        assert held(tables, "a") == [("x", 1)] and held(tables, "b") == [("x", "p")] and tables.version() == 1
    tables.update({"a": Change(rows(spark, [("x", 3)]), rows(spark, [("x", 0)]))})
    assert held(tables, "a") == [("x", 3)] and held(tables, "b") == [("x", "p")]
    assert len(tables.remove_unused()) >= 2 and held(tables, "a") == [("x", 3)]


def test_an_update_writes_what_changes(spark, tables, tmp_path):
    many = spark.range(200_000).select(F.col("id").cast("string").alias("k"), F.hash("id").alias("v"))
    tables.update({"a": Change(many)}, files=4)
    before = size(tmp_path, "store", "a")
    few = many.where("v % 200 = 0").limit(1000)
    tables.update({"a": Change(few.withColumn("v", F.lit(0)), few)}, files=1)
    assert (size(tmp_path, "store", "a") - before) < before / 50
    assert tables.read("a").count() == 200_000 and tables.read("a").where("v = 0").count() >= few.count()


def test_compaction_keeps_what_counts(spark, tables, tmp_path):
    for i in range(4):
        tables.update({"a": Change(rows(spark, [("x", i), (f"y{i}", i)]), rows(spark, [("x", 0)]))})
    want = held(tables, "a")
    assert tables.compact() == 5 and held(tables, "a") == want and held(tables, "b") == []
    assert len(tables.remove_unused()) == 8 and held(tables, "a") == want
    tables.update({"a": Change(rows(spark, [("x", 7)]), rows(spark, [("x", 0)]))})
    assert held(tables, "a") == [("x", 7), *want[1:]] and tables.version() == 6
    assert Store(spark, str(tmp_path / "nothing"), tables.tables).compact() == 0


def test_of_two_writers_one_fails(spark, tables, monkeypatch):
    tables.update({"a": Change(rows(spark, [("x", 1)]))})
    known = tables.commits()
    slow = Store(spark, tables.root, tables.tables)
    tables.update({"a": Change(rows(spark, [("x", 2)]))})
    answers = [known, known]  # what the slow writer saw before the other one committed
    monkeypatch.setattr(slow, "commits", lambda: answers.pop() if answers else Store.commits(slow))
    with pytest.raises(ConcurrentUpdate):
        slow.update({"a": Change(rows(spark, [("x", 3)]), rows(spark, [("x", 0)]))})
    assert held(tables, "a") == [("x", 1), ("x", 2)] and tables.version() == 2
