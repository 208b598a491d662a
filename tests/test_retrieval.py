import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fiscolake.functions.tokens import OfLists, strip_plural, terms
from fiscolake.operators import cells, postings, retrieve
from fiscolake.operators.chunk import chunk_sentences, chunk_words
from fiscolake.operators.embed import embed, hashed_words
from fiscolake.session import written_table

DOCS = [(i, " ".join(f"w{(i * j) % 13}" for j in range(1, 5 + i % 7)) + (" comum" * (i % 3))) for i in range(60)]
QUERIES = [(i, f"w{i} comum w{(i * 5) % 13} w{i}") for i in range(12)]


def _docs(spark):
    return spark.createDataFrame(DOCS, "item_id long, text string")


def _queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string")


def _bm25(k):
    tok = lambda t: re.findall(r"\w{2,}", t.lower())
    docs = {i: tok(t) for i, t in DOCS}
    n, mean = len(docs), np.mean([len(t) for t in docs.values()])
    df = Counter(w for t in docs.values() for w in set(t))
    out = {}
    for q, text in QUERIES:
        scores = []
        for i, t in docs.items():
            tf = Counter(t)
            s = sum(math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * tf[w] * 2.5
                    / (tf[w] + 1.5 * (.25 + .75 * len(t) / mean)) for w in tok(text) if tf[w])
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


SMALL_BLOCKS = {"max_shared_queries": 5, "items_per_block": 17}


def grouped(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.item_id, pytest.approx(r.score, abs=2e-6)))
    return out


@pytest.mark.parametrize("k, block_size", [(3, 128), (1, 3), (3, 1), (100, 2)])
def test_bm25_matches_brute_force(spark, k, block_size):
    assert grouped(retrieve.bm25_topk(_queries(spark), _docs(spark), k)) == _bm25(k)
    size = retrieve.collection_size(_docs(spark))
    blocks = written_table(postings.posting_blocks(retrieve.postings(_docs(spark)), size, k1=retrieve.K1, b=retrieve.B,
                                                   block_size=block_size), "blocks")
    assert grouped(retrieve.bm25_topk(_queries(spark), _docs(spark), k, size=size, blocks=blocks)) == _bm25(k)


def test_bm25_reads_few_of_the_stored_blocks(spark):
    """A word of every document and rare ones: the common word's postings are not taken apart, and hits stay the same."""
    docs = spark.range(4000).selectExpr("id AS item_id", "concat('todos ', repeat('todos ', cast(id % 3 AS int)), "
                                        "'raro', id div 40, ' cheio', id % 7) AS text")
    size, index = retrieve.collection_size(docs), retrieve.postings(docs)
    blocks = written_table(postings.posting_blocks(index, size, k1=retrieve.K1, b=retrieve.B), "blocks")
    assert blocks.agg(F.max("n"), F.sum("n")).first()[1] == index.count()
    queries = spark.createDataFrame([(i, f"todos raro{i * 9}") for i in range(8)], "query_id long, text string")
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term"), F.lit(1).alias("n"))
    judged = postings.essential_terms(asked, blocks, size, 2)
    assert judged.where("essential").select("term").where("term = 'todos'").count() == 0
    read = postings.blocks_to_read(judged, blocks).agg(F.sum("n")).first()[0]
    assert read <= 8 * 40 and blocks.where("term = 'todos'").agg(F.sum("n")).first()[0] == 4000
    stored = grouped(retrieve.bm25_topk(queries, docs, 2, size=size, blocks=blocks))
    assert stored == grouped(retrieve.bm25_topk(queries, docs, 2)) and len(stored) == 8


def test_bm25_stored_index_and_normalizer(spark):
    index, size = retrieve.postings(_docs(spark)), retrieve.collection_size(_docs(spark))
    assert grouped(retrieve.bm25_topk(_queries(spark), _docs(spark), 2, index=index, size=size)) == _bm25(2)
    docs = spark.createDataFrame([(1, "tax returns"), (2, "bread")], "item_id int, text string")
    asked = spark.createDataFrame([(1, "return")], "query_id int, text string")
    assert retrieve.bm25_topk(asked, docs).count() == 0
    assert [r.item_id for r in retrieve.bm25_topk(asked, docs, normalize=strip_plural).collect()] == [1]
    nothing = spark.createDataFrame([(1, "..."), (2, "zzz")], "query_id int, text string")
    assert retrieve.bm25_topk(nothing, docs).count() == 0


@pytest.mark.parametrize("limits", [{}, SMALL_BLOCKS])
def test_vector_topk_matches_brute_force(spark, limits):
    rng = np.random.default_rng(5)
    items = rng.normal(size=(80, 8)).astype(np.float32)
    items[40:60] = items[3]  # equal copies: ties go by id
    asked = np.vstack([rng.normal(size=(10, 8)).astype(np.float32), items[3]])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(items)], "item_id int, embedding array<float>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id int, embedding array<float>")
    scores = np.round(asked.astype(np.float64) @ items.astype(np.float64).T, 6)
    want = {i: [(int(j), s[j]) for j in sorted(range(80), key=lambda j: (-s[j], j))[:4]] for i, s in enumerate(scores)}
    assert grouped(retrieve.vector_topk(q, v, 4, **limits)) == want


def _clustered(n, dim=8, groups=20):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(groups, dim)) * 5
    x = (middles[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.1).astype(np.float32)
    x[: n // 3] = x[0]  # a third are copies of one vector
    return x


@pytest.mark.parametrize("options, limits", [({}, {}), ({"n_cells": 3, "part_size": 50}, {"block_size": 4}), ({"n_cells": 1}, {})])
def test_cells_give_what_all_vectors_give(spark, options, limits):
    items = _clustered(600)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(items)] + [(9999, None), (9998, [float("nan")] * 8)],
                              "item_id int, embedding array<float>")
    asked = np.vstack([items[:3], np.random.default_rng(1).normal(size=(10, 8)).astype(np.float32), np.zeros((1, 8), np.float32)])
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id int, embedding array<float>")
    index = cells.build_cells(v, **options)
    scores = np.round(asked.astype(np.float64) @ items.astype(np.float64).T, 6)
    want = {i: [(int(j), s[j]) for j in sorted(range(600), key=lambda j: (-s[j], j))[:5]] for i, s in enumerate(scores)}
    assert grouped(retrieve.vector_topk(q, index, 5, **limits)) == want


def test_few_cells_are_read(spark):
    items = _clustered(3000)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(items)], "item_id int, embedding array<float>")
    q = spark.createDataFrame([(i, items[i].tolist()) for i in range(1500, 1520)], "query_id int, embedding array<float>")
    index = cells.build_cells(v)
    first = cells.cells_to_read(q, index, 2).count()
    floors = retrieve.vector_topk(q, index, 2).groupBy("query_id").agg(F.min("score").alias("least"))
    assert first + cells.cells_to_read(q, index, 2, floors).count() < 0.25 * 20 * index.cells.count()
    assert index.cells.agg(F.sum("n")).first()[0] == 3000


def test_a_query_is_held_once_however_many_cells_it_reads(spark, monkeypatch):
    rng, rows = np.random.default_rng(3), {}
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(900, 8)).astype(np.float32))],
                              "item_id int, embedding array<float>")
    q = v.where("item_id % 2 = 0").withColumnRenamed("item_id", "query_id")

    def counted(df, name):
        out = written_table(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(cells, "written_table", counted)
    index = cells.build_cells(v)
    assert retrieve.vector_topk(q, index, 5).count() == 5 * 450
    assert rows["chosen"] == [450, 450]
    none = spark.createDataFrame([], "query_id int, least double")
    assert cells.cells_to_read(q, index, 5, none).count() > 10 * 450


def test_cells_of_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "item_id int, embedding array<float>")
    q = v.withColumnRenamed("item_id", "query_id")
    assert retrieve.vector_topk(q, cells.build_cells(v.limit(0)), 3).count() == 0
    assert grouped(retrieve.vector_topk(q, cells.build_cells(v), 3)) == {1: [(1, 1.0)]}
    assert retrieve.vector_topk(q.limit(0), cells.build_cells(v), 3).count() == 0


def test_fewer_items_than_k_and_empty_sides(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "item_id int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, embedding array<float>")
    assert grouped(retrieve.vector_topk(q, v, 5)) == {1: [(1, 1.0)], 2: [(1, 0.0)]}
    more = v.union(v.sparkSession.createDataFrame([(2, None)], v.schema))
    assert grouped(retrieve.vector_topk(q, more, 5)) == {1: [(1, 1.0)], 2: [(1, 0.0)]}
    assert retrieve.vector_topk(q, v.limit(0), 5).count() == 0
    assert retrieve.vector_topk(q.limit(0), v, 5).count() == 0


def test_hybrid(spark):
    schema = "query_id int, item_id int, score double, rank int"
    a = spark.createDataFrame([(1, 1, .9, 1), (1, 2, .8, 2)], schema)
    b = spark.createDataFrame([(1, 2, 7.0, 1), (1, 3, 6.0, 2)], schema)
    assert retrieve.hybrid_topk(a, b).count() == 4
    single = {r.item_id: (r.source, r["rank"]) for r in retrieve.hybrid_topk(a, b, dedupe=True).collect()}
    assert single == {1: ("vector", 1), 2: ("bm25", 1), 3: ("bm25", 2)}


def test_embedding(spark):
    df = spark.createDataFrame([(1, "Um dois DOIS"), (2, ""), (3, None)], "i int, text string")
    rows = {r.i: r.embedding for r in embed(df, hashed_words(32)).collect()}
    assert [len(v) for v in rows.values()] == [32] * 3
    assert np.linalg.norm(rows[1]) == pytest.approx(1, abs=1e-6) and not any(rows[2]) and not any(rows[3])
    constant = F.pandas_udf(lambda s: s.map(lambda _: [1.0, 2.0]), "array<float>")
    assert embed(df, constant).first().embedding == [1.0, 2.0]


def test_terms_and_stemming(column):
    assert column(terms, ["Árvore, a x9 b_2!"]) == [["árvore", "x9", "b_2"]]
    got = column(strip_plural, ["ponies", "churches", "cats", "glass", "virus", "trees"])
    assert got == ["pony", "churche", "cat", "glass", "virus", "tree"]


def _chunk_rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.chunk_no):
        out.setdefault(r.doc_id, []).append(r.text.split())
    return out


def test_word_chunks_cover_the_text(spark):
    texts = {n: [f"t{i}" for i in range(n)] for n in (0, 1, 9, 10, 11, 17, 18, 40)}
    df = spark.createDataFrame([(n, " \n ".join(w)) for n, w in texts.items()], "doc_id int, text string")
    got = _chunk_rows(chunk_words(df, size=10, overlap=3))
    assert "0" not in got
    for n, words in texts.items():
        if n:
            chunks = got[str(n)]
            assert all(len(c) <= 10 for c in chunks)
            assert chunks[0] + [w for c in chunks[1:] for w in c[3:]] == words
    with pytest.raises(ValueError):
        chunk_words(df, 5, 5)


def test_sentence_chunks(spark):
    @given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.integers(4, 12), st.integers(0, 3))
    @settings(max_examples=8, deadline=None)
    def check(lengths, size, overlap):
        words = iter(f"p{i}" for i in range(10 ** 6))
        sentences = [[next(words) for _ in range(n)] for n in lengths]
        text = " ".join(" ".join(s) + "." for s in sentences)
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        chunks = _chunk_rows(chunk_sentences(df, size, overlap))["1"]
        plain = [[w.rstrip(".") for w in c] for c in chunks]
        assert all(len(c) <= size for c in plain)
        seen, order = set(), []
        for c in plain:
            order += [w for w in c if w not in seen]
            seen.update(c)
        assert order == [w for s in sentences for w in s]
        for a, b in zip(plain, plain[1:]):
            shared = len(set(a) & set(b))
            assert shared <= overlap and a[len(a) - shared:] == b[:shared]
    check()


def test_one_very_long_sentence(spark):
    df = spark.createDataFrame([("d", " ".join(f"w{i}" for i in range(2500)))], "doc_id string, text string")
    assert [len(c) for c in _chunk_rows(chunk_sentences(df))["d"]] == [1024, 1024, 452]


def test_ask_returns_contexts_in_order(spark):
    docs = spark.createDataFrame([("a", "prazo de entrega da declaração"), ("b", "carro e casa"), ("c", "entrega")],
                                 "doc_id string, text string")
    collection = embed(chunk_sentences(docs))
    asked = spark.createDataFrame([(7, "prazo da entrega")], "query_id int, text string")
    got = retrieve.ask(asked, collection, 2).collect()
    assert [(r.query_id, r["rank"], r.doc_id) for r in got] == [(7, 1, "a"), (7, 2, "c")]
    assert got[0].context == "prazo de entrega da declaração"


def test_postings_are_counted_within_their_row(spark):
    index = retrieve.postings(spark.createDataFrame([(1, "b aa bb aa"), (2, ""), (3, None), (4, "aa")], "item_id int, text string"))
    assert sorted(tuple(r) for r in index.collect()) == [(1, 3, "aa", 2), (1, 3, "bb", 1), (4, 1, "aa", 1)]
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_stems_are_worked_out_once_for_each_different_term(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @OfLists
    def counted(found):
        @F.udf("array<string>")
        def shorter(many):
            seen.add(len(many))
            return [t.removesuffix("s") for t in many]
        return shorter(found)

    monkeypatch.setattr(retrieve, "ROWS_PER_PART", 2)
    docs = spark.createDataFrame([(i, "taxes tax taxs " * 50 + "bread") for i in range(20)], "item_id int, text string")
    asked = spark.createDataFrame([(1, "tax"), (2, "bread")], "query_id int, text string")
    hits = grouped(retrieve.bm25_topk(asked, docs, normalize=counted))
    assert seen.value < 100  # 3,020 terms in the texts, 4 different ones
    plain = spark.createDataFrame([(i, "taxe tax tax " * 50 + "bread") for i in range(20)], "item_id int, text string")
    assert hits == grouped(retrieve.bm25_topk(asked, plain)) and len(hits) == 2
    drops = OfLists(lambda found: F.filter(found, lambda t: t != "taxs"))
    kept = spark.createDataFrame([(i, "taxes tax " * 50 + "bread") for i in range(20)], "item_id int, text string")
    assert grouped(retrieve.bm25_topk(asked, docs, normalize=drops)) == grouped(retrieve.bm25_topk(asked, kept))


def test_postings_are_shuffled_once_into_blocks(spark):
    index, size = retrieve.stored_postings(_docs(spark))
    assert size.first() == retrieve.collection_size(_docs(spark)).first()
    blocks = postings.posting_blocks(index, size, k1=retrieve.K1, b=retrieve.B, block_size=5)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert blocks.agg(F.max("n"), F.sum("n")).first() == (5, index.count())


def test_lookups_shuffle_no_row_per_pair_and_term(spark):
    index, size = retrieve.stored_postings(_docs(spark))
    blocks = written_table(postings.posting_blocks(index, size, k1=retrieve.K1, b=retrieve.B), "blocks")
    pairs = written_table(spark.range(2).crossJoin(spark.range(20).withColumnRenamed("id", "item_id")).withColumnRenamed("id", "query_id"), "pairs")
    asked = spark.createDataFrame([(q, f"w{i}", 1.0) for q in range(2) for i in range(13)], "query_id long, term string, weight double")
    found = postings._looked_up(pairs, asked, blocks)
    assert found.count() == found.select("query_id", "item_id").distinct().count() == 40
