"""Toxicity, suffix tree, decontamination, mixing, page text, urls, MaxScore and token counts."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fiscolake.llm import decontaminate, lengths, maxscore, mixing, page_text, suffix_tree, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, leaks string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}", 0, "x", "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    rows = []
    for i in range(400):
        w = [f"{draw.choice('abcdefgh')}{draw.choice('klmnop')}{draw.randrange(30)}x" for _ in range(draw.randrange(20, 90))]
        w = ["word" + x for x in w]
        if i % 5 == 0:
            for _ in range(3):
                w.insert(draw.randrange(len(w)), draw.choice(("scumlike", "scumface", "scumbucket", "idiot", "moron")))
        rows.append((i, " ".join(w)))
    return rows + [(400, ""), (401, None), (402, "scumlord " * 3000), (None, "no id"), rows[0], rows[0]]


def test_toxicity_learns_words_and_stems(spark, texts):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (3, None), (1, 7)], "doc_id long, toxic int")
    docs = frame(spark, texts)
    model = toxicity.train(docs, labels)
    out = {(r.doc_id, r.text): r.p for r in docs.withColumn("p", toxicity.score(spark, model)("text")).collect()}
    held = [(k, p) for k, p in out.items() if k[0] is not None and k[0] < 400 and zlib.crc32(str(k[0]).encode()) % 4 == 2]
    assert np.mean([(p >= 0.3) == (k[0] % 5 == 0) for k, p in held]) > 0.95
    assert out[(402, "scumlord " * 3000)] > 0.3 > out[(400, "")] == out[(401, None)]


def test_toxicity_without_labels_scores_nothing(spark, texts):
    model = toxicity.train(frame(spark, texts), spark.createDataFrame([], "doc_id long, toxic int"))
    assert frame(spark, texts).select(F.max(toxicity.score(spark, model)("text"))).first()[0] == 0.0


def test_suffix_tree_base_is_exact(spark, texts):
    rows = suffix_tree.scored(frame(spark, texts)).collect()
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in texts]
    counts = Counter()
    for (i, _), words in zip(texts, tokens):
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))
                  for (i, _), w in zip(texts, tokens))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n}


def test_suffix_tree_gains_where_words_follow_one_another(spark):
    """Two tongues with words of their own: what came before tells which tongue comes next."""
    draw = random.Random(6)
    rows = [(i, " ".join(f"{'uv'[i % 2]}{draw.randrange(60)}" for _ in range(60))) for i in range(300)]
    held = [r for r in suffix_tree.scored(frame(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_suffix_tree_keeps_rare_contexts(spark):
    """Words of less than 1 / 4096 of the tokens, each of which tells the next."""
    draw = random.Random(7)
    names = ["".join(draw.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(6000)]
    pairs = [f"{a} {b}" for a, b in zip(names[::2], names[1::2])] * 8
    draw.shuffle(pairs)
    rows = [(i, " ".join(pairs[20 * i:20 * i + 20])) for i in range(len(pairs) // 20)]
    held = [r for r in suffix_tree.scored(frame(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.5 * sum(r.n_tokens for r in held)


def test_suffix_tree_grows_as_deep_as_contexts_tell_more(spark):
    """The last of four words follows from the first, which only a context of three words holds."""
    draw = random.Random(8)
    rows = [(i, " ".join(f"x{k} c c y{k}" for k in (draw.randrange(8) for _ in range(20)))) for i in range(300)]
    held = [r for r in suffix_tree.scored(frame(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in held) > -1.2 * 20 * len(held)


def test_suffix_tree_probabilities_add_up(spark):
    draw = random.Random(6)
    texts = [(i, " ".join(f"{'uv'[i % 2]}{draw.randrange(20)}" for _ in range(60))) for i in range(200)]
    docs = frame(spark, texts).select("text", F.lit(0).cast("long").alias("block"), F.lit(False).alias("held_out"))
    counts = suffix_tree.block_words(docs).groupBy("word").agg(F.sum("c").alias("c"))
    tree = suffix_tree.fit(docs, counts, alphabet=64, pairs=64)
    assert tree.frequent and len(tree.keys[0])
    for first in (0, 1, tree.symbols - 1):
        every = [tree.probabilities(np.array([first, s]))[1] for s in range(tree.symbols)]
        assert abs(sum(every) - 1) < 1e-9
        every = [tree.probabilities(np.array([first, 1, s]))[2] for s in range(tree.symbols)]
        assert abs(sum(every) - 1) < 1e-9


def repeating():
    """Passages that come back in other texts, some of them often, between words of their own."""
    draw = random.Random(9)
    passages = [[f"w{draw.randrange(400)}" for _ in range(9)] for _ in range(40)]
    rows = [(i, " ".join(w for _ in range(6) for w in (*draw.choice(passages), *(f"n{draw.randrange(3000)}" for _ in range(4)), "the")))
            for i in range(250)]
    return rows + [(400, ""), (401, None), (402, "the the " * 500), (None, "no id the w1 w2"), rows[0], rows[0]]


def scored_by_dictionaries(rows, tree, evidence=2, strength=20.0):
    """Scores by (id, tokens), with all runs of words in dictionaries."""
    texts = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    trained = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    counts = Counter(w for words, t in zip(texts, trained) if t for w in words)
    number = {**tree.frequent, b"\n": tree.symbols - 1}

    def symbol(w):
        return number.get(w, len(tree.frequent) + suffix_tree.class_of(w))

    def within(w):
        return 1.0 if w in number else (counts[w] + 1) / tree.class_total[suffix_tree.class_of(w)]

    s = [np.array([symbol(w) for w in words]) for words in texts]
    share = [np.array([within(w) for w in words]) for words in texts]
    p = [tree.root[a] * b for a, b in zip(s, share)]
    some = [np.zeros(len(a), bool) for a in s]
    alive, depth = {(k, i) for k, words in enumerate(texts) for i in range(len(words))}, 0
    while alive:
        depth += 1
        cells, sizes, gains = Counter(), Counter(), Counter()
        alive = {(k, i) for k, i in alive if i >= depth}
        for k, i in alive:
            if trained[k]:
                cells[tuple(texts[k][i - depth:i + 1])] += 1
                sizes[tuple(texts[k][i - depth:i])] += 1
        at = {tuple(texts[k][i - depth:i + 1]): p[k][i] for k, i in alive}
        for run, n in cells.items():
            predicted = (n - 1 + strength * at[run]) / (sizes[run[:-1]] - 1 + strength)
            gains[run[:-1]] += n * math.log(predicted / at[run])
        alive = {(k, i) for k, i in alive if sizes[c := tuple(texts[k][i - depth:i])] >= evidence and gains[c] > math.log(sizes[c])}
        for k, i in alive:
            run = tuple(texts[k][i - depth:i + 1])
            p[k][i] = (cells[run] + strength * p[k][i]) / (sizes[run[:-1]] + strength)
            some[k][i] = True
    out = [np.log10(np.where(c, a, tree.probabilities(x) * b)).sum() for a, b, c, x in zip(p, share, some, s)]
    return sorted((str(i), len(words), round(v, 6)) for (i, _), words, v in zip(rows, texts, out)), depth


def test_suffix_tree_is_that_of_dictionaries(spark):
    """Also where contexts lie in many parts and frequent ones are dealt out by their runs."""
    rows = repeating()
    docs = frame(spark, rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    blocks = docs.select("text", F.lit(0).cast("long").alias("block"), held.alias("held_out"))
    counts = suffix_tree.block_words(blocks).groupBy("word").agg(F.sum("c").alias("c"))
    want, depth = scored_by_dictionaries(rows, suffix_tree.fit(blocks, counts))
    assert depth > 3
    for settings in ({}, {"part": 40}):
        got = suffix_tree.scored(docs, **settings).collect()
        assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in got) == want


def test_suffix_tree_keeps_few_bytes(spark):
    """What stays in the shared folder is little beside the texts."""
    draw = random.Random(10)
    rows = [(i, " ".join(f"{draw.randrange(20000)}x{draw.randrange(9)}" for _ in range(400))) for i in range(600)]
    shared = Path(spark.conf.get("spark.checkpoint.dir"))

    def size():
        return sum(f.stat().st_size for f in shared.rglob("*.parquet"))

    before = size()
    assert suffix_tree.scored(frame(spark, rows)).count() == 600
    assert size() - before < 2.5 * sum(len(t) for _, t in rows)


def test_suffix_tree_of_nothing(spark):
    assert suffix_tree.scored(frame(spark, [])).count() == 0
    row = suffix_tree.scored(frame(spark, [(2, None)])).first()
    assert row.n_tokens == 1


def leaked(spark, docs, items, columns="item_id long, text string"):
    found = decontaminate.searches(docs, spark.createDataFrame(items, columns))
    return {r.doc_id: {x.item_id for x in r.l} for r in
            docs.select("doc_id", decontaminate.leaks(spark, found, F.col("text")).alias("l")).collect()}


def test_decontamination_finds_planted_and_changed_items(spark, texts):
    draw = random.Random(9)
    items = [(k, " ".join(f"item{draw.randrange(500)}" for _ in range(draw.randrange(9, 60))) + ". " + f"answer{k} is right here.")
             for k in range(30)] + [(30, None), (31, ""), (32, "too short"), (0, "repeated id " * 5)]
    rows, want = list(texts), {}
    for k in range(30):
        i = 10 * k + 1
        words = items[k][1].split()
        if k % 3 == 1:  # some words replaced
            for j in draw.sample(range(len(words) - 4), len(words) // 8):
                words[j] = "other"
        cut = draw.randrange(20)
        rows[i] = (i, " ".join(rows[i][1].split()[:cut] + words + rows[i][1].split()[cut:]).upper())
        want[i] = {k}
    got = leaked(spark, frame(spark, rows), items)
    found = sum(want[i] <= got[i] for i in want)
    assert found >= 0.95 * len(want)
    assert not any(v for i, v in got.items() if i not in want)


@pytest.mark.parametrize("scale", [1, 1000])
def test_items_are_found_whatever_the_size_of_the_corpus(spark, monkeypatch, scale):
    """Items just above a window class, a third of whose window is foreign, in a corpus that holds their words often."""
    draw = random.Random(4)
    common = [f"common{k}" for k in range(300)]
    rows = [(i, " ".join(draw.choice(common) if draw.random() < 0.7 else f"rare{draw.randrange(3000)}" for _ in range(150)))
            for i in range(200)]
    items = [(k, " ".join(draw.sample(common, (13, 19, 28, 41)[k % 4]))) for k in range(12)]
    for k, text in items:
        around = [f"foreign{k}x{j}" for j in range(120)]
        rows.append((1000 + k, " ".join(around[:50 + k] + text.split() + around[50 + k:])))
    counted = decontaminate._frequencies

    def scaled(*args):
        df, passages, documents = counted(*args)
        return df * scale, passages * scale, documents

    monkeypatch.setattr(decontaminate, "_frequencies", scaled)
    got = leaked(spark, frame(spark, rows), items)
    assert {i: v for i, v in got.items() if v} == {1000 + k: {k} for k, _ in items}


def test_the_latent_space_is_fitted_on_every_passage(spark):
    """More documents than a sample would hold; the matrix in one slab, and in slabs of a few words."""
    draw = random.Random(3)
    texts = [(i, " ".join(f"w{draw.randrange(60)}" for _ in range(draw.randrange(40)))) for i in range(2500)] + [(9000, None), (9001, "")]
    vocabulary, idf = {b"w%d" % k: k for k in range(40)}, np.linspace(0.5, 3, 40)
    want, holding = np.zeros((40, 40)), 0
    for _, text in texts:
        words = text.split() if text else []
        for at in range(0, len(words), 16):
            ids = [int(w[1:]) for w in words[at:at + 16] if int(w[1:]) < 40]
            if ids:
                row = np.bincount(ids, minlength=40) * idf
                row /= np.linalg.norm(row)
                want += np.outer(row, row)
                holding += 1
    known = decontaminate._known_words(frame(spark, texts).repartition(3), vocabulary, 16)
    assert decontaminate._frequencies(known, 40)[2] == holding
    for cells in (1 << 20, 300):
        got = np.zeros((40, 40))
        for r in decontaminate.gram_rows(known, idf, cells).collect():
            assert min(r.others) >= r.word
            got[r.word, r.others] = r.sums
        assert np.allclose(got, np.triu(want), rtol=1e-4, atol=1e-4)
    gram = decontaminate.gram_rows(known, idf)
    top = decontaminate.randomised_svd(gram, [], 40, 40)
    assert np.allclose(top.T @ want @ top, np.diag(np.linalg.eigvalsh(want)[::-1]), atol=0.05)


def test_a_paraphrase_needs_its_answer(spark, texts):
    item = " ".join(f"q{k}" for k in range(30))
    half = " ".join(f"q{k}" if k % 5 < 3 else f"z{k}" for k in range(30))
    rows = [(i, t) for i, t in texts if i not in (1, 2)] + [(1, f"{half} the answer stands"), (2, half)]
    docs = frame(spark, rows)
    got = leaked(spark, docs, [(7, item, "the answer stands")], "item_id long, text string, answer string")
    assert {i: v for i, v in got.items() if v} == {1: {7}}


def test_decontamination_of_nothing(spark, texts):
    assert leaked(spark, frame(spark, []), [(1, "w " * 20)]) == {}
    assert not any(leaked(spark, frame(spark, texts[:20]), []).values())


def test_words_of_many_texts_are_numbered_at_once():
    odd = ["", None, "  A b\tB\u00a0 c ", "\x0b\x0c\r\n", "b\x00 b\x85b \x1cb \u0130B B", "a"]
    known = {b"a": 0, b"b": 2, "b\u00a0".encode(): 1}
    ids, lengths = decontaminate.word_numbers(pa.array(odd, pa.string()), decontaminate.vocabulary_array(known))
    words = [decontaminate.byte_words(t) for t in odd]
    assert lengths.tolist() == [len(w) for w in words]
    assert ids.tolist() == [known.get(w, -1) for ws in words for w in ws]


def test_texts_searched_together_leak_what_each_leaks_alone(spark, texts, monkeypatch):
    draw = random.Random(4)
    items = [(k, " ".join(f"item{draw.randrange(300)}" for _ in range(draw.randrange(9, 60)))) for k in range(40)]
    rows = [(i, t if i is None or i % 7 or not t else f"{t} {items[i % 40][1]}") for i, t in texts]
    bench = spark.createDataFrame(items, "item_id long, text string")
    search, = decontaminate.searches(frame(spark, rows), bench)
    alone = [search.leaks(pa.array([t], pa.string()))[0] for _, t in rows]
    assert sum(map(bool, alone)) > 40
    for size in (decontaminate.GROUP_BYTES, 3000):
        monkeypatch.setattr(decontaminate, "GROUP_BYTES", size)
        together = search.leaks(pa.array([t for _, t in rows], pa.string()))
        assert [[x["item_id"] for x in found] for found in together] == [[x["item_id"] for x in found] for found in alone]


def test_subsequences_match_the_table(spark):
    draw = random.Random(2)
    for _ in range(50):
        a, b = ([draw.choice((b"a", b"b", b"c")) for _ in range(draw.randrange(1, 15))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_words(a, b) == t[-1, -1]


def test_raking_meets_the_margins_and_the_budget(spark, texts):
    out = mixing.with_probabilities(frame(spark, texts), topic=F.when(F.col("doc_id") % 5 == 0, "fifth"), budget=0.4).toPandas()
    assert len(out) == len(texts)
    total = out.tokens.sum()
    for margin in ("source", "lang", "topic"):
        by = out.assign(key=out[margin].astype(object).where(out[margin].notna(), "none"), mass=out.tokens * out.weight / total).groupby("key")
        goal = by.tokens.sum() ** 0.5
        assert np.allclose(by.mass.sum(), goal / goal.sum(), atol=1e-6)
    assert abs((out.tokens * out.probability).sum() / total - 0.4) < 1e-4
    repeated = out[out.doc_id == 0]
    assert len(repeated) == 3 and repeated.kept.nunique() == 1


def test_raking_to_given_targets_and_of_nothing(spark, texts):
    out = mixing.with_probabilities(frame(spark, texts), topic=F.lit("t"), targets={"lang": {"en": 0.9, None: 0.1}}).toPandas()
    share = (out.tokens * out.weight)[out.lang.isna()].sum() / (out.tokens * out.weight).sum()
    assert abs(share - 0.1) < 1e-6
    assert mixing.with_probabilities(frame(spark, [])).count() == 0
    staged = mixing.stage(spark, frame(spark, texts).withColumn("mixing_weight", F.lit(1)), "")
    assert staged.columns[-1] == "_mixing_weight" and 0 < staged.count() < len(texts)
    assert mixing.stage(spark, frame(spark, []), "").count() == 0
    clashing = frame(spark, texts).withColumns({c: F.lit(1) for c in ("cell_source", "__weight", "__lang", "CELL_weight")})
    assert mixing.stage(spark, clashing, "").columns == [*clashing.columns, "mixing_weight"]


def test_raking_shuffles_nothing_once_cells_lie_by_source(spark, texts):
    weighed = mixing.rake(mixing.cells_of(mixing.measured(frame(spark, texts), F.lit("t"))))
    assert "Exchange" not in weighed._jdf.queryExecution().executedPlan().toString()
    given = mixing.rake(mixing.cells_of(mixing.measured(frame(spark, texts), F.lit("t"))), {"source": {"s1": 3, "s2": 1}}).toPandas()
    mass = (given.tokens * given.weight).groupby(given.source).sum()
    assert set(mass.index) == {"s1", "s2"} and np.isclose(mass["s1"] / mass.sum(), 0.75)


def test_page_field_on_pages_it_has_not_seen():
    field = page_text.train(page_text.labelled_pages(160, seed=1))
    right = total = 0
    for found, labels in page_text.labelled_pages(60, seed=2):
        right += sum(a == b for a, b in zip(field.decode(found), labels))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_matches_all_labellings():
    field = page_text.Field({"bias": 0.3, "links:3": -2.0, "in:p": 1.0}, np.array([[0.4, -0.7], [-0.2, 0.9]]))
    found = [page_text.Block(" p" if k % 3 else " div", "text" * (k + 1), 0 if k % 2 else 4 * (k + 1)) for k in range(8)]
    lean = [field.lean(b) for b in found]

    def value(bits):
        return sum(lean[k] * bits[k] for k in range(8)) + sum(field.follow[a, b] for a, b in zip(bits, bits[1:]))

    best = max(([m >> k & 1 for k in range(8)] for m in range(256)), key=value)
    assert field.decode(found) == best


def test_blocks_of_broken_pages():
    page = "<body><p>one &amp; two<br>three<b>four<p>five&nbsp; six<li><a href='x>y'>seven</a><script>var a='</p>'</script><p"
    assert [b.text for b in page_text.blocks(page)] == ["one & two threefour", "five six", "seven"]
    assert page_text.blocks(None) == page_text.blocks("") == page_text.blocks("<!-- only") == []
    assert page_text.Field().text(None) == ""


def test_blocks_after_elements_closed_in_their_own_tag_and_odd_quotes():
    page = ("<svg class='i'/><p>one</p><iframe src=\"x\" /><p title=don't>two</p><p title=\"a > b\">three</p>"
            "<svg><text>no</text></svg><p data-x='it\"s'>four <select><option>no</select></p><svg-box>five</svg-box>")
    assert [b.text for b in page_text.blocks(page)] == ["one", "two", "three", "four", "five"]
    assert [b.text for b in page_text.blocks("<p title=\"open>one</p>")] == ["one"]


def test_page_text_of_plain_containers_and_repeated_rows(spark):
    main_text = page_text.extract(spark, page_text.train(page_text.labelled_pages()))
    body = "<p>The first paragraph of a text that says something, and goes on.</p>"
    rows = [(1, f"<html><body><div id='page'>{body}</div></body></html>"), (2, f"<body>{body}{body}</body>"), (3, None), (3, ""), (3, ""),
            (4, "<article>" + body * 3000 + "</article>"), (5, f"<div><svg/><h1>Some title</h1>{body}</div><footer>&copy; none</footer>")]
    pages = spark.createDataFrame([(i, h, "x") for i, h in rows], "page_id long, html string, text string")
    out = sorted((r.page_id, r.t) for r in pages.select("page_id", main_text("html").alias("t")).collect())
    plain = body[3:-4]
    assert out == [(1, plain), (2, f"{plain}\n{plain}"), (3, ""), (3, ""), (3, ""), (4, "\n".join([plain] * 3000)),
                   (5, f"Some title\n{plain}")]
    assert pages.limit(0).select(main_text("html")).count() == 0


def test_url_parts_rules_and_verdicts(spark):
    rows = [(1, "HTTP://WWW.Example.com/en/1?x#y"), (2, "http://a.example.com/en/2"), (3, "https://example.com/de"), (4, "http://x.net/es/1"),
            (5, "http://notexample.com"), (6, None), (7, "no scheme"), (8, "http://free-casino-win.example.org/en/1"),
            (9, "http://blog.history-books.example.org/en/1"), (10, "://h?/p"), (None, "http://x.net/fr/" + "a" * 5000), (4, "http://x.net/es/1")]
    pages = spark.createDataFrame([(i, u, 1) for i, u in rows], "page_id long, url string, host int")
    out = urls.judged(pages, urls.train(spark)).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == len(rows)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (by[2].rule, by[2].verdict) == ("example.com/en/", "block") and by[3].rule == "com/"
    assert by[4].rule == "net/es/" and by[5].rule is None and by[None].rule == "net/fr/"
    assert (by[6].host, by[6].path, by[6].verdict) == ("", "", "allow") and by[7].host == ""
    assert by[8].verdict == "block" and by[9].verdict == "allow" and by[10].host == "h"
    assert urls.judged(pages.limit(0), urls.train(spark)).count() == 0


def test_maxscore_matches_all_products(spark):
    draw = np.random.default_rng(4)
    v = draw.integers(-300, 300, (700, 12))
    v[5] = v[6] = v[7]
    items = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)] + [(3, v[3].tolist())], "id long, v array<long>")
    got = maxscore.top_k(items.filter("id % 50 = 5"), items, 6, query_rows=4, item_rows=100).collect()
    want = []
    for q in range(5, 700, 50):
        scores = sorted(((-int(v[q] @ v[i]), i) for i in [*range(700), 3] if i != q))[:6]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_maxscore_gives_each_row_of_a_repeated_query_its_own_list(spark):
    items = spark.createDataFrame([(0, [1, 2])] * 3 + [(0, [-1, 0])] + [(i, [i, -i]) for i in range(1, 9)], "id long, v array<long>")
    got = maxscore.top_k(items.filter("id = 0"), items, 4, query_rows=2, item_rows=3).collect()
    want = 3 * [(0, k + 1, k + 1, -k - 1) for k in range(4)] + [(0, k + 1, k + 1, -k - 1) for k in range(4)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert maxscore.top_k(items.limit(0), items, 4).count() == 0


def test_maxscore_leaves_out_broken_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.5, float("nan")]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [-0.0001, 1.0])]
    v = maxscore.quantised(spark.createDataFrame([(i, x, 9) for i, x in rows], "vec_id long, embedding array<float>, id int"))
    assert sorted((r.id, r.v) for r in v.collect()) == [(0, [1024, 512]), (5, [-1, 1024])]
    assert maxscore.top_k(v, v.limit(0), 3).count() == 0


def test_lengths_are_the_tokenizers_and_sums_are_exact(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    odd = [(500, "don't  stop\n\n \tnow 123 <|endoftext|> çé漢字🙂  "), (501, "I'M we'll\r\n x")]
    rows = texts + odd
    want = Counter(len(whole.encode(t, add_special_tokens=False).ids) if t else 0 for _, t in rows)
    sums = lengths.suffix_sums(lengths.histogram(frame(spark, rows)))
    got = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.docs for k, r in got.items()} == dict(want)
    for k, r in got.items():
        assert r.docs_from == sum(n for x, n in want.items() if x >= k)
        assert r.tokens_from == sum(n * x for x, n in want.items() if x >= k)
        assert r.truncated_total == sum(n * min(x, k) for x, n in want.items())
    for r in lengths.totals(sums, [0, 17, 200, 10**6]).collect():
        assert r.truncated_total == sum(n * min(x, r.context) for x, n in want.items())
        assert r.docs_over == sum(n for x, n in want.items() if x > r.context)
    flat = sorted(want.elements())
    for r in lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == flat[math.ceil(r.share * len(flat) - 1e-9) - 1]
    assert lengths.suffix_sums(lengths.histogram(frame(spark, []))).count() == 0
