"""Line dedup, MinHash and components against brute force."""

import hashlib
import random
import tempfile
from pathlib import Path

import pytest

from fiscolake.llm import lines, minhash
from fiscolake.llm.components import components
from fiscolake.session import written_table

SCHEMA = "doc_id long, text string, removed string, kept string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 0.5) for i, t in rows], SCHEMA)


def words(draw, n, size=400):
    return [f"w{draw.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies of lines and of whole texts, empty ones, one long text, repeated rows."""
    draw = random.Random(3)
    base = [" ".join(words(draw, 40)) for _ in range(12)]
    rows = []
    for i in range(60):
        some = []
        for _ in range(draw.randrange(1, 6)):
            line = draw.choice(base).split() if draw.random() < 0.6 else words(draw, draw.randrange(1, 50))
            for _ in range(draw.randrange(0, 6)):
                line[draw.randrange(len(line))] = f"n{draw.randrange(10_000)}"
            some.append(draw.choice((" ", "  ", " \t")).join(line))
        rows.append((i, "\n".join(some)))
    for i in range(60, 80):
        text = draw.choice(rows[:60])[1].split(" ")
        if i % 3:
            text[draw.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text)))
    rows += [(80, ""), (81, None), (82, " \t "), (83, "one"), (84, "ONE"), (85, "\n".join(" ".join(words(draw, 30, 10**6)) for _ in range(400))),
             (None, rows[0][1]), (None, None), rows[5], rows[5]]
    return rows


def token_set(line):
    return {w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w}


def twin(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def expected_lines(rows):
    """Positions that go, by (doc_id, text): all lines with words against all earlier ones."""
    found = sorted({(i, twin(t), p, t, line) for i, t in rows if i is not None and t is not None
                    for p, line in enumerate(t.split("\n")) if token_set(line)})
    sets = [token_set(line) for *_, line in found]
    gone = {}
    for k, (i, _, p, t, _) in enumerate(found):
        if any(100 * len(sets[k] & its) >= 80 * len(sets[k] | its) for its in sets[:k]):
            gone.setdefault((i, t), set()).add(p)
    return gone


def removed(spark, rows):
    texts = {(i, twin(t)): (i, t) for i, t in rows if i is not None and t is not None}
    return {texts[r.doc, r.twin]: set(r.removed) for r in lines.removed_lines(frame(spark, rows)).collect()}


def test_lines_match_brute_force(spark, corpus):
    assert removed(spark, corpus) == expected_lines(corpus)


def test_short_lines_and_unlike_texts_of_one_id(spark):
    rows = [(1, "Les.\n\nLes."), (2, "Les.\none two three four"), (3, "four three two one\n \t\none two three four five"),
            (4, "a text of this row alone, quite long"), (4, "Les."), (4, "another text of the row, not as long"), (4, "Les."),
            (5, "one two three\nthree two\tone\none two six"), (6, "a  b\rb"), (7, "b a\nab"), (8, "\n\n")]
    assert removed(spark, rows) == expected_lines(rows)
    assert removed(spark, rows)[4, "Les."] == {0} and (4, rows[3][1]) not in removed(spark, rows)
    out = lines.stage(spark, frame(spark, rows), "").collect()
    assert sorted(r.text for r in out if r.doc_id == 4) == sorted(rows[k][1] for k in (3, 5))
    assert [r.text for r in out if r.doc_id == 8] == ["\n\n"]


def test_long_unlike_lines_that_share_a_rare_word_make_no_pairs(spark):
    draw = random.Random(17)
    one = words(draw, 240, 10**6)
    near = [*one[:-20], *words(draw, 20, 10**6)]
    rows = [(i, " ".join(["rare", *line])) for i, line in enumerate([one, near, *(words(draw, 240, 10**6) for _ in range(30))])]
    docs = frame(spark, rows).selectExpr("doc_id AS doc", "0L AS twin", "text")
    table = lines.line_table(docs, 80).drop("prefix", "h1", "h2")
    a, b = (lines._side(table, s) for s in "ab")
    pairs = a.join(b, (a.doc_a < b.doc_b) & lines._alike(80)).select("doc_a", "doc_b").collect()
    assert [tuple(p) for p in pairs] == [(0, 1)]


def test_parts_hold_every_posting_once(spark):
    flagged = spark.createDataFrame([(1, 0, 0, 30, 5, None, None, None, list(range(7)), -1)],
                                    "doc long, twin long, pos int, n int, map long, map1 long, map2 long, map3 long, "
                                    "prefix array<long>, sign int")
    parts = [[(r.at, r.token) for r in lines.postings(flagged, k).collect()] for k in range(lines.PARTS)]
    assert sorted(sum(parts, [])) == sorted((-t - 1, t) for t in range(7)) and all(len(p) < 7 for p in parts)


def test_a_written_table_leaves_no_shuffle_files(spark):
    def shuffled():
        return set(Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data"))

    before = shuffled()
    table = written_table(spark.range(1000).repartition(4, "id"), "kept")
    assert not shuffled() - before and table.count() == 1000


def test_line_stage_carries_columns_of_any_name(spark):
    names = ("doc_id", "text", "line_doc", "LINE_removed", "__id", "twin", "pos")
    docs = spark.createDataFrame([(1, "one two\nthree", *"abcde"), (2, "three", *"abcde"), (3, "four", *"abcde")],
                                 ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = lines.stage(spark, docs, "")
    assert out.columns == list(names) and sorted(r.text for r in out.collect()) == ["four", "one two\nthree"]


def test_line_stage_keeps_columns_and_rows_without_id(spark, corpus):
    docs = frame(spark, corpus).withColumnRenamed("score", "n_chars")
    out = lines.stage(spark, docs, "")
    assert out.columns == docs.columns
    gone = expected_lines(corpus)
    want = []
    for i, t in corpus:
        kept = [line for p, line in enumerate((t or "").split("\n")) if p not in gone.get((i, t), ())]
        if kept:
            want.append((i, None if t is None else "\n".join(kept)))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_a_line_most_rows_share(spark):
    rows = [(i, "the same line in very many rows here\nown line number %d of this text alone" % i) for i in range(300)]
    got = {i: positions for (i, _), positions in removed(spark, rows).items()}
    assert all(0 in got[i] for i in range(1, 300)) and 0 not in got


def expected_components(rows, size, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if None not in (i, j) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    return [(i, len(s), None if i is None else top(i)) for (i, _), s in zip(rows, sets)]


@pytest.mark.parametrize("size,percent,bands", [(3, 85, 25), (5, 80, 40)])
def test_near_duplicates_match_brute_force(spark, corpus, size, percent, bands):
    out = minhash.near_duplicates(frame(spark, corpus), words=size, percent=percent, bands=bands).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    assert got == sorted(expected_components(corpus, size, percent), key=str)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)


def test_near_duplicate_stage_keeps_one_of_each_group(spark, corpus):
    out = minhash.stage(spark, frame(spark, corpus), "").collect()
    want = {c for i, _, c in expected_components(corpus, 5, 80) if i is not None}
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in out) == 2


def test_signatures_of_unrelated_texts_differ_in_half_of_their_bits(spark):
    draw = random.Random(4)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(n)) for n in (30, 300, 3000, 3001)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.signature for r in minhash.signatures(docs, 3, 25).collect()}
    for a in rows:
        for b in rows:
            apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(rows[a], rows[b]))
            assert apart == 0 if a == b else 400 < apart < 624


def test_stage_keeps_the_same_row_of_a_repeated_id(spark):
    rows = [(1, "one two three four five six", "x"), (1, "quite another text of other words", "y"), (1, None, "z")]
    kept = [minhash.stage(spark, spark.createDataFrame(order, "doc_id long, text string, row string"), "").collect()
            for order in (rows, rows[::-1])]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_a_large_group_round_a_centre_that_is_not_its_smallest(spark):
    """Copies of one text that are closer to it than to one another, and whose smallest id is a far copy."""
    draw = random.Random(8)
    base = words(draw, 200, 10**6)
    rows = []
    for i in range(80):
        text = list(base)
        for k in draw.sample(range(200), 4 if i != 50 else 0):
            text[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(text)))
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(expected_components(rows, 3, 85))


def test_groups_whose_copies_differ_from_one_another_by_shared_and_own_changes(spark):
    """Chains of links beside copies that are linked with nothing: some changes are those of many copies, some of one."""
    draw = random.Random(9)
    base = words(draw, 120, 10**6)
    rows = []
    for i in range(120):
        text = list(base)
        for k in range(i % 8):
            text[k * 13] = f"both{k}"
        for k in draw.sample(range(120), i % 5):
            text[k] = f"own{i}x{k}"
        rows.append((i, " ".join(text)))
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    want = expected_components(rows, 3, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(want)
    assert 3 < len({c for *_, c in want}) < 110


def test_a_pair_leaves_the_join_of_buckets_once(spark):
    rows = [(k, d, d, 100, [0] * 32, 100, [3, 4, 5, d + 10]) for d in range(4) for k in (3, 4, 5)]
    members = spark.createDataFrame(rows, "key long, doc_id long, component long, n_shingles long, signature array<long>, "
                                          "common long, keys array<long>")
    pairs = sorted(tuple(r) for r in minhash.pairs_across(members, 85).collect())
    assert pairs == [(a, b) for a in range(4) for b in range(a + 1, 4)]


def test_nothing_in_nothing_out(spark):
    empty = frame(spark, [])
    assert lines.removed_lines(empty).count() == 0
    assert lines.stage(spark, empty, "").count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.stage(spark, empty, "").count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (3, 2), (2, 3), (200, -5)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, 200: -5, -5: -5}
