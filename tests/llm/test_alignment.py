"""Cross-tokenizer alignment against a plain double loop over tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fiscolake.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files():
    """The files read by their own libraries, token bytes by the libraries' own decoding of the signs."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)


def spans(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(rows, files):
    a_file, b_file = files
    signs = alignment.byte_of_sign()
    docs = []
    for i, text in rows:
        a, b = [], []
        if text:
            whole = (" " + text).encode()
            a = [(t, bytes(signs[s] for s in a_file.id_to_token(t))) for t in a_file.encode(" " + text, add_special_tokens=False).ids]
            b = [(t, bytes([int(p[3:5], 16)]) if b_file.is_byte(t) else p.replace("▁", " ").encode())
                 for t, p in ((t, b_file.id_to_piece(t)) for t in b_file.encode(text))]
            if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
                a, b = [], []
        a, b = spans(a), spans(b)
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        ends, groups, start = sorted({e for _, _, e in a} & {e for _, _, e in b}), [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x) for x, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        docs.append((i, len(a), len(b), groups, links))
    counts = Counter(link for d in docs for link in d[4])
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return counts, [(i, n_a, n_b, len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                     hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n_a, n_b, g, links in docs]


def tuples(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(11)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    texts = [(r.doc_id, r.text[:1500]) for r in given]
    signs = "aeiou  .,\n\t0123é߀漢字🙂 ▁'\r\x00_-"
    texts += [(1000 + i, "".join(draw.choice(signs) for _ in range(draw.randrange(1, 60)))) for i in range(150)]
    texts += [(2000, ""), (2001, None), (None, "no id"), (2002, "<|endoftext|> <s> </s> <unk> <0x41>"), (2003, " two  blanks "),
              (2004, "▁"), (2005, "é ﬁ Ω"), texts[0], texts[0], (2 ** 60 + 1, "long id"), (2006, "a" * 3000)]
    return texts


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, pair long, shard string")


def test_equals_brute_force(spark, rows, files):
    counts, want = brute(rows, files)
    assert tuples(alignment.aligned(frame(spark, rows))) == sorted(want, key=str)
    table = alignment.pair_counts(frame(spark, rows)).collect()
    assert {(r.a_id, r.b_id): r.n for r in table} == counts and len(table) == len(counts)


def test_pieces_and_rounds_change_nothing(spark, rows, files):
    _, want = brute(rows, files)
    small = {"shard_pairs": 300, "shards_per_piece": 2}
    assert tuples(alignment.aligned(frame(spark, rows), **small)) == sorted(want, key=str)


def test_empty_table(spark):
    assert alignment.aligned(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert tuples(alignment.aligned(frame(spark, [(1, None), (2, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_ids_are_those_of_the_files_library(spark, files):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    tokens = alignment.tokenizers(alignment.A_PATH, alignment.B_PATH)
    assert [tokens.a.encode_ordinary(" " + t) for t in texts] == [
        e.ids for e in files[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 70_000])
def test_hash_is_minimal_and_verified(n):
    keys = np.random.default_rng(n).choice(2 ** 31, n, replace=False).astype(np.int64) * 2
    built = alignment.PerfectHash.build(keys)
    assert sorted(built(keys).tolist()) == list(range(n))
    assert (built.keys[built(keys)] == keys).all()
    assert (built(keys + 1) == -1).all()


def test_tree_sum(spark):
    vectors = spark.range(2500).selectExpr("id % 2 shard", "cast(id as int) node").rdd.map(
        lambda r: (r.shard, r.node, bytearray(np.array([r.node, 1], np.int64).tobytes()))).toDF("shard long, node int, counts binary")
    sums = {r.shard: np.frombuffer(r.counts, np.int64).tolist() for r in alignment.tree_sum(vectors).collect()}
    assert sums == {0: [sum(range(0, 2500, 2)), 1250], 1: [sum(range(1, 2500, 2)), 1250]}
