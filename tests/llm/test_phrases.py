"""Collocations against a plain count of all runs of words."""

import random
import re
from collections import Counter, defaultdict

import pytest

from checks.compare import connect, difference
from fiscolake.llm import phrases


def brute(rows, least, kept, depth=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(depth, len(words) - i) + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    inside = defaultdict(int)
    for (lang, w), a in f.items():
        if a >= least:
            for s in range(2, len(w)):
                for i in range(len(w) - s + 1):
                    inside[lang, w[i:i + s]] = max(inside[lang, w[i:i + s]], a)
    found = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least and 100 * inside[lang, w] < 100 * a:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, each in found.items()
                  for rank, (score, a, p, l, r) in enumerate(sorted(each)[:kept], 1))


def frame(spark, rows):
    return spark.createDataFrame([(None, t, lang, 3, "x") for lang, t in rows], "doc_id long, text string, lang string, n long, phrase string")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(12)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyz"] + ["THE", "of", "The", "\x01", "\x00", "a\x00b", "a\x00c", " ", "ß", "it's"]
    weights = [1] * 15 + [20, 15, 5, 1, 1, 9, 9, 1, 1, 1]
    phrases_ = ["New York City", "in spite of the", "a b c d e f g"]
    out = []
    for i in range(300):
        w = draw.choices(words, weights, k=draw.randrange(60))
        for _ in range(3):
            w.insert(draw.randrange(len(w) + 1), draw.choice(phrases_))
        signs = draw.choices([" ", "  ", "\t", ", ", ".", "\n", "; ", "\x0b", "!", " ? "], [30, 2, 2, 2, 1, 1, 1, 1, 1, 1], k=len(w))
        out.append((draw.choice(["en", "en", "en", "fr", None, "und", ""]), "".join(x for p in zip(w, signs) for x in p)))
    return out + [("en", None), ("en", ""), (None, None), ("de", "nur einmal"), ("en", "the " * 3000), ("en", "New York " * 2000), out[0], out[0]]


@pytest.mark.parametrize("budget", [16 << 20, 20_000, 300, 1])
def test_equals_brute_force(spark, rows, budget):
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), least=4, kept=50, budget=budget).collect())
    assert got == brute(rows, 4, 50)


def test_depth_and_repeats(spark, rows):
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows[:80] * 2), least=6, kept=10_000, depth=3, budget=2000).collect())
    assert got == brute(rows[:80] * 2, 6, 10_000, depth=3)


def test_nothing_to_find(spark, rows):
    assert phrases.collocations(frame(spark, rows).limit(0)).count() == 0
    assert phrases.collocations(frame(spark, [("en", "a b"), (None, None)])).count() == 0


def test_large_counts_stay_exact(spark):
    a, l, r, n = 3 * 10**14 + 1, 7 * 10**14 + 3, 5 * 10**14 + 7, 9 * 10**15 + 11
    found = phrases.scored(spark.createDataFrame([("en", "p q", a, [l])], phrases.NODE),
                           spark.createDataFrame([("en", "q", r)], "lang string, phrase string, a long"),
                           spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert found.score == 1000 * a * n // (l * r)


def test_filter_knows_its_words(spark):
    words = spark.createDataFrame([("en" if i % 2 else "fr", f"w{i}", 1) for i in range(2000)], "lang string, phrase string, a long")
    bits = phrases.bloom_filter(phrases.word_hashes(words))
    assert phrases._passes(bits, phrases._hashes("en", [f"w{i}".encode() for i in range(1, 2000, 2)])).all()
    assert phrases._passes(bits, phrases._hashes("en", [f"w{i}".encode() for i in range(0, 2000, 2)])).sum() < 20


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(spark, connect(sf), sf, phrases.op12_phrases, phrases.OP12_SQL) is None
