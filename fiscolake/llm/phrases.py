"""Collocations: phrases whose words come together more often than by chance, counted in a suffix tree cut into parts.

The tree holds every run of up to five words, per language, and is never in one place. It is partitioned vertically:

1. Words are counted, then pairs of neighbours of which both are seen often enough. A pair below the least count is in no
   phrase asked for, so runs end between its words. Tasks know the frequent words, and then the frequent pairs, by a
   Bloom filter of 16 MB whatever the vocabulary (a false positive costs room, no exactness).
2. Every position begins a suffix of up to five words, cut at the end of its run. Equal suffixes are added up in the
   task and again by the shuffle: these are the leaves of the tree, truncated in depth, with their totals.
3. Prefixes are sized. One whose leaves exceed the memory budget is lengthened by a word, until each fits; prefixes are
   then grouped until a group reaches the budget (so a group holds twice the budget at most).
4. Each group builds its subtree on its own: leaves in order, where the run of a prefix is a node and the sum of its
   leaves the node's count. Counts of lengthened prefixes come from their sizes.

A phrase of 2 to ``depth`` words seen ``least`` times is a candidate. Cut after its k-th word it scores
floor(1000 a n / (l r)), a, l and r being the counts of phrase, first part and rest, n that of all words of the language;
the lowest cut counts, the smallest k among equal ones. The first parts are the node's ancestors, the rests are joined.
A candidate that stands in a longer one as often as at all is dropped. Products are decimals of 38 digits.

Rows: a null text is empty, a null language is ``und``; repeated rows count each; ids and other columns are not read,
whatever their names. An empty table gives an empty result. Texts are read whole; phrases do not cross ``.,;:!?`` and
line ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscolake.llm.common import given, numbered, small_batches
from fiscolake.session import written_table

LEAST = 100
DEPTH = 5
KEPT = 2000
#: Bytes of leaves that one subtree is built from.
BUDGET = 16 << 20
LEAF_BYTES = 64
#: Words a task counts before it hands its sums on.
HELD_WORDS = 1 << 20
FILTER_BITS = 1 << 27
SLICE_BITS = 1 << 17
PROBES = 3
#: Parts into which the rows of a common last word are dealt.
SALTS = 16
UNKNOWN = "und"
STOP = b"\xff"  # in no UTF-8 text
#: A-Z to a-z; ends of pieces to the stop byte.
_TABLE = bytes(ord("\xff") if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_stream(texts: list[str | None]) -> list[bytes]:
    """Words of the texts, with a stop between pieces."""
    joined = STOP.join((t or "").encode().translate(_TABLE) for t in texts)
    return joined.replace(STOP, b" " + STOP + b" ").split()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    texts: dict[str, list] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
        texts.setdefault(lang, []).append(text)
    for lang, group in texts.items():
        yield lang, word_stream(group)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, a): all words and how often they occur."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(STOP, None)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), "string"),
                                                  "phrase": pa.array([w.decode() for w in counts], "string"),
                                                  "a": pa.array(list(counts.values()), "int64")})
            held.clear()

        for b in batches:
            for lang, words in _by_language(b):
                held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    each = docs.mapInArrow(count, "lang string, phrase string, a long")
    return each.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


# ---------------------------------------------------------------- filters of frequent words and pairs

def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    head = lang.encode() + STOP
    return np.fromiter((xxhash.xxh64_intdigest(head + w) for w in words), np.uint64)


def _pairs(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A hash for each word of a stream and the next."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    pairs = mixed[codes[:-1]] + (hashes ^ (hashes >> np.uint64(31)))[codes[1:]]
    return pairs ^ (pairs >> np.uint64(32))


def _places(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash, a row per hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) % np.uint64(FILTER_BITS) for i in range(PROBES)], axis=1).astype(np.int64)


def word_hashes(words: DataFrame) -> DataFrame:
    """(h): hashes of (lang, phrase)."""
    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, group in b.groupby("lang"):
                yield pd.DataFrame({"h": _hashes(lang, [w.encode() for w in group["phrase"]]).view(np.int64)})

    return words.select("lang", "phrase").mapInPandas(hashes, "h long")


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes ``h``, put together from slices that tasks fill."""
    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = np.unique(_places(b["h"].to_numpy().view(np.uint64)))
            yield pd.DataFrame({"slice": bits // SLICE_BITS, "bit": bits % SLICE_BITS})

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SLICE_BITS, dtype=bool)
        bits[rows["bit"]] = True
        return pd.DataFrame({"slice": key, "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    slices = (hashes.mapInPandas(places, "slice long, bit long").distinct()
              .groupBy("slice").applyInPandas(fill, "slice long, bits binary"))
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in slices.toLocalIterator():
        start = row["slice"] * SLICE_BITS // 8
        bits[start:start + SLICE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _places(hashes)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def frequent_pairs(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(h): hashes of the pairs of neighbours seen ``least`` times, among them by chance some that are not."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(word_hashes(words)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, stream in _by_language(b):
                codes, distinct = numbered(stream)
                hashes = _hashes(lang, distinct)
                known = (_passes(shared.value, hashes) & np.array([w != STOP for w in distinct], dtype=bool))[codes]
                pairs, n = np.unique(_pairs(hashes, codes)[known[:-1] & known[1:]], return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": pairs.view(np.int64), "n": n})

    counted = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    out = written_table(counted.where(F.col("n") >= least).select("h"), "pairs")
    shared.destroy()
    return out


# ---------------------------------------------------------------- leaves

def _suffixes(words: list[bytes], lang: str, bits: np.ndarray, depth: int) -> tuple[list[str], np.ndarray]:
    """Suffixes of 2 to ``depth`` words of a stream, each pair of neighbours frequent, and how often each begins."""
    codes, distinct = numbered(words)
    inner = np.array([w != STOP for w in distinct], dtype=bool)[codes]
    linked = inner[:-1] & inner[1:]
    linked[linked] = _passes(bits, _pairs(_hashes(lang, distinct), codes)[linked])
    ends = np.flatnonzero(~np.append(linked, False))
    at = np.flatnonzero(linked)
    if not len(at):
        return [], at
    lengths = np.minimum(ends[np.searchsorted(ends, at)] - at + 1, depth)
    key = codes[at]
    for d in range(1, depth):
        more = np.where(lengths > d, codes[np.minimum(at + d, len(codes) - 1)] + 1, 0)
        key = np.unique(key * (len(distinct) + 1) + more, return_inverse=True)[1].astype(np.int64)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [b" ".join(words[i:i + k]).decode() for i, k in zip(at[first].tolist(), lengths[first].tolist())], n


def leaves(docs: DataFrame, pairs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(lang, suffix, n): truncated suffixes and their totals; a table in the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(pairs))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, stream in _by_language(b):
                suffixes, n = _suffixes(stream, lang, shared.value, depth)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(suffixes), "string"),
                                                  "suffix": pa.array(suffixes, "string"), "n": pa.array(n, "int64")})

    each = docs.mapInArrow(begin, "lang string, suffix string, n long")
    out = written_table(each.groupBy("lang", "suffix").agg(F.sum("n").alias("n")), "leaves")
    shared.destroy()
    return out


# ---------------------------------------------------------------- vertical partitioning

def _prefix(d: int) -> Column:
    return F.substring_index("suffix", " ", d)


def _n_words(phrase: str) -> Column:
    return F.size(F.split(phrase, " "))


def prefixes(tree: DataFrame, words: DataFrame, depth: int, budget: int) -> tuple[DataFrame, list[DataFrame]]:
    """The prefixes the tree is cut at, and per length those that had to be lengthened.

    Both hold ``lang, prefix, a, above``; ``above`` are the counts of the shorter prefixes (of the word itself for a
    prefix of one word). A prefix to cut at also has its length ``d`` and the ``size`` of its leaves.
    """
    measures = [F.sum(F.octet_length("suffix") + LEAF_BYTES).alias("size"), F.sum("n").alias("a")]
    counted = words.select("lang", F.col("phrase").alias("prefix"), F.array("a").alias("above"))
    sized = tree.groupBy("lang", _prefix(1).alias("prefix")).agg(*measures).join(counted, ["lang", "prefix"])
    closed, longer = [], []
    for d in range(1, depth + 1):
        sized = written_table(sized.withColumn("d", F.lit(d)), "prefixes")
        fits = F.lit(True) if d == depth else F.col("size") <= budget
        closed.append(sized.where(fits))
        hot = sized.where(~fits)
        if d == depth or hot.isEmpty():
            break
        longer.append(hot)
        # Few by nature: each has more than a budget's worth of leaves.
        above = hot.select("lang", F.col("prefix").alias("shorter"),
                           (F.col("above") if d == 1 else F.concat("above", F.array("a"))).alias("above"))
        sized = (tree.where(_n_words("suffix") > d).withColumn("shorter", _prefix(d)).join(above, ["lang", "shorter"])
                 .groupBy("lang", _prefix(d + 1).alias("prefix")).agg(*measures, F.any_value("above").alias("above")))
    return reduce(DataFrame.unionByName, closed), longer


def grouped(closed: DataFrame, budget: int) -> DataFrame:
    """Adds ``part``: prefixes in a row share a part until their leaves reach the budget. Rows are numbered within
    buckets, so that no task has to see all prefixes."""
    total = closed.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, total // (16 * budget))
    before = Window.partitionBy("bucket").orderBy("lang", "prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (closed.withColumn("bucket", F.pmod(F.xxhash64("lang", "prefix"), F.lit(buckets)))
            .withColumn("part", F.concat_ws("-", "bucket", F.floor(F.sum("size").over(before) / budget).cast("string")))
            .drop("bucket"))


def _subtree(rows: pd.DataFrame, cut: pd.DataFrame, least: int, depth: int) -> pd.DataFrame:
    """Nodes below the prefixes of a group that are seen often enough, from the totals of its leaves."""
    above = {(r.lang, r.prefix): list(r.above) for r in cut.itertuples()}
    split = [s.split(" ") for s in rows["suffix"]]
    known = np.array([len(above[lang, " ".join(w[:d])]) for lang, w, d in zip(rows["lang"], split, rows["d"])], dtype=np.int64)
    names = numbered(w for s in split for w in s)[0] + 1
    lengths = np.array([len(s) for s in split])
    table = np.zeros((len(split), depth), dtype=np.int64)
    table[np.arange(depth)[None, :] < lengths[:, None]] = names
    lang = numbered(rows["lang"])[0]
    order = np.lexsort((*table.T[::-1], lang))
    table, lang, lengths, known, n = table[order], lang[order], lengths[order], known[order], rows["n"].to_numpy()[order]
    changed = np.append(True, lang[1:] != lang[:-1])
    counts, found = np.zeros((len(order), depth), dtype=np.int64), []
    for d in range(depth):
        changed[1:] |= table[1:, d] != table[:-1, d]
        starts = np.flatnonzero(changed)
        sums = np.add.reduceat(n, starts)
        counts[:, d] = np.repeat(sums, np.diff(np.append(starts, len(order))))
        node = (lengths[starts] > d) & (known[starts] <= d) & (sums >= least)
        found += [(i, d) for i in starts[node].tolist()]
    out = []
    for i, d in found:
        words, language = split[order[i]], rows["lang"].iloc[order[i]]
        shorter = above[language, " ".join(words[:rows["d"].iloc[order[i]]])]
        out.append((language, " ".join(words[:d + 1]), counts[i, d], shorter + counts[i, len(shorter):d].tolist()))
    return pd.DataFrame(out, columns=["lang", "phrase", "a", "lefts"])


NODE = "lang string, phrase string, a long, lefts array<long>"


def frequent_phrases(docs: DataFrame, words: DataFrame, *, least: int = LEAST, depth: int = DEPTH,
                     budget: int = BUDGET) -> DataFrame:
    """(lang, phrase, a, lefts): all phrases of 2 to ``depth`` words seen ``least`` times, each with the counts of its
    first 1, 2, ... words. ``words`` are the words seen that often."""
    tree = leaves(docs, frequent_pairs(docs, words, least), depth)
    closed, longer = prefixes(tree, words, depth, budget)
    parts = written_table(grouped(closed, budget), "parts")
    # How long the prefix of a leaf is: one more than the prefixes of it that were lengthened.
    dealt = tree.withColumn("d", F.lit(1))
    for d, hot in enumerate(longer, 1):
        marks = hot.select("lang", F.col("prefix").alias("shorter"), F.lit(True).alias("hot"))
        dealt = (dealt.withColumn("shorter", _prefix(d)).join(marks, ["lang", "shorter"], "left")
                 .withColumn("d", F.when(F.col("hot") & (F.col("d") == d), d + 1).otherwise(F.col("d"))).drop("shorter", "hot")
                 .where(_n_words("suffix") >= F.col("d")))
    dealt = (dealt.withColumn("prefix", F.expr("substring_index(suffix, ' ', d)"))
             .join(parts.select("lang", "prefix", "part"), ["lang", "prefix"]).select("part", "lang", "suffix", "n", "d"))

    def build(rows: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        return _subtree(rows, cut, least, depth) if len(rows) else pd.DataFrame([], columns=["lang", "phrase", "a", "lefts"])

    nodes = (dealt.groupBy("part").cogroup(parts.select(F.col("part").alias("of"), "lang", "prefix", "above").groupBy("of"))
             .applyInPandas(build, NODE))
    inner = [hot.where(F.col("a") >= least).select("lang", F.col("prefix").alias("phrase"), "a", F.col("above").alias("lefts"))
             for hot in longer[1:]]
    return written_table(reduce(DataFrame.unionByName, inner, nodes), "phrases")


# ---------------------------------------------------------------- scores

def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate by its lowest cut; ``totals`` has n by lang."""
    each = phrases.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"), F.posexplode("lefts").alias("k", "l"))
    salted = each.select(
        "lang", "phrase", "a", "l", (F.col("k") + 1).alias("k"), _part(F.col("w"), F.col("k") + 2, F.size("w")).alias("rest"),
        # Many candidates end with the same word; its rows are dealt to several tasks.
        F.when(F.col("k") + 2 == F.size("w"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).alias("salt"))
    known = ["lang", F.col("phrase").alias("rest"), F.col("a").alias("r")]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    rests = (phrases.select(*known, F.lit(0).cast("long").alias("salt"))
             .unionByName(words.select(*known, every.alias("salt"))))
    whole = salted.join(rests, ["lang", "rest", "salt"]).join(totals, "lang")
    score = F.expr("cast(a * 1000 as decimal(19, 0)) * cast(n as decimal(19, 0)) div "
                   "(cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    lowest = whole.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def not_contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase) of candidates that no longer candidate holds as often as they occur. Counts never grow with length,
    so one word more on either side tells for all longer ones."""
    w, m = F.split("phrase", " "), _n_words("phrase")
    longer = phrases.where(m > 2).select("lang", "a", F.explode(F.array(_part(w, 1, m - 1), _part(w, 2, m - 1))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return (phrases.select("lang", "phrase", "a").join(most, ["lang", "phrase"], "left")
            .where("most IS NULL OR most < a").select("lang", "phrase"))


def collocations(docs: DataFrame, *, least: int = LEAST, depth: int = DEPTH, kept: int = KEPT, budget: int = BUDGET) -> DataFrame:
    """Each language's ``kept`` best candidates: lang, rank, phrase, a, l, r, n, score."""
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    every = written_table(word_counts(read), "words")
    totals = every.groupBy("lang").agg(F.sum("a").alias("n"))
    words = written_table(every.where(F.col("a") >= least), "frequent")
    phrases = frequent_phrases(read, words, least=least, depth=depth, budget=budget)
    best = scored(phrases, words, totals).join(not_contained(phrases), ["lang", "phrase"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= kept)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language over all documents."""
    small_batches(spark)
    return collocations(given(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM lists, range(1, 6) t(m) WHERE len(w) >= m),
counted AS (SELECT lang, m, phrase, count(*) AS a FROM runs GROUP BY lang, m, phrase),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM counted WHERE m >= 2 AND a >= 100),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS rest
  FROM candidates, range(1, 5) t(k) WHERE k < m),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.a AS l, r.a AS r, t.n,
         ((1000::HUGEINT * c.a * t.n) // (h.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head
  JOIN counted r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS most
  FROM candidates, range(2, 5) t(s), range(1, 5) u(i) WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
kept AS (
  SELECT l.* FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.phrase = l.phrase
  WHERE i.most IS NULL OR 100 * i.most < 100 * l.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
