"""MinHash near-duplicates: many universal hash minima, bands, signatures, full sets, and components.

A document's set holds its different shingles of ``words`` words (A-Z lower-cased); a shorter text is one shingle as
a whole. Two documents are linked if their sets have a Jaccard similarity of ``percent`` / 100 or more.

1. One pass over the texts gives each document the number of shingles, a 128-bit print of the whole set, 25 bands of 5
   minima each, and four bits, mixed from all, of each of 256 minima as its signature. A pair at a similarity of 0.85 (0.8) misses
   all bands with probability 4e-7 (5e-5 for 25 bands; ``bands`` is a parameter, the near-duplicate stage takes 40).
2. Documents with equal sets fold into the smallest doc_id, however many they are; only that one goes on.
3. In each bucket of a band the member with most meetings is the centre, and every member is paired with it: one
   row per member, never all pairs. Pairs pass the filter of lengths and of signatures, and are confirmed on the full sets.
4. Buckets whose members the first components do not join yet give the pairs across them, so that no link is
   lost where the centre was the wrong one, each in the first bucket where they meet; these pass the same tests within the join itself, with signatures of one bit of
   each of 2,048 minima, and one more: shingles that no other document of these buckets has can be shared with none, so what is left of the smaller
   set bounds what two share. Copies that are too far from all others by their own changes meet nobody.
   Pairs within a component would change nothing.
5. Components by alternating stars.

Rows: null or empty texts and texts of white space have no shingles and are linked with nothing; the same holds for
rows without a doc_id, whose component is null and which are kept. Rows that share a doc_id are one node; repeated
rows come out as often as they go in. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.llm.common import byte_words, given, small_batches
from fiscolake.llm.components import components
from fiscolake.session import written_table

ROWS_PER_BAND = 5
#: Minima of a signature, and bits kept of each. Their number is a multiple of 16, so that they fill whole longs.
HASHES, BITS = 256, 4
#: The same for documents that meet others across components, which are fewer.
OPEN_HASHES, OPEN_BITS = 2048, 1
#: Signatures of a pair at the threshold differ by more than this many standard deviations above the mean with
#: probability 1e-6.
DEVIATIONS = 4.75
BLOCK = 4096


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a text."""
    tokens = byte_words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in tokens), np.int64, len(tokens))
    value = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))[ids]
    size = min(words, len(value))
    mixed = np.full(len(value) - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + value[k:len(value) - size + 1 + k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def mixed(values: np.ndarray) -> np.ndarray:
    """Values whose every bit depends on all bits of the given ones."""
    x = values.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def packed(least: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits of each minimum in longs. A minimum of many hashes is near zero; its own top bits would tell nothing."""
    x = (mixed(least) >> np.uint64(64 - bits)).reshape(len(least) * bits // 64, -1)
    return (x << (np.arange(x.shape[1], dtype=np.uint64) * np.uint64(bits))).sum(axis=1, dtype=np.uint64).view(np.int64)


def minima(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of each universal hash (a * x + b modulo 2^64), in blocks so that long texts stay small."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    block = max(1, BLOCK * HASHES // len(factors))
    for i in range(0, len(hashes), block):
        part = hashes[None, i:i + block] * factors[:, None]
        part += shifts[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of ``n`` hash functions, the same in every run."""
    draw = np.random.Generator(np.random.PCG64(20240607))
    factors = draw.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, draw.integers(0, 2**63, n, np.uint64)


def signatures(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """Per row: doc_id, n_shingles, print (two longs), keys of the bands, signature bytes; null prints without a set."""
    factors, shifts = family(max(HASHES, bands * ROWS_PER_BAND))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                h = shingle_hashes(text, words)
                if not len(h):
                    rows.append((0, None, None, None, None))
                    continue
                least = minima(h, factors, shifts)
                high, low = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
                keys = [np.int64(np.uint64(xxhash.xxh64_intdigest(least[i * ROWS_PER_BAND:(i + 1) * ROWS_PER_BAND]
                                                                  .tobytes(), seed=i)).astype(np.int64)) for i in range(bands)]
                rows.append((len(h), high, low, keys, packed(least[:HASHES], BITS)))
            out = pd.DataFrame(rows, columns=["n_shingles", "print_a", "print_b", "keys", "signature"])
            out["print_a"], out["print_b"] = out["print_a"].astype("Int64"), out["print_b"].astype("Int64")
            out.insert(0, "doc_id", b["doc_id"].astype("Int64"))
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        measure, "doc_id long, n_shingles long, print_a long, print_b long, keys array<long>, signature array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    @F.pandas_udf("array<long>")
    def hashes(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, words).view(np.int64) for t in text])

    return docs.select("doc_id", hashes("text").alias("set"))


def _hopeful(percent: int, hashes: int = HASHES, bits: int = BITS):
    """A test of columns n_shingles_a, signature_a and the like: could sets of these lengths and signatures reach the
    threshold? Minima that differ differ in half of their bits."""
    miss = 1 - percent / 100
    mean = hashes * miss * bits / 2
    spread = (hashes * miss * (1 - miss) * (bits / 2) ** 2 + hashes * miss * bits / 4) ** 0.5
    close = F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * percent
    apart = sum((F.bit_count(F.get("signature_a", F.lit(i)).bitwiseXOR(F.get("signature_b", F.lit(i))))
                 for i in range(hashes * bits // 64)), F.lit(0))
    return close & (apart <= mean + DEVIATIONS * spread)


def _alone(sets: DataFrame) -> DataFrame:
    """(doc_id, alone): how many shingles of a document no other one has; no row where that is none. Counts combine before
    the shuffle."""
    held = sets.select("doc_id", F.explode_outer("set").alias("shingle"))
    return (held.groupBy("shingle").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id")).filter("k = 1")
            .groupBy("doc_id").agg(F.count("*").alias("alone")))


def _long_signatures(sets: DataFrame) -> DataFrame:
    factors, shifts = family(OPEN_HASHES)

    @F.pandas_udf("array<long>")
    def bits(sets: pd.Series) -> pd.Series:
        return pd.Series([packed(minima(h.view(np.uint64), factors, shifts), OPEN_BITS) for h in sets])

    return sets.select("doc_id", bits("set").alias("signature"))


def _side(frame: DataFrame, s: str) -> DataFrame:
    return frame.select(*[F.col(c).alias(s if c == "doc_id" else f"{c}_{s}") for c in frame.columns])


def pairs_across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket, in different components, that may reach the threshold. ``members`` has key,
    doc_id, component, n_shingles, signature, common and, as ``keys``, all its buckets; a pair that meets in many buckets leaves
    the join in the first of them."""
    enough = F.least("common_a", "common_b") * (100 + percent) >= (F.col("n_shingles_a") + F.col("n_shingles_b")) * percent
    left, right = (_side(members, s) for s in "ab")
    first = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key_a")
    return (left.join(right, (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b"))
                      & (F.col("component_a") != F.col("component_b")) & enough
                      & _hopeful(percent, OPEN_HASHES, OPEN_BITS) & first).select("a", "b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b")
    return both.filter(shared * (100 + percent) >= total * percent).select("a", "b")


def near_duplicates(docs: DataFrame, *, words: int = 3, percent: int = 85, bands: int = 25) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    marks = written_table(signatures(docs, words, bands), "signatures")
    folded = (marks.filter("doc_id IS NOT NULL AND print_a IS NOT NULL").groupBy("print_a", "print_b")
              .agg(F.min("doc_id").alias("first")))
    firsts = marks.join(folded, ["print_a", "print_b"]).filter("doc_id = first")
    keyed = firsts.select("doc_id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = written_table(keyed.join(shared, "key"), "buckets")
    weight = met.groupBy("doc_id").agg(F.sum("size").alias("meetings"))
    met = met.join(weight, "doc_id")
    centres = met.groupBy("key").agg(F.max(F.struct("meetings", (-F.col("doc_id")).alias("less"))).alias("c"))
    star = (met.join(centres.select("key", (-F.col("c.less")).alias("centre")), "key")
            .filter("doc_id <> centre")
            .select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct())
    wanted = docs.join(weight.select("doc_id"), "doc_id", "left_semi")
    sets = written_table(_sets(wanted, words), "sets")
    told = written_table(firsts.join(weight.select("doc_id"), "doc_id", "left_semi")
                         .select("doc_id", "n_shingles", "signature"), "told")
    star = star.join(_side(told, "a"), "a").join(_side(told, "b"), "b").filter(_hopeful(percent)).select("a", "b")
    star = written_table(star, "star")
    links = written_table(_confirmed(star, sets, percent), "links")
    joined = components(links)
    # Buckets that hold several components: only pairs across them can still matter.
    named = (met.select("key", "doc_id").join(joined, F.col("doc_id") == F.col("node"), "left")
             .select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    split = (named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .filter("low < high").select("key"))
    named = written_table(named.join(split, "key"), "split")
    own = sets.join(named.select("doc_id").distinct(), "doc_id", "left_semi")
    common = F.col("n_shingles") - F.coalesce("alone", F.lit(0))
    # A document has at most as many keys as there are bands.
    buckets = named.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    facts = (told.select("doc_id", "n_shingles").join(_long_signatures(own), "doc_id").join(_alone(own), "doc_id", "left")
             .join(buckets, "doc_id").select("doc_id", "n_shingles", "signature", common.alias("common"), "keys"))
    named = written_table(named.join(facts, "doc_id"), "open")
    across = pairs_across(named, percent).join(star, ["a", "b"], "left_anti")
    more = written_table(_confirmed(across, sets, percent), "links")
    joined = components(links.unionAll(more).select("a", "b"))
    named = folded.join(joined, F.col("first") == F.col("node"), "left").select(
        "print_a", "print_b", F.coalesce("component", "first").alias("component"))
    # Most sets occur once; only the others are worth a lookup, but a join by print serves both alike.
    found = marks.select("doc_id", "n_shingles", "print_a", "print_b").join(named, ["print_a", "print_b"], "left")
    return found.select("doc_id", "n_shingles",
                        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
                        ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(given(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), the one with the smallest doc_id, with all its
    columns. Of rows with one doc_id the one with the smallest digest stays; rows without doc_id stay."""
    found = near_duplicates(docs, words=5, percent=80, bands=40)
    gone = found.filter("NOT kept").select("doc_id").distinct()
    twice = docs.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    row = F.struct(*docs.columns)
    first = (kept.join(twice, "doc_id", "left_semi").groupBy("doc_id")
             .agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("row")).select("row.*"))
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionAll(first)
