"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another, and how often.

A text is encoded by tokenizer A (byte-level pairs) and by tokenizer B (pieces). Byte offsets where tokens of both end cut
the two sequences into groups; two tokens whose byte ranges overlap are linked. How many links hold a pair of ids over
the whole corpus is counted through a minimal perfect hash of the distinct pairs:

1. Texts are aligned, stretch by stretch: at a blank between two words both tokenizers end a token, so a stretch that a
   batch holds often is encoded once. Tasks add up their links by pair; the distinct pairs come out of one small shuffle.
2. Pairs are dealt by their B id into shards of some 131,072. Each shard builds, in a task of its own, a minimal perfect
   hash (levels of bits, in which a key stays that meets no other, ranked by the bits before it) and keeps its keys in hash
   order, so that a lookup is verified.
3. Tasks add their counts into dense vectors indexed by the hash, one per shard, and the vectors are summed as a tree of 32
   branches at each node.
4. Texts are aligned again and look their pairs up.

What goes to every task is a piece of at most 16 shards (about 2 million pairs, 32 MB, whatever the corpus). More pairs than
that make further rounds over the texts, one for each piece, whose shares of a text are added up; two vocabularies bound
the number of pairs, so they bound the rounds too.

Rows: one per row given, repeated ones too, each counted as often as it stands there. Null and empty texts, and texts whose
tokens of A or B do not give back the bytes of blank and text, have no tokens: all numbers are zero, the digest is ''. Ids
are handed on, null ones too; other columns are not read, whatever their names. An empty table gives an empty result.
Texts are aligned whole. The tokenizers' files lie under the same path on every machine; the paths are parameters.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.llm.common import given, numbered, small_batches
from fiscolake.llm.lengths import PATTERN
from fiscolake.session import written_table

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SHARD_PAIRS = 1 << 17
SHARDS_PER_PIECE = 16
FAN = 32
#: Distinct pairs a task holds before it hands its sums on.
HELD_PAIRS = 1 << 20
#: Texts a process remembers the ids of, and how long they may be.
HELD_TEXTS = 200_000
SHORT_TEXT = 40
#: Blanks between two signs that are no white space, and what tells that a text has others.
BLANK = re.compile(r"(?<=\S)(?= \S)")
BESIDE_SPACE = re.compile(r" \s|\s ")
_loaded: dict = {}


# ---------------------------------------------------------------- tokenizers

def byte_of_sign() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: visible Latin-1 signs stand for themselves, the other
    bytes, in order, for the signs from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Tokenizers:
    """The two encoders and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        signs, special = byte_of_sign(), {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        vocabulary = {token: i for token, i in spec["model"]["vocab"].items() if token not in special}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{a_path}: ids do not follow the order of merges")
        ranks = {bytes(signs[s] for s in token): i for token, i in vocabulary.items()}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
                        for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_sizes, self.b_sizes = [len(t) for t in self.a_bytes], [len(t) for t in self.b_bytes]
        self.a_lengths, self.b_lengths = np.array(self.a_sizes), np.array(self.b_sizes)
        self.met: dict[str, tuple[list[int], list[int]]] = {}
        ends = (",", "|"), (",", ";", "")
        self.a_signs, self.b_signs = (np.array([f"{i}{e}" for i in range(len(names)) for e in signs], dtype=object)
                                      for names, signs in zip((self.a_bytes, self.b_bytes), ends))

        # No piece goes on after a blank, and no word of the pattern does: then blanks between words part all tokens.
        self.parted = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))

    def stretches(self, text: str) -> list[str]:
        """The text cut at the blanks that end a token of both whatever stands around: those between two signs that are
        no white space. Each stretch is encoded as a text of its own would be."""
        if not self.parted:
            return [text]
        if text[0].isspace() or text[-1].isspace() or BESIDE_SPACE.search(text):
            return [s[1:] for s in BLANK.split(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each text; none unless both give back the bytes of blank and text. Short texts met before are
        not encoded again."""
        new = [t for t in texts if t not in self.met]
        a, b = [self.a.encode_ordinary(" " + t) for t in new], self.b.encode(new, num_threads=1)
        wholes = [b" " + t.encode() for t in new]
        whole = b"".join(wholes)
        lengths = np.array([len(w) for w in wholes], dtype=np.int64)
        same = all(b"".join([names[i] for i in chain.from_iterable(ids)]) == whole and np.array_equal(
            np.fromiter((sum(map(sizes.__getitem__, i)) for i in ids), np.int64), lengths)
            for ids, names, sizes in ((a, self.a_bytes, self.a_sizes), (b, self.b_bytes, self.b_sizes)))
        found = dict(zip(new, zip(a, b) if same else (self._checked(*each) for each in zip(wholes, a, b))))
        out = [self.met.get(t) or found[t] for t in texts]
        if len(self.met) < HELD_TEXTS:
            self.met.update((t, ids) for t, ids in found.items() if len(t) <= SHORT_TEXT)
        return out

    def _checked(self, whole: bytes, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        same = b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])
        return (a, b) if same else ([], [])


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """The tokenizers of a pair of files, loaded once per process."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


# ---------------------------------------------------------------- alignment

class Stretches:
    """Distinct stretches of text, aligned as one stream of bytes; the end of a stretch is an end in both."""

    def __init__(self, texts: list[str], tokens: Tokenizers):
        self.tokens = tokens
        both = tokens.encode(texts)
        self.n_a, self.n_b = (np.array([len(ids[side]) for ids in both], dtype=np.int64) for side in (0, 1))
        self.a, self.b = (np.fromiter(chain.from_iterable(ids[side] for ids in both), np.int64) for side in (0, 1))
        self.ends_a, self.ends_b = tokens.a_lengths[self.a].cumsum(), tokens.b_lengths[self.b].cumsum()
        self.common = np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)
        ends = np.union1d(self.ends_a, self.ends_b)
        # Between two ends lies exactly one overlap of a token of A with one of B.
        link_a, link_b = self.a[np.searchsorted(self.ends_a, ends)], self.b[np.searchsorted(self.ends_b, ends)]
        self.pairs = link_a * len(tokens.b_bytes) + link_b
        self.last = np.concatenate([[0], self.ends_a])[self.n_a.cumsum()]  # where each stretch ends
        self.n_links = np.diff(np.searchsorted(ends, self.last, "right"), prepend=0)
        self.n_groups = np.diff(np.searchsorted(self.common, self.last, "right"), prepend=0)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of values of the links of each stretch."""
        return np.diff(np.concatenate([[0], values.cumsum()])[self.n_links.cumsum()], prepend=0)

    def groups(self) -> list[str]:
        """Per stretch ``a1,a2|b1;a3|b2,b3``: the ids of each group, A before B."""
        group_a, group_b = np.searchsorted(self.common, self.ends_a), np.searchsorted(self.common, self.ends_b)
        closes_a, closes_b = np.isin(self.ends_a, self.common), np.isin(self.ends_b, self.common).astype(np.int64)
        closes_b[np.isin(self.ends_b, self.last)] = 2
        signs = np.empty(len(self.a) + len(self.b), dtype=object)
        signs[np.arange(len(self.a)) + np.searchsorted(group_b, group_a, "left")] = self.tokens.a_signs[2 * self.a + closes_a]
        signs[np.arange(len(self.b)) + np.searchsorted(group_a, group_b, "right")] = self.tokens.b_signs[3 * self.b + closes_b]
        signs, to = signs.tolist(), (self.n_a + self.n_b).cumsum()
        return ["".join(signs[end - n:end]) for end, n in zip(to, self.n_a + self.n_b)]


class Aligned:
    """A batch of texts, each a row of stretches; a stretch that comes again is aligned once."""

    def __init__(self, texts: Iterable[str | None], tokens: Tokenizers):
        cut = [tokens.stretches(t) if t else [] for t in texts]
        n = np.array([len(c) for c in cut], dtype=np.int64)
        codes, distinct = numbered(chain.from_iterable(cut))
        self.stretches = Stretches(distinct, tokens)
        # One stretch that the tokens do not give back, and the text has none.
        text = np.repeat(np.arange(len(n)), n)
        lost = np.zeros(len(n), dtype=bool)
        lost[text[self.stretches.n_a[codes] == 0]] = True
        self.codes = codes[~lost[text]]
        self.to = np.where(lost, 0, n).cumsum()

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of values of the stretches of each text."""
        return np.diff(np.concatenate([[0], values[self.codes].cumsum()])[self.to], prepend=0)

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs, and how many links hold each."""
        times = np.bincount(self.codes, minlength=len(self.stretches.n_links))
        pairs, place = np.unique(self.stretches.pairs, return_inverse=True)
        return _added(pairs, place, np.repeat(times, self.stretches.n_links))

    def group_texts(self) -> list[str]:
        groups, codes, at, out = self.stretches.groups(), self.codes.tolist(), 0, []
        for to in self.to.tolist():
            out.append(";".join([groups[c] for c in codes[at:to]]))
            at = to
        return out


def _added(keys: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with the sums of the numbers that belong to each; keys of which there are none are left out."""
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, n)
    return keys[sums > 0], sums[sums > 0]


# ---------------------------------------------------------------- minimal perfect hash

def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct keys to 0 ... n - 1. Level by level, a key stays at the first place it has to itself; its number is the
    rank of the bit of that place."""

    def __init__(self, sizes: list[int], words: np.ndarray, keys: np.ndarray | None = None):
        self.sizes, self.words, self.keys = sizes, words, keys
        self.ranks = np.concatenate([[0], np.bitwise_count(words).cumsum(dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64) // 64])

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        keys = np.asarray(keys, dtype=np.int64)
        left, sizes, words = keys, [], [np.zeros(0, np.uint64)]
        while len(left):
            size = 64 * max(1, int(np.ceil(room * len(left) / 64)))
            place = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[place]]
        built = cls(sizes, np.concatenate(words))
        built.keys = np.empty_like(keys)
        built.keys[built._numbers(keys)] = keys
        return built

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        numbers, at = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            place = _mixed(keys[at], level) % np.uint64(size)
            word, bit = (place >> np.uint64(6)).astype(np.int64) + self.starts[level], place & np.uint64(63)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            numbers[at[found]] = (self.ranks[word] + np.bitwise_count(below))[found]
            at = at[~found]
        return numbers

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 for a key that is not among them."""
        keys = np.asarray(keys, dtype=np.int64)
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        numbers = self._numbers(keys)
        return np.where(self.keys[numbers] == keys, numbers, -1)


# ---------------------------------------------------------------- counting

def task_counts(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """(pair, n): links by pair, added up within each task."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            pairs, more = Aligned(b["text"], tokenizers(a_path, b_path)).pair_counts()
            keys, place = np.unique(np.concatenate([held, pairs]), return_inverse=True)
            held, n = _added(keys, place, np.concatenate([n, more]))
            if len(held) > HELD_PAIRS:
                yield pd.DataFrame({"pair": held, "n": n})
                held, n = held[:0], n[:0]
        yield pd.DataFrame({"pair": held, "n": n})

    return docs.select("text").mapInPandas(count, "pair long, n long")


def hash_shards(pairs: DataFrame) -> DataFrame:
    """One row per shard of distinct pairs (pair, shard): the levels of its hash, and its keys in hash order."""
    def build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        built = PerfectHash.build(np.sort(rows["pair"].to_numpy()))
        return pd.DataFrame({"shard": shard, "sizes": [built.sizes], "words": [built.words.tobytes()],
                             "keys": [built.keys.tobytes()]})

    return pairs.groupBy("shard").applyInPandas(build, "shard long, sizes array<long>, words binary, keys binary")


class Piece:
    """The hashes of some shards side by side, and the counts once they are known."""

    def __init__(self, rows: list, n_b: int, n_shards: int):
        self.n_b, self.n_shards = n_b, n_shards
        self.hashes = {r.shard: PerfectHash(list(r.sizes), np.frombuffer(r.words, np.uint64), np.frombuffer(r.keys, np.int64))
                       for r in rows}
        self.counts: dict[int, np.ndarray] = {}

    def best(self) -> np.ndarray:
        """The highest count of each B id; all pairs of a B id are in one shard."""
        best = np.zeros(self.n_b, np.int64)
        for shard, counts in self.counts.items():
            np.maximum.at(best, self.hashes[shard].keys % self.n_b, counts)
        return best

    def shard_of(self, pairs: np.ndarray) -> np.ndarray:
        return pairs % self.n_b % self.n_shards

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of the pairs; 0 for those of other pieces."""
        found, shards = np.zeros(len(pairs), np.int64), self.shard_of(pairs)
        for shard, hashed in self.hashes.items():
            mine = np.flatnonzero(shards == shard)
            numbers = hashed(pairs[mine])
            if (numbers < 0).any():
                raise LookupError("a pair was not met when the hash was built")
            found[mine] = self.counts[shard][numbers]
        return found


def dense_vectors(counts: DataFrame, shared) -> DataFrame:
    """(shard, node, counts): the counts of every task as one vector per shard, in hash order; ``node`` is the task."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, vectors = shared.value, {}
        for b in batches:
            pairs, n = b["pair"].to_numpy(), b["n"].to_numpy()
            shards = piece.shard_of(pairs)
            for shard in np.unique(shards).tolist():
                mine, hashed = shards == shard, piece.hashes[shard]
                vector = vectors.setdefault(shard, np.zeros(len(hashed.keys), np.int64))
                np.add.at(vector, hashed(pairs[mine]), n[mine])
        yield pd.DataFrame({"shard": pd.Series(list(vectors), dtype="int64"),
                            "counts": [v.tobytes() for v in vectors.values()]})

    return counts.mapInPandas(add, "shard long, counts binary").select("shard", F.spark_partition_id().alias("node"), "counts")


def tree_sum(vectors: DataFrame) -> DataFrame:
    """(shard, counts): vectors of a shard added up, at most ``FAN`` in one task."""
    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.int64) for v in rows["counts"])
        return pd.DataFrame({"shard": [key[0]], "node": [key[1]], "counts": [total.tobytes()]})

    most = vectors.agg(F.max("node")).first()[0] or 0
    while True:
        vectors = (vectors.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("shard", "node")
                   .applyInPandas(add, "shard long, node int, counts binary"))
        most //= FAN
        if not most:
            return vectors.select("shard", "counts")


def pieces(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, *, shard_pairs: int = SHARD_PAIRS,
           shards_per_piece: int = SHARDS_PER_PIECE) -> Iterator[Piece]:
    """Hashes and counts of all distinct pairs of the corpus, a bounded piece at a time."""
    spark = docs.sparkSession
    n_b = len(tokenizers(a_path, b_path).b_bytes)
    counts = written_table(task_counts(docs, a_path, b_path), "task_counts")
    pairs = written_table(counts.select("pair").distinct(), "pairs")
    n_shards = max(1, -(-pairs.count() // shard_pairs))
    shard = F.pmod(F.pmod("pair", F.lit(n_b)), F.lit(n_shards))
    shards = written_table(hash_shards(pairs.withColumn("shard", shard)), "shards")
    for first in range(0, n_shards, shards_per_piece):
        mine = F.col("shard").between(first, first + shards_per_piece - 1)
        piece = Piece(shards.where(mine).collect(), n_b, n_shards)
        shared = spark.sparkContext.broadcast(piece)
        own = counts.withColumn("shard", shard).where(mine).select("pair", "n")
        sums = tree_sum(written_table(dense_vectors(own, shared), "vectors"))
        piece.counts = {r.shard: np.frombuffer(r.counts, np.int64) for r in sums.collect()}
        shared.destroy()
        yield piece


def pair_counts(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, **limits: int) -> DataFrame:
    """(a_id, b_id, n): how many links of the corpus hold each pair, as a table in the shared folder."""
    spark = docs.sparkSession
    parts = []
    for piece in pieces(docs, a_path, b_path, **limits):
        rows = [pd.DataFrame({"pair": h.keys, "n": piece.counts[s]}) for s, h in piece.hashes.items()]
        frame = pd.concat(rows) if rows else pd.DataFrame({"pair": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        parts.append(written_table(spark.createDataFrame(frame, "pair long, n long").select(
            F.floor(F.col("pair") / piece.n_b).alias("a_id"), (F.col("pair") % piece.n_b).alias("b_id"), "n"), "pair_counts"))
    return reduce(DataFrame.unionByName, parts)


KEPT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def looked_up(docs: DataFrame, piece: Piece, a_path: str, b_path: str) -> DataFrame:
    """Per row: its tokens, groups and links, and what the pairs of this piece add to ``n_best`` and ``count_sum``."""
    shared = docs.sparkSession.sparkContext.broadcast((piece, piece.best()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best = shared.value
        for b in batches:
            met = Aligned(b["text"].to_pylist(), tokenizers(a_path, b_path))
            each, sums = met.stretches, met.stretches.sums
            used = np.repeat(np.isin(np.arange(len(each.n_links)), met.codes), each.n_links)
            pairs, place = np.unique(each.pairs[used], return_inverse=True)
            counts = np.zeros(len(each.pairs), np.int64)
            counts[used] = table.look_up(pairs)[place]
            highest = (counts == best[each.pairs % table.n_b]) & (counts > 0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b["doc_id"], **{c: met.per_text(getattr(each, c)) for c in ("n_a", "n_b", "n_groups", "n_links")},
                "groups_sha256": pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in met.group_texts()],
                                          "string"),
                "n_best": met.per_text(sums(highest.astype(np.int64))), "count_sum": met.per_text(sums(counts))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, {KEPT}, n_best long, count_sum long")
    out = written_table(rows, "aligned")
    shared.destroy()
    return out


def aligned(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, **limits: int) -> DataFrame:
    """Per row of ``doc_id, text``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    rounds = [looked_up(docs, piece, a_path, b_path) for piece in pieces(docs, a_path, b_path, **limits)]
    if len(rounds) == 1:
        return rounds[0]
    # A row is in every round once. Rows that agree in id and groups agree in all, so their shares can be added up together.
    same = ["doc_id", *[c.split()[0] for c in KEPT.split(", ")]]
    copies = f"count(*) div {len(rounds)}"
    sums = reduce(DataFrame.unionByName, rounds).groupBy(*same).agg(
        F.expr(copies).alias("copies"), *[F.expr(f"sum({c}) div ({copies})").alias(c) for c in ("n_best", "count_sum")])
    return sums.select(*same, "n_best", "count_sum", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups, links and what the corpus says of the links, per document."""
    small_batches(spark)
    docs = given(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return aligned(docs)
