"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answers.

1. Passages of ``passage`` words of all documents give each benchmark word its document frequency (all passages count).
2. A randomised SVD of TF-IDF rows: the items, weighted to half of the total, and the passages of all documents. Tasks
   add up the Gram matrix of the passages' rows in slabs of bounded size; each power step multiplies by it where it lies
   and sums one small matrix per partition. The right singular vectors are the latent space.
3. Every text is searched whole, in windows of the items' lengths (classes a factor 1.5 apart) at a quarter of the
   length. Every window that holds a benchmark word is compared with the items by the cosine of their latent vectors
   over their full norms. Words foreign to the benchmark weigh nothing there, so that neither the text around an item
   nor the size of the corpus decides whether it is found.
4. A candidate at ``cosine`` or more is a leak if the longest common subsequence of words with the item covers ``sure``
   of the item, or ``likely`` of it and the answer stands in the text near it word by word. The answer is the column
   ``answer`` where the benchmark has one, else the item's last sentence.

Items are taken in blocks of ``BLOCK_ITEMS``, so that what is sent to the tasks is bounded.

Rows: null, empty or short texts leak nothing; items that are null or have fewer than ``MIN_WORDS`` words are not
searched for; repeated items are both reported, repeated documents treated alike. Without documents or items nothing
leaks. Ties of the cosine do not matter, as every item at or above the threshold is checked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.llm.common import byte_words, given, small_batches
from fiscolake.session import written_table

BLOCK_ITEMS = 256
MIN_WORDS = 8
#: Bytes of texts that are searched together.
GROUP_BYTES = 1 << 22
#: Items of a window length that are tried together, and words whose products with them are held at once.
SCREENED = 8
PRODUCED = 1 << 16
#: Numbers of the Gram matrix that a task adds up at once.
GRAM_CELLS = 1 << 25
GRAM = "word long, others array<int>, sums array<float>"
#: Rows of the Gram matrix that a task sends or multiplies at once, and that are merged as one group.
SENT_WORDS = 64
MERGED_WORDS = 8
LEAK = "array<struct<item_id: bigint, cosine: double, covered: double, answered: boolean>>"


@dataclass
class Search:
    """What a task needs to search a text for one block of items."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: dict[bytes, int]
    idf: np.ndarray      # of the vocabulary, and 0 for any other word at the end
    classes: dict[int, np.ndarray]  # window length: the items it is for
    gains: dict[int, np.ndarray]    # window length: what each word (column) adds to the latent product with each of its items
    most: dict[int, np.ndarray]     # window length: the largest of these per word, 0 at least
    cosine: float
    sure: float
    likely: float

    def numbers(self, words: list[bytes]) -> np.ndarray:
        other, get = len(self.vocabulary), self.vocabulary.get
        return np.fromiter(map(get, words, repeat(other)), np.int64, len(words))

    def candidates(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, start, end, cosine) of windows at or above the cosine, for the words (-1: none of the benchmark) of
        several texts in a row and the number of words of each. All windows of a length are tried at once."""
        to = np.cumsum(lengths)
        held = ids >= 0
        before = np.concatenate(([0], np.cumsum(held)))
        inside = ids[held]
        squares = np.concatenate(([0.0], np.cumsum(self.idf[inside] ** 2)))
        for length, wanted in self.classes.items():
            step = max(1, length // 4)
            count = np.where(lengths < MIN_WORDS, 0, -(-np.maximum(1, lengths - length + step) // step))
            text = np.repeat(np.arange(len(lengths)), count)
            start = (to - lengths)[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
            end = np.minimum(start + length, to[text])
            first, last = before[start], before[end]
            # Repeated words only add to a norm, so this is never above it.
            least = self.cosine * np.sqrt(squares[last] - squares[first]) - 1e-6
            # What a window's words give at most to any item, then what they give to each.
            best = np.concatenate(([0.0], np.cumsum(self.most[length][inside])))
            hopeful = np.flatnonzero((last > first) & (best[last] - best[first] >= least))
            words, low, high = covered(inside, first[hopeful], last[hopeful])
            for at in range(0, len(wanted), SCREENED):
                some = wanted[at:at + SCREENED]
                gains = self.gains[length][at:at + SCREENED]
                # The same bound again, of a few items.
                best = np.concatenate(([0.0], np.cumsum(gains.max(axis=0).clip(0)[words])))
                left = best[high] - best[low] >= least[hopeful]
                k = hopeful[left]
                own, own_low, own_high = covered(words, low[left], high[left])
                for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(own_low // PRODUCED)) + 1) if len(k) else ():
                    origin, beyond = own_low[part[0]], own_high[part[-1]]
                    # A row per item, as sums along a row are the fast ones.
                    sums = np.zeros((len(some), beyond - origin + 1))
                    np.cumsum(gains[:, own[origin:beyond]], axis=1, out=sums[:, 1:])
                    product = (sums[:, own_high[part] - origin] - sums[:, own_low[part] - origin]).T
                    rows, items = np.nonzero(product >= least[k[part], None])
                    for r in np.unique(rows):
                        w = k[part[r]]
                        t, often = text[w], np.unique(inside[first[w]:last[w]], return_counts=True)
                        norm = max(np.sqrt(((often[1] * self.idf[often[0]]) ** 2).sum()), 1e-12)
                        for j in items[rows == r]:
                            if product[r, j] / norm >= self.cosine:
                                yield (int(t), int(some[j]), int(start[w] - to[t] + lengths[t]),
                                       int(end[w] - to[t] + lengths[t]), float(product[r, j] / norm))

    def leaks(self, texts: pa.Array) -> list[list[dict]]:
        """Of each text. Texts are taken together up to ``GROUP_BYTES``."""
        known, out = vocabulary_array(self.vocabulary), []
        for group in grouped_texts(texts):
            found: dict[int, dict[int, tuple]] = {}
            words: dict[int, list[bytes]] = {}
            for t, item, start, end, cosine in self.candidates(*word_numbers(group, known)):
                if t not in words:
                    words[t] = byte_words(group[t].as_py())
                margin = len(self.words[item])
                near = words[t][max(0, start - margin):end + margin]
                covered = common_words(self.words[item], near) / len(self.words[item])
                answered = occurs(self.answers[item], near)
                if covered >= self.sure or covered >= self.likely and answered:
                    best = found.setdefault(t, {})
                    best[item] = max(best.get(item, (0.0,)), (covered, cosine, answered))
            out += [[{"item_id": self.ids[i], "cosine": c, "covered": v, "answered": a}
                     for i, (v, c, a) in sorted(found.get(t, {}).items(), key=lambda x: self.ids[x[0]])]
                    for t in range(len(group))]
        return out


def covered(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that stand in any of the windows, in order, and the ends of the windows among them."""
    edges = np.bincount(first, minlength=len(words) + 1) - np.bincount(last, minlength=len(words) + 1)
    inside = np.cumsum(edges)[:-1] > 0
    place = np.concatenate(([0], np.cumsum(inside)))
    return words[inside], place[first], place[last]


def vocabulary_array(vocabulary: dict[bytes, int]) -> pa.Array:
    """The words in the order of their numbers."""
    return pa.array([w.decode() for w in sorted(vocabulary, key=vocabulary.__getitem__)], pa.string())


def grouped_texts(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in a row that together have at most ``GROUP_BYTES``, or one that has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + GROUP_BYTES, "right"))
        yield texts.slice(start, max(stop, start + 1) - start)
        start = max(stop, start + 1)


def word_numbers(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of every word of the texts, -1 for words outside the vocabulary, and how many words each text has. Words are
    those of ``byte_words``."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, lengths = split.flatten(), split.value_lengths().to_numpy().astype(np.int64)
    ids = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    # White space at the ends of a text leaves empty words there.
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[real], minlength=len(lengths))
        ids = ids[real]
    return ids, lengths


def common_words(item: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence; the row of the usual table is held as bits of one integer."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    row, full = 0, (1 << len(item)) - 1
    for w in text:
        hit = places.get(w)
        if hit:
            x = row | hit
            row = x & ~(x - (row << 1 | 1)) & full
    return row.bit_count()


def occurs(part: list[bytes], words: list[bytes]) -> bool:
    n = len(part)
    return n > 0 and any(words[i] == part[0] and words[i:i + n] == part for i in range(len(words) - n + 1))


def last_sentence(text: str) -> str:
    return re.split(r"(?<=[.!?])\s+|\n", text.strip())[-1]


def _known_words(docs: DataFrame, vocabulary: dict[bytes, int], passage: int) -> DataFrame:
    """Per text its number of passages, and the benchmark's words in it (``words``) with the passage each stands in (``at``)."""
    known = vocabulary_array(vocabulary)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in grouped_texts(b["text"]):
                ids, lengths = word_numbers(group, known)
                held = ids >= 0
                text = np.repeat(np.arange(len(lengths)), lengths)
                at = (np.arange(len(ids)) - (np.cumsum(lengths) - lengths)[text])[held] // passage
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text[held], minlength=len(lengths))))), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "passages": pa.array(-(-lengths // passage), pa.int64()),
                    "at": pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                    "words": pa.ListArray.from_arrays(ends, pa.array(ids[held], pa.int32()))})

    return docs.select("text").mapInArrow(find, "passages long, at array<int>, words array<int>")


def _held(batch: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, word and how often it stands there, by passage and word; the passages of a batch are numbered through."""
    lengths = batch["words"].str.len().to_numpy()
    before = np.cumsum(batch["passages"].to_numpy()) - batch["passages"].to_numpy()
    passage = np.concatenate([*batch["at"], np.zeros(0, np.int32)]).astype(np.int64) + np.repeat(before, lengths)
    pairs, often = np.unique(passage * width + np.concatenate([*batch["words"], np.zeros(0, np.int32)]), return_counts=True)
    return pairs // width, pairs % width, often


def _frequencies(known: DataFrame, width: int) -> tuple[np.ndarray, int, int]:
    """Passages that hold each word, passages, and passages that hold any word; a row per word and task goes to the sums."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, passages, holding = np.zeros(width, np.int64), 0, 0
        for b in batches:
            at, words, _ = _held(b, width)
            passages += int(b["passages"].sum())
            holding += int(np.count_nonzero(np.diff(at, prepend=-1)))
            held += np.bincount(words, minlength=width)
        word = np.flatnonzero(held)
        yield pd.DataFrame({"word": [-2, -1, *word], "held": [holding, passages, *held[word]]})

    sums = known.mapInPandas(count, "word long, held long").groupBy("word").agg(F.sum("held").alias("n"))
    found = dict(sums.toPandas().itertuples(index=False))
    df = np.array([found.get(i, 0) for i in range(width)], float)
    return df, int(found.get(-1, 0)), int(found.get(-2, 0))


def gram_rows(known: DataFrame, idf: np.ndarray, cells: int = GRAM_CELLS) -> DataFrame:
    """Upper triangle of the Gram matrix of the TF-IDF rows (unit length) of all passages: ``word, others, sums``.

    A task adds up a slab of the matrix, of ``cells`` numbers at most, and sends what it met of it; a wider vocabulary
    takes several slabs, each a further pass over the words found."""
    width = len(idf)

    def slab(low: int, high: int) -> DataFrame:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((high - low, width), np.float32)
            flat = total.reshape(-1)
            for b in batches:
                at, words, often = _held(b, width)
                value = often * idf[words]
                norm = np.sqrt(np.bincount(at, value ** 2)) + 1e-12
                value = (value / norm[at]).astype(np.float32)
                # Words of a passage follow each other in order: each with itself, the next, the one after that ...
                left = np.flatnonzero((words >= low) & (words < high))
                start, ahead = (words - low) * width, 0
                while len(left):
                    right = left + ahead
                    np.add.at(flat, start[left] + words[right], value[left] * value[right])
                    ahead += 1
                    left = left[left + ahead < len(at)]
                    left = left[at[left] == at[left + ahead]]
            for at in range(0, high - low, SENT_WORDS):
                rows = [(low + i, low + i + np.flatnonzero(total[i, low + i:]))
                        for i in range(at, min(at + SENT_WORDS, high - low))]
                rows = [(w, others, total[w - low, others]) for w, others in rows if len(others)]
                if rows:
                    yield pd.DataFrame(rows, columns=["word", "others", "sums"])

        return known.mapInPandas(add, GRAM)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for word, parts in rows.groupby("word"):
            total = np.zeros(width)
            for others, sums in zip(parts["others"], parts["sums"]):
                total[others] += sums
            met = np.flatnonzero(total)
            out.append((word, met, total[met]))
        return pd.DataFrame(out, columns=["word", "others", "sums"])

    step = max(1, cells // max(1, width))
    slabs = [slab(low, min(low + step, width)) for low in range(0, width, step)]
    return (reduce(DataFrame.unionByName, slabs).groupBy(F.floor(F.col("word") / MERGED_WORDS))
            .applyInPandas(merge, GRAM))


def randomised_svd(gram: DataFrame, extra: list[tuple[np.ndarray, np.ndarray]], width: int, rank: int,
                   steps: int = 2) -> np.ndarray:
    """Right singular vectors (width by rank) of the rows whose Gram matrix is given by its upper triangle, with ``extra``
    sparse rows added on the driver.

    Each step multiplies by the Gram matrix where it lies: partitions send one matrix each."""
    def product(basis: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width, basis.shape[1]))
            for b in batches:
                for at in range(0, len(b), SENT_WORDS):
                    some = b.iloc[at:at + SENT_WORDS]
                    words = some["word"].to_numpy()
                    upper = np.zeros((len(some), width))
                    for i, (others, sums) in enumerate(zip(some["others"], some["sums"])):
                        upper[i, others] = sums
                    total[words] += upper @ basis
                    upper[np.arange(len(some)), words] = 0.0
                    total += upper.T @ basis[words]
            yield pd.DataFrame({"m": [total.astype(np.float32).tobytes()]})

        total = np.zeros((width, basis.shape[1]))
        for ids, values in extra:
            total[ids] += values[:, None] * (values @ basis[ids])
        for r in gram.mapInPandas(part, "m binary").toLocalIterator():
            total += np.frombuffer(r.m, np.float32).reshape(total.shape)
        return total

    wide = min(width, rank + 8)
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).standard_normal((width, wide)))[0]
    for _ in range(steps):
        basis = np.linalg.qr(product(basis))[0]
    _, turn = np.linalg.eigh(basis.T @ product(basis))
    return basis @ turn[:, ::-1][:, :rank]


def fit(docs: DataFrame, items: list, *, passage: int = 64, rank: int | None = None,
        cosine: float = 0.45, sure: float = 0.7, likely: float = 0.5) -> Search:
    """Frequencies over all documents and the latent space for one block of items (item_id, text, answer)."""
    items = [(r.item_id, byte_words(r.text), byte_words(r.answer or last_sentence(r.text))) for r in items if r.text]
    items = [x for x in items if len(x[1]) >= MIN_WORDS]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words, _ in items for w in words}))}
    classes: dict[int, list[int]] = {}
    for i, (_, words, _) in enumerate(items):
        length = 12
        while length < len(words):
            length = length * 3 // 2
        classes.setdefault(length, []).append(i)
    search = Search([x[0] for x in items], [x[1] for x in items], [x[2] if len(x[2]) >= 3 else [] for x in items],
                    vocabulary, np.ones(len(vocabulary) + 1), {k: np.array(v) for k, v in classes.items()}, {}, {},
                    cosine, sure, likely)
    if not items:
        return search
    known = written_table(_known_words(docs, vocabulary, passage), "known")
    df, passages, holding = _frequencies(known, len(vocabulary))
    search.idf = np.append(np.log((2.0 + passages) / (1.0 + df)), 0.0)
    extra = []
    for _, words, _ in items:
        inside, often = np.unique(search.numbers(words), return_counts=True)
        value = often * search.idf[inside]
        extra.append((inside, value / (np.sqrt((value ** 2).sum()) + 1e-12)))
    gram = written_table(gram_rows(known, search.idf[:-1]), "gram")
    weight = max(1.0, holding / len(items)) ** 0.5
    vectors = randomised_svd(gram, [(i, v * weight) for i, v in extra], len(vocabulary),
                             min(len(vocabulary), rank or len(items) + 64))
    latent = vectors * search.idf[:-1, None]
    for length, wanted in search.classes.items():
        search.gains[length] = np.array([extra[i][1] @ vectors[extra[i][0]] for i in wanted]) @ latent.T
        search.most[length] = search.gains[length].max(axis=0).clip(0)
    return search


def searches(docs: DataFrame, benchmark: DataFrame, **settings) -> list[Search]:
    """One fitted search per block of items."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long"), "text", answer.alias("answer"))
    blocks = -(-items.count() // BLOCK_ITEMS)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks - 1)) if blocks > 1 else F.lit(0)
    return [fit(docs, items.filter(block == i).orderBy("item_id", "text").collect(), **settings)
            for i in range(max(1, 2 * blocks - 1) if blocks else 0)]


def leaks(spark: SparkSession, found: list[Search], text: Column) -> Column:
    """The items a text holds, with cosine, share of the item covered, and whether the answer stands there."""
    def of_block(search: Search):
        sent = spark.sparkContext.broadcast(search)

        @F.pandas_udf(LEAK)
        def part(texts: pd.Series) -> pd.Series:
            return pd.Series(sent.value.leaks(pa.array(texts, pa.string(), from_pandas=True)))

        return part

    parts = [of_block(search)(text) for search in found]
    return F.concat(*parts) if parts else F.array().cast(LEAK)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    small_batches(spark)
    found = searches(docs, given(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", leaks(spark, found, F.col("text")).alias("leaks")).select(
        "doc_id", (F.size("leaks") > 0).alias("leaked"), F.transform("leaks", lambda x: x["item_id"]).alias("items"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["covered"])), F.lit(0.0)).alias("covered"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns."""
    small_batches(spark)
    found = searches(docs, given(spark, sf_dir, "benchmark"))
    return docs.filter(F.size(leaks(spark, found, F.col("text"))) == 0)
