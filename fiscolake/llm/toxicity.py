"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of its words with three levels:

1. the word: its count less a discount (three discounts, estimated from the counts of counts);
2. its stem, the first ``stem`` characters: the number of different words of the class with that stem, discounted
   likewise, and spread evenly over the words of the stem;
3. the stem among the words of both classes together, which is what rare expressions share.

A text is compared by its two log-likelihoods per word: their difference, averaged over the whole text (length
normalised), and averaged over the ``peak`` words that speak loudest for the toxic class. A logistic regression on
labelled texts the models have not seen turns these into a probability.

Rows: a null or empty text has no words and gets the probability of the differences 0. Labels that are null or
other than 0 and 1 are not used; a document with several labels counts as toxic if any says so. Repeated rows are
scored alike. Without any labels of both classes the score is 0. Columns other than the text are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.llm.common import fold, given, small_batches
from fiscolake.session import written_table

WORDS = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3


@dataclass
class Model:
    """Log ratios (toxic over ordinary) of kept words and stems, and the calibration."""

    word: dict[str, float] = field(default_factory=dict)
    stem: dict[str, float] = field(default_factory=dict)
    other: float = 0.0
    stem_chars: int = 4
    peak: int = 3
    centre: np.ndarray = field(default_factory=lambda: np.zeros(3))
    spread: np.ndarray = field(default_factory=lambda: np.ones(3))
    weights: np.ndarray | None = None

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Mean difference, the largest one, and the mean of the ``peak`` largest."""
        word, stem, other, n = self.word, self.stem, self.other, self.stem_chars
        found = np.fromiter((v if (v := word.get(w)) is not None else stem.get(w[:n], other)
                             for w in WORDS.findall((text or "").lower())), float)
        if not len(found):
            return 0.0, 0.0, 0.0
        k = min(self.peak, len(found))
        top = np.partition(found, len(found) - k)[len(found) - k:]
        return float(found.mean()), float(top.max()), float(top.sum() / self.peak)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        z = np.c_[np.ones(len(rows)), (rows - self.centre) / self.spread] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Level:
    """What one level of a class's model knows of all its counts: how many are 1, 2, 3, 4 and 3 or more, and their sum."""

    seen: tuple[int, int, int, int]
    many: int
    total: int

    @property
    def discounts(self) -> np.ndarray:
        """Discounts of counts 0, 1, 2 and 3 or more."""
        n1, n2, n3, n4 = (max(1, n) for n in self.seen)
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return np.array([0.0, *(min(max(d, 0.1), 0.9 * (k + 1)) for k, d in enumerate(found))])

    def share(self, counts: np.ndarray) -> np.ndarray:
        """Discounted shares of the counts."""
        return (counts - self.discounts[np.minimum(3, counts)]) / max(1, self.total)

    @property
    def left(self) -> float:
        """The share left to the next level."""
        if not self.total:
            return 1.0
        return float(self.discounts[1:] @ (*self.seen[:2], self.many)) / self.total


def _level_of(frame: DataFrame) -> list[Level]:
    """The levels of the classes 0 and 1 from their counts ``c0, c1``: one row of sums comes to the driver."""
    one = frame.agg(*[F.count_if(F.col(c) == n).alias(f"{c}_{n}") for c in ("c0", "c1") for n in (1, 2, 3, 4)],
                    *[F.count_if(F.col(c) > 2).alias(f"{c}_many") for c in ("c0", "c1")],
                    *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total") for c in ("c0", "c1")]).first()
    return [Level(tuple(one[f"{c}_{n}"] for n in (1, 2, 3, 4)), one[f"{c}_many"], one[f"{c}_total"]) for c in ("c0", "c1")]


def kneser_ney(words: DataFrame, stem_chars: int, cutoff: int) -> tuple[dict, dict, float]:
    """Log ratios from the counts ``w, c0, c1`` of words in the classes 0 and 1.

    A stem counts the different words it begins. Words met fewer than ``cutoff`` times in all are left to their stem, and
    never leave the executors.
    """
    stems = written_table(words.groupBy(F.substring("w", 1, stem_chars).alias("w")).agg(
        F.count_if(F.col("c0") > 0).alias("c0"), F.count_if(F.col("c1") > 0).alias("c1"), F.count("*").alias("types")), "stems")
    of_words, of_stems = _level_of(words), _level_of(stems)
    kept = words.where(F.col("c0") + F.col("c1") >= cutoff).toPandas()
    stems = stems.toPandas().set_index("w")
    types, size = max(1, int(stems["types"].sum())), len(stems) + 1

    def of_stem(k: int, counts: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return of_stems[k].share(counts) + of_stems[k].left * (shared + 0.5) / (types + 0.5 * size)

    by_stem = [of_stem(k, stems[f"c{k}"].to_numpy(), stems["types"].to_numpy()) for k in (0, 1)]
    place = stems.index.get_indexer(kept["w"].str.slice(0, stem_chars))
    by_word = [of_words[k].share(kept[f"c{k}"].to_numpy())
               + of_words[k].left * by_stem[k][place] / (stems["types"].to_numpy()[place] + 1) for k in (0, 1)]
    base = np.log(of_words[1].left / of_words[0].left)
    nothing = np.zeros(1, dtype=np.int64)
    other = base + np.log(of_stem(1, nothing, nothing) / of_stem(0, nothing, nothing))[0]
    return (dict(zip(kept["w"], np.log(by_word[1] / by_word[0]).tolist())),
            dict(zip(stems.index, (base + np.log(by_stem[1] / by_stem[0])).tolist())), float(other))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; ``x`` has its constant column first."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, held_out: int = 2, folds: int = 4, max_docs: int = 6000,
          stem_chars: int = 4, cutoff: int = 2, peak: int = 3) -> Model:
    """Learn from labelled documents whose fold is not ``held_out``.

    Bounds: the word models take at most ``max_docs`` documents of each class, the calibration at most twice as
    many of both together, in the order of a hash of their ids. The fold before ``held_out`` in the cycle calibrates.
    """
    calibrates = (held_out + 1) % folds
    flags = (labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("part", fold("doc_id", folds)).filter(F.col("part") != held_out)
             .withColumn("order", F.xxhash64("doc_id")))
    first = [flags.filter((F.col("part") != calibrates) & (F.col("toxic") == k)).orderBy("order").limit(max_docs)
             for k in (0, 1)]
    later = flags.filter(F.col("part") == calibrates).orderBy("order").limit(2 * max_docs)
    chosen = first[0].unionAll(first[1]).unionAll(later).select("doc_id", "toxic", "part")
    # At most 4 * max_docs short rows, hence the broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").drop("doc_id")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    counted = written_table(
        texts.filter(F.col("part") != calibrates).select("toxic", F.explode(words).alias("w")).groupBy("w")
        .agg(F.count_if(F.col("toxic") == 0).alias("c0"), F.count_if(F.col("toxic") == 1).alias("c1")), "word_counts")
    model = Model(stem_chars=stem_chars, peak=peak)
    if not all(level.total for level in _level_of(counted)):
        return model
    model.word, model.stem, model.other = kneser_ney(counted, stem_chars, cutoff)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.array([sent.value.features(t) for t in b["text"]]).reshape(-1, 3)
            yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1], "c": found[:, 2], "toxic": b["toxic"]})

    seen = texts.filter(F.col("part") == calibrates).mapInPandas(measure, "a double, b double, c double, toxic int")
    seen = seen.toPandas().sort_values(["a", "b", "c", "toxic"])
    sent.destroy()
    y = seen["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        x = seen[["a", "b", "c"]].to_numpy()
        model.centre, model.spread = x.mean(0), x.std(0) + 1e-9
        model.weights = logistic(np.c_[np.ones(len(x)), (x - model.centre) / model.spread], y)
    else:  # nothing to calibrate on: the loudest words must outweigh the rest by e^4
        model.weights = np.array([-4.0, 0.0, 0.0, 1.0])
    return model


def score(spark: SparkSession, model: Model):
    """A function of the text column: the probability of the toxic class."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(text: pd.Series) -> pd.Series:
        rows = np.array([sent.value.features(t) for t in text]).reshape(-1, 3)
        return pd.Series(sent.value.probability(rows))

    return toxicity


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    small_batches(spark)
    toxicity = score(spark, train(docs, given(spark, sf_dir, "labels")))
    return (docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                        toxicity("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold, with all their columns."""
    small_batches(spark)
    toxicity = score(spark, train(docs, given(spark, sf_dir, "labels")))
    return docs.filter(toxicity("text") < THRESHOLD)
