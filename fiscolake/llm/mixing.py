"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token weights (words by white space) are raked until their margins by source, language and topic meet the targets.
A target margin is a share per value; where none is given it is the shares of the corpus to the power ``temper``,
scaled to 1. The given tables have no topic, so ``form`` stands in for it: what a text looks like (table, shouting,
symbols, prose, nothing). Any column or expression can be passed instead.

- The corpus is first summed up to cells (source, language, topic); sums combine before the shuffle, so a source with
  a third of all rows is no hot key. Everything after works on cells.
- A round gives each source the factor that its target asks for, where the cells lie, and sums up the rest by
  language and topic. Only that small table (languages x topics, one per partition) comes to the driver, which corrects
  both factors. Rounds shuffle nothing: each shuffle of a plan keeps a thread of the driver for a minute.
- ``calibrate`` finds the scale at which min(1, scale * weight) keeps the ``budget`` of tokens in expectation. A
  document is kept if a hash of its id, as a number from 0 to 1, is below its probability.

Rows: a null source, language or topic is a value of its own; null and empty texts count no tokens and are kept with the
probability of their cell (1 if the cell has no tokens). Repeated rows count each, and are kept or left together. A
null doc_id is drawn by its text. An empty table gives an empty result. Targets for values that do not occur are
left out; targets that no weights can meet end after ``rounds`` with the nearest margins found.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.llm.common import WORD, free_name, given
from fiscolake.session import written_table

MARGINS = ("source", "lang", "topic")
NONE = "\x00none"
#: Factors of more sources than this are joined by shuffle instead of being sent to every task.
MAX_SENT_SOURCES = 100_000
GRID = 32


def form(text: Column) -> Column:
    return (F.when(text.isNull() | (text == ""), "nothing").when(F.contains(text, F.lit(" | ")), "table")
            .when(F.contains(text, F.lit("!! ")) & (text == F.upper(text)), "shouting")
            .when(F.contains(text, F.lit("%%%")) | F.contains(text, F.lit("###")), "symbols").otherwise("prose"))


def measured(docs: DataFrame, topic: Column) -> DataFrame:
    """doc_id, a draw from 0 to 1, the three values (null spelled out) and the number of tokens, per row."""
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text"), F.lit("mixing")).bitwiseAND(F.lit((1 << 53) - 1))
    return docs.select("doc_id", (draw / F.lit(float(1 << 53))).alias("draw"),
                       *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in
                         zip(MARGINS, (F.col("source"), F.col("lang"), topic))],
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))


def cells_of(rows: DataFrame) -> DataFrame:
    return written_table(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "cells")


def _summed(rows: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sums that ``add`` gives for the batches. A partition sends one row of ``size`` numbers; nothing is shuffled."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += add(b)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return sum((np.array(r.sums) for r in rows.mapInArrow(part, "sums array<double>").collect()), np.zeros(size))


def _shares(raw: dict[str, float]) -> dict[str, float]:
    total = sum(raw.values()) or 1.0
    return {k: v / total for k, v in raw.items()}


def _spelled(shares: dict) -> dict[str, float]:
    return {NONE if k is None else str(k): float(v) for k, v in shares.items() if v > 0}


@dataclass
class Factors:
    """Languages and topics with their targets and factors (0 without a target), on the driver and in the tasks."""

    values: dict[str, list[str]]
    targets: dict[str, np.ndarray]
    factors: dict[str, np.ndarray]
    total: float        # tokens
    total_raw: float    # of the sources

    def cells(self, b: pa.RecordBatch) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the cells of a batch of sources: the cells, whose source each is, its place among languages and topics, its
        share, and the factor of its source."""
        flat = b["cells"].flatten()
        row = np.repeat(np.arange(len(b)), b["cells"].value_lengths().to_numpy())
        lang, topic = (pc.index_in(flat.field(m), pa.array(self.values[m], flat.field(m).type)).to_numpy()
                       for m in ("lang", "topic"))
        share = flat.field("tokens").to_numpy() / self.total
        inside = np.bincount(row, share * self.factors["lang"][lang] * self.factors["topic"][topic], len(b))
        target = b["raw"].to_numpy() / self.total_raw
        by_source = np.divide(target, inside, out=np.zeros(len(b)), where=inside > 0)
        return flat, row, lang * len(self.values["topic"]) + topic, share, by_source

    def sums(self, b: pa.RecordBatch) -> np.ndarray:
        _, row, place, share, by_source = self.cells(b)
        return np.bincount(place, share * by_source[row], len(self.values["lang"]) * len(self.values["topic"]))

    def weights(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, row, place, _, by_source = self.cells(b)
            both = np.outer(self.factors["lang"], self.factors["topic"]).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [b["source"].take(pa.array(row)), *[flat.field(c) for c in ("lang", "topic", "tokens", "docs")],
                 pa.array(by_source[row] * both[place])], [*MARGINS, "tokens", "docs", "weight"])

    def corrected(self, found: np.ndarray) -> float:
        """Correct the factors by the sums found; the largest change."""
        found = found.reshape(len(self.values["lang"]), len(self.values["topic"]))
        change = 0.0
        for m, axis in (("lang", 1), ("topic", 0)):
            got = (found * np.outer(self.factors["lang"], self.factors["topic"])).sum(axis=axis)
            ratio = np.divide(self.targets[m], got, out=np.ones(len(got)), where=got > 0)
            self.factors[m] = self.factors[m] * ratio
            change = max(change, np.abs(ratio - 1).max(initial=0.0))
        return change


def rake(cells: DataFrame, targets: dict[str, dict] | None = None, *, temper: float = 0.5, rounds: int = 40,
         tolerance: float = 1e-9) -> DataFrame:
    """Cells with ``weight``, the ratio of the share raked to the share in the corpus (0 without a target)."""
    targets = targets or {}
    tokens: dict[str, Counter] = {"lang": Counter(), "topic": Counter()}
    for r in cells.filter("tokens > 0").groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect():
        tokens["lang"][r.lang] += r.tokens
        tokens["topic"][r.topic] += r.tokens
    if not tokens["lang"]:
        return cells.withColumn("weight", F.lit(1.0))
    # A source has one row with its cells, at most languages x topics of them. So a round shuffles nothing.
    each = (cells.filter("tokens > 0").groupBy("source")
            .agg(F.sum("tokens").alias("t"), F.collect_list(F.struct("lang", "topic", "tokens", "docs")).alias("cells")))
    if targets.get("source") is None:
        each = each.withColumn("raw", F.pow("t", F.lit(temper)))
    else:
        wanted = list(_spelled(targets["source"]).items())
        each = each.join(cells.sparkSession.createDataFrame(wanted, "source string, raw double"), "source")
    base = written_table(each.select("source", "raw", "cells"), "raking")
    wanted = {m: _shares({k: float(t) ** temper for k, t in seen.items()} if targets.get(m) is None
                         else {k: v for k, v in _spelled(targets[m]).items() if k in seen}) for m, seen in tokens.items()}
    goals = {m: np.array([wanted[m].get(k, 0.0) for k in seen]) for m, seen in tokens.items()}
    factors = Factors({m: list(seen) for m, seen in tokens.items()}, goals, {m: np.sign(goals[m]) for m in goals},
                      float(tokens["lang"].total()), float(base.agg(F.sum("raw")).first()[0] or 1.0))
    for _ in range(rounds):
        if factors.corrected(_summed(base, factors.sums, len(goals["lang"]) * len(goals["topic"]))) < tolerance:
            break
    return base.mapInArrow(factors.weights, "source string, lang string, topic string, tokens long, docs long, weight double")


def calibrate(weighed: DataFrame, budget: float) -> float:
    """The scale at which the expected tokens kept are ``budget`` times all; each job tries a grid of scales."""
    total, largest, least = weighed.agg(F.sum("tokens"), F.max("weight"),
                                        F.min(F.when(F.col("weight") > 0, F.col("weight")))).first()
    if not total or not least:
        return 1.0
    low, high = math.log(1e-9 / largest), math.log(1 / least)
    for _ in range(6):
        grid = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
        scales = np.exp(grid)

        def kept(b: pa.RecordBatch, scales: np.ndarray = scales) -> np.ndarray:
            return b["tokens"].to_numpy() @ np.minimum(1.0, np.outer(b["weight"].to_numpy(), scales))

        sums = _summed(weighed.select("tokens", "weight"), kept, GRID)
        reached = next((i for i, s in enumerate(sums) if s >= budget * total), GRID - 1)
        low, high = grid[max(0, reached - 1)], grid[reached]
    return math.exp(high)


def with_probabilities(docs: DataFrame, *, topic: Column | None = None, targets: dict[str, dict] | None = None,
                       temper: float = 0.5, budget: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, source, lang, topic, tokens, weight, probability, kept."""
    rows = measured(docs, form(F.col("text")) if topic is None else topic)
    cells = cells_of(rows)
    weighed = written_table(rake(cells, targets, temper=temper), "weights")
    scale = calibrate(weighed, budget)
    factors = weighed.select(*MARGINS, "weight")
    sources = cells.select("source").distinct().count()
    # Some texts have no tokens; their cell then has no weight of its own.
    joined = rows.join(F.broadcast(factors) if sources <= MAX_SENT_SOURCES else factors, list(MARGINS), "left")
    has_targets = F.lit(bool(targets))
    weight = F.coalesce("weight", F.when(has_targets & (F.col("tokens") > 0), 0.0).otherwise(1.0 / scale))
    probability = F.least(F.lit(1.0), weight * scale)
    spelled = [F.nullif(F.col(m), F.lit(NONE)).alias(m) for m in MARGINS]
    return joined.select("doc_id", *spelled, "tokens", weight.alias("weight"), probability.alias("probability"),
                         (F.col("draw") < probability).alias("kept"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_probabilities(given(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn, with all their columns and the weight of their cell as a last column."""
    name = free_name(docs.columns, "mixing_weight")
    own = {m: free_name(docs.columns, f"cell_{m}") for m in (*MARGINS, "weight")}
    cells = cells_of(measured(docs, form(F.col("text"))))
    weighed = written_table(rake(cells), "weights")
    scale = calibrate(weighed, 0.5)
    values = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(own[m]) for m, c in
              zip(MARGINS, (F.col("source"), F.col("lang"), form(F.col("text"))))]
    factors = weighed.select(*[F.col(m).alias(own[m]) for m in (*MARGINS, "weight")])
    sources = cells.select("source").distinct().count()
    if sources <= MAX_SENT_SOURCES:
        factors = F.broadcast(factors)
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text"), F.lit("mixing")).bitwiseAND(F.lit((1 << 53) - 1))
    weight = F.coalesce(own["weight"], F.lit(1.0 / scale))
    return (docs.select("*", *values).join(factors, [own[m] for m in MARGINS], "left")
            .filter(draw / F.lit(float(1 << 53)) < F.least(F.lit(1.0), weight * scale))
            .select(*docs.columns, weight.alias(name)))
