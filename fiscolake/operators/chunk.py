"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from fiscolake.functions.merges import Ranks, token_counter
from fiscolake.functions.tokens import words

CHUNK_SIZE = 1024
CHUNK_OVERLAP = 200
#: Texts of a batch that a worker holds as Python objects at once.
TEXTS_AT_ONCE = 128

# A sentence: text up to closing punctuation and the blanks after it, or a line.
SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+"


# Where a text may be cut without changing its tokens: before white space that follows closing punctuation or holds a
# line feed.
BREAK = r"(?U)(?<=[.!?])(?=\s)|(?<=\S)(?=\s*\n)"
# White space and the word after it.
SPACED = r"\s*\S+|\s+$"


def _chunk_id(doc_id: Column, chunk_no: Column) -> Column:
    return F.sha2(F.concat_ws("/", doc_id.cast("string"), chunk_no.cast("string")), 256)


def _finish(chunks: DataFrame) -> DataFrame:
    return chunks.select(_chunk_id(F.col("doc_id"), F.col("chunk_no")).alias("chunk_id"),
                         F.col("doc_id").cast("string").alias("doc_id"), "chunk_no", "text", "n_tokens")


def chunk_words(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` words, each starting ``size - overlap`` words after the
    one before. The last window is the first that reaches the end of the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    split = docs.select("doc_id", words(F.col("text")).alias("_words"))
    n = F.size("_words")
    # Windows after the first are needed only for words past the first window.
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step))
    windows = (split.select("doc_id", "_words", F.posexplode_outer(starts).alias("chunk_no", "_from"))
               .where("_from IS NOT NULL"))
    part = F.slice("_words", F.col("_from") + 1, F.lit(size))
    return _finish(windows.select("doc_id", "chunk_no", F.array_join(part, " ").alias("text"),
                                  F.size(part).alias("n_tokens")))


def _spans(size: int, overlap: int):
    """Column function: word counts of consecutive pieces to the index ranges
    ``[from, to)`` of the chunks they are packed into."""

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def spans(counts: pd.Series) -> pd.Series:
        def pack(sizes) -> list[dict]:
            out, first, total = [], 0, 0
            for i, n in enumerate(sizes):
                if i > first and total + n > size:
                    out.append({"first": first, "last": i})
                    # Go back over whole pieces as far as the overlap allows,
                    # and no further than leaves room for the next piece.
                    back, kept = i, 0
                    while back > first + 1 and kept + sizes[back - 1] <= min(overlap, size - n):
                        back -= 1
                        kept += sizes[back]
                    first, total = back, kept
                total += n
            if len(sizes):
                out.append({"first": first, "last": len(sizes)})
            return out
        return counts.map(pack)

    return spans


def chunk_sentences(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Whole sentences packed into chunks of at most ``size`` words, where a chunk
    begins with the last sentences of the one before, up to ``overlap`` words.
    A sentence longer than a chunk is first cut into pieces of ``size`` words."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    def cut(sentence: Column) -> Column:
        w = words(sentence)
        starts = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int"))
        return F.transform(starts, lambda i: F.slice(w, i * size + 1, F.lit(size)))

    found = F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))
    filled = F.filter(found, lambda s: F.size(words(s)) > 0)
    pieces = docs.select("doc_id", F.flatten(F.transform(filled, cut)).alias("_pieces"))
    counted = pieces.select("doc_id", "_pieces", _spans(size, overlap)(
        F.transform("_pieces", F.size)).alias("_spans"))
    each = (counted.select("doc_id", "_pieces", F.posexplode_outer("_spans").alias("chunk_no", "_span"))
            .where("_span IS NOT NULL"))
    packed = F.flatten(F.slice("_pieces", F.col("_span.first") + 1,
                               F.col("_span.last") - F.col("_span.first")))
    return _finish(each.select("doc_id", "chunk_no", F.array_join(packed, " ").alias("text"),
                               F.size(packed).alias("n_tokens")))


def _fitted(text: str, count, size: int) -> list[tuple[str, int]]:
    """Parts of a text, each of at most ``size`` tokens, with their numbers of tokens: as many words as fit, and halves of
    words that do not fit alone."""
    n = count(text)
    if n <= size or len(text) < 2:
        return [(text, n)] if n else []
    spaced = regex.findall(SPACED, text)
    if len(spaced) < 2:
        half = len(text) // 2
        return _fitted(text[:half], count, size) + _fitted(text[half:], count, size)
    out: list[tuple[str, int]] = []
    held, total = [], 0
    for word in spaced:
        n = count(word)
        if held and total + n > size:
            out.append(("".join(held), total))
            held, total = [], 0
        if n > size:
            out += _fitted(word, count, size)
        else:
            held.append(word)
            total += n
    return out + ([("".join(held), total)] if held else [])


def _pieces_of(sentences: pa.Array, count, size: int) -> Iterator[pa.Array]:
    """Lists of the parts of each text's sentences and their numbers of tokens, by a few texts of the batch at a time."""
    for at in range(0, len(sentences), TEXTS_AT_ONCE):
        texts, sizes, offsets = [], [], [0]
        for many in sentences.slice(at, TEXTS_AT_ONCE).to_pylist():
            for part, n in (f for s in many or () for f in _fitted(s, count, size)):
                texts.append(part)
                sizes.append(n)
            offsets.append(len(texts))
        parts = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], names=["text", "n"])
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)


def chunk_tokens(docs: DataFrame, ranks: Ranks, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Whole sentences packed into chunks of at most ``size`` tokens of a vocabulary (from ``read_ranks``), where a chunk
    begins with the last sentences of the one before, up to ``overlap`` tokens.

    A sentence keeps the white space before it, so that chunks are parts of the text as it stands, and holds as many tokens
    in a chunk as alone. Longer sentences are cut between words, and a word longer than a chunk is halved until it fits: only
    there may the tokens of the text and those of its parts differ. Null and empty texts have no chunks."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    @arrow_udf("array<struct<text:string,n:int>>")
    def pieces(sentences: pa.Array) -> pa.Array:
        found = list(_pieces_of(sentences, token_counter(ranks), size))
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.struct([("text", pa.string()), ("n", pa.int32())])))

    cut = docs.select("doc_id", pieces(F.split("text", BREAK)).alias("_pieces"))
    counted = cut.select("doc_id", "_pieces", _spans(size, overlap)(F.col("_pieces.n")).alias("_spans"))
    each = (counted.select("doc_id", "_pieces", F.posexplode_outer("_spans").alias("chunk_no", "_span"))
            .where("_span IS NOT NULL"))
    own = F.slice("_pieces", F.col("_span.first") + 1, F.col("_span.last") - F.col("_span.first"))
    return _finish(each.select("doc_id", "chunk_no", F.array_join(F.transform(own, lambda p: p["text"]), "").alias("text"),
                               F.aggregate(own, F.lit(0), lambda n, p: n + p["n"]).alias("n_tokens")))
