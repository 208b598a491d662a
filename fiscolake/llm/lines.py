"""Line dedup: an exact set-similarity join of lines, in DataFrame operations only.

A line is what stands between line feeds. Its tokens are its words, which blanks, tabs and carriage returns part. A line is removed if an earlier
line, in the order of (doc_id, digest of the text, position), has a Jaccard similarity of token sets of at least
``percent`` / 100, as every copy has. It does not matter whether that earlier line was itself removed. Lines of any
length are compared; a line without words parts others and always stays.

1. Lines of equal token sets are found by hash; sums and minima combine before the shuffle, so a line that a third of all
   rows hold is no hot key. Only the first of them goes on, and only if it has words enough that another set can reach
   the threshold at all: below percent / (100 - percent) words, one word more or less is too much.
2. Tokens are ordered by rarity: a table of 65,536 word classes with their counts over the whole corpus gives each
   token its rank. The table has that size whatever the input. Any total order makes the join exact; rarity only
   makes it cheap.
3. Each line has its prefix, the n - ceil(n * t) + 1 rarest tokens, the number of tokens and a parity map of the
   set, of 64 bits, and of 256 for long lines, whose pairs 64 bits would not tell apart. Lines are first held against a fixed number of early lines that share two neighbours of the prefix. So nearly
   all of a group of near copies is settled without forming its pairs.
4. Lines that this does not settle meet all earlier lines that share a prefix token, settled or not, and go on if
   lengths, places and parity maps leave the threshold possible. No line with a partner that reaches it is lost. Tokens are
   taken in a few parts, so that not all postings are shuffled at once.
5. Pairs that are left compare their whole prefixes; those that may still reach the threshold fetch their words and
   are verified.

Rows: rows without ``doc_id`` or text take no part and keep their lines. Rows of one ``doc_id`` are told apart by their
texts, in the order of a digest; rows that share the text, too, are one document, whose lines stand or fall together. Ties
do not arise, as positions differ. An empty table gives an empty result. Further columns are carried by ``stage``,
whatever their names, and never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.llm.common import free_name, given
from fiscolake.session import written_table

CLASSES = 65_536
PERCENT = 80
#: What names a line: its document, the text among those of one id, and the place in it.
LINE = ("doc", "twin", "pos")
HASH_BITS = 48
#: Pairs of neighbours in the prefix by which a line looks for an earlier one before the join. Any number gives the same rows.
CENTRE_KEYS = 2
#: Earlier lines per such pair that it is held against.
CENTRES = 8
#: Documents and line numbers (some 16 bytes each) that may go to every task; beyond that, texts are shuffled to them.
BROADCAST_ENTRIES = 500_000
#: Parts by token in which lines meet, one after the other, so that a fraction of the postings is on disk at once. Their number
#: is fixed, as each part reads all lines.
PARTS = 4
#: Words from which a line has a parity map of 256 bits. 64 bits of such lines differ by as much as the threshold allows.
WIDE = 96
#: What tells of a line's set in a pair: tokens, the parity map, and the last three quarters of the wide one.
MARKS = ("n", "map", "map1", "map2", "map3")


def plain(text: Column) -> Column:
    """The text with blanks for tabs and carriage returns, so that one character parts all words."""
    return F.replace(F.replace(text, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))


def twin_of(text: Column) -> Column:
    """60 bits of a digest, which tell (and order) texts that share an id."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def words_of(line: Column) -> Column:
    """Words of a plain line; runs of blanks leave empty words among them."""
    return F.split(line, " ")


def rarity_ranks(docs: DataFrame) -> DataFrame:
    """One row: key 0 and, for each class of words (a hash modulo 65,536), its place from 0 to 127 among the classes,
    rarest first.

    One number per class comes to the driver, whatever the size of the corpus, and 64 KB go back."""
    words = docs.select(F.explode(F.split(F.replace(plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = (words.select(F.xxhash64("w").bitwiseAND(F.lit(CLASSES - 1)).alias("c")).groupBy("c").count().toPandas())
    found = np.zeros(CLASSES, np.int64)
    found[counts["c"].to_numpy(int)] = counts["count"].to_numpy(int)
    ranks = np.empty(CLASSES, np.int64)
    ranks[np.argsort(found, kind="stable")] = np.arange(CLASSES)
    places = (ranks * 128 // CLASSES).tolist()
    return docs.sparkSession.createDataFrame([(0, places)], "zero long, ranks array<tinyint>")


def packed_tokens(words: Column) -> Column:
    """Different tokens of a line as sorted longs: rank first, then 48 bits of hash."""
    def pack(h: Column) -> Column:
        rank = F.get("ranks", h.bitwiseAND(F.lit(CLASSES - 1)).cast("int")).cast("long")
        return F.shiftleft(rank, HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))

    # Hashing in a step of its own: an expression used twice in a lambda is computed twice.
    hashes = F.array_remove(F.transform(words, lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))
    return F.sort_array(F.array_distinct(F.transform(hashes, pack)))


def _alike(percent: int) -> Column:
    """Do lengths and parity maps of columns n_a, map_a and n_b, map_b (and so on) leave the threshold possible?"""
    n = F.col("n_a") + F.col("n_b")
    length = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent

    def near(differ: Column) -> Column:
        return (n - differ) * (100 + percent) >= n * (2 * percent)

    changed, *quarters = (F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b")) for m in MARKS[1:])
    # The narrow map is the sum of the quarters of the wide one, so the first quarter is what the others leave of it.
    first = reduce(Column.bitwiseXOR, quarters, changed)
    return length & near(F.bit_count(changed)) & F.coalesce(near(sum(map(F.bit_count, quarters), F.bit_count(first))), F.lit(True))


def _before() -> Column:
    (doc_a, doc_b), (twin_a, twin_b), (pos_a, pos_b) = ((F.col(f"{c}_a"), F.col(f"{c}_b")) for c in LINE)
    return (doc_a < doc_b) | ((doc_a == doc_b) & ((twin_a < twin_b) | ((twin_a == twin_b) & (pos_a < pos_b))))


def _ends(*sides: str) -> list[str]:
    return [f"{c}_{s}" for s in sides for c in LINE]


def _side(frame: DataFrame, s: str) -> DataFrame:
    return frame.select(*[F.col(c).alias(f"{c}_{s}") for c in frame.columns])


def central_pairs(own: DataFrame, percent: int) -> DataFrame:
    """Pairs of each line with early lines that share two neighbours of its prefix: at most ``CENTRES`` per line and key,
    however many lines share the key. Lines of a key fall into that many parts, each of which gives its earliest."""
    pairs = F.transform(F.slice("prefix", F.lit(1), F.size("prefix") - 1),
                        lambda x, i: F.xxhash64(x, F.get("prefix", i + 1)))
    # The least hashes, as tokens that only one copy has come first in the prefix.
    keys = F.slice(F.array_sort(pairs), 1, CENTRE_KEYS)
    keyed = own.select(*LINE, *MARKS, F.explode_outer(keys).alias("key")).filter("key IS NOT NULL")
    part = F.pmod(F.xxhash64(*LINE), F.lit(CENTRES))
    earliest = (keyed.groupBy("key", part.alias("part"))
                .agg(F.min(F.struct(*LINE, *MARKS)).alias("c"), F.count("*").alias("k")))
    centres = (earliest.groupBy("key").agg(F.collect_list("c").alias("cs"), F.sum("k").alias("k")).filter("k > 1")
               .select("key", F.explode_outer("cs").alias("c"))
               .select("key", *[F.col(f"c.{c}").alias(f"{c}_a") for c in (*LINE, *MARKS)]))
    return (_side(keyed, "b").withColumnRenamed("key_b", "key").join(centres, "key").filter(_before() & _alike(percent))
            .select(*_ends("a", "b")).distinct())


def postings(flagged: DataFrame, part: int) -> DataFrame:
    """One row per line and token of its prefix, of the tokens in one of ``PARTS`` parts."""
    return (flagged.select(*LINE, *MARKS, "sign", F.posexplode_outer("prefix").alias("at", "token"))
            .filter(F.pmod("token", F.lit(PARTS)) == part)
            .select(*LINE, *MARKS, ((F.col("at") + 1) * F.col("sign")).alias("at"), "token"))


def similar_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of a line before another that may reach the threshold, without those whose later line is settled. The place
    ``at`` of a token is negative in settled lines."""
    n = F.col("n_a") + F.col("n_b")
    # At the first token two lines share, what follows is all they can share beside it.
    place = (1 + F.least(F.col("n_a") - F.abs("at_a"), F.col("n_b") - F.abs("at_b"))) * (100 + percent) >= n * percent
    a, b = _side(postings, "a"), _side(postings, "b")
    # That b is open, told by both sides: a filter of one side would part the shuffle that they share.
    unsettled = (F.col("at_b") > 0) & (F.col("at_a") != 0)
    return (a.join(b, (F.col("token_a") == F.col("token_b")) & unsettled & _before() & place & _alike(percent))
            .select(*_ends("a", "b")).distinct())


def hopeful_pairs(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes leave the threshold possible. Up to the smaller of the last tokens of both prefixes all that two
    lines share is known; beyond it they share at most what the shorter rest holds."""
    prefixes = own.select(*LINE, "n", "prefix")
    both = (pairs.join(_side(prefixes, "a"), _ends("a")).join(_side(prefixes, "b"), _ends("b"))
            .withColumn("end", F.least(F.element_at("prefix_a", -1), F.element_at("prefix_b", -1))))
    rest = [F.col(f"n_{s}") - F.size(F.filter(f"prefix_{s}", lambda x: x <= F.col("end"))) for s in "ab"]
    bound = F.size(F.array_intersect("prefix_a", "prefix_b")) + F.least(*rest)
    return both.filter(bound * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select(pairs.columns)


def _verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The later lines of the pairs whose words reach the threshold.

    The lines to fetch go to every task while they are few, which is counted first; beyond that, texts are shuffled to
    them. A document's needed lines are bounded by its lines."""
    ends = pairs.select(F.explode_outer(F.array(*[F.struct(*[F.col(f"{c}_{s}").alias(c) for c in LINE])
                                                  for s in "ab"])).alias("end")).select("end.*")
    needed = written_table(ends.groupBy("doc", "twin").agg(F.collect_set("pos").alias("needed")), "needed")
    size = needed.agg(F.count("*") + F.coalesce(F.sum(F.size("needed")), F.lit(0))).first()[0]
    small = size <= BROADCAST_ENTRIES
    lines = F.transform(F.split(plain(F.col("text")), "\n"), lambda line, i: F.when(F.array_contains("needed", i), line))
    words = (docs.join(F.broadcast(needed) if small else needed, ["doc", "twin"])
             .select("doc", "twin", F.posexplode_outer(lines).alias("pos", "line")).filter("line IS NOT NULL")
             .select(*LINE, F.array_remove(F.array_distinct(words_of(F.col("line"))), "").alias("words"))
             .dropDuplicates(list(LINE)))
    shared = F.size(F.array_intersect("words_a", "words_b"))
    return (pairs.join(_side(words, "a"), _ends("a")).join(_side(words, "b"), _ends("b"))
            .filter(shared * (100 + percent) >= (F.size("words_a") + F.size("words_b")) * percent)
            .select(*[F.col(f"{c}_b").alias(c) for c in LINE]).distinct())


def line_table(docs: DataFrame, percent: int) -> DataFrame:
    """One row per line with words: the columns that name it, two hashes of its token set, n, its parity maps and, where another set can
    reach the threshold, the prefix. The texts are not shuffled for it."""
    # The table of ranks has one row, and all documents share its key. It is applied per document, as each row handed
    # on carries it.
    ranked = docs.join(F.broadcast(rarity_ranks(docs)),
                       F.hash("doc").bitwiseAND(F.lit(0)).cast("long") == F.col("zero"))
    # One word changed in a longer line leaves it a near copy, so hashes of words suffice there. In shorter ones two
    # words of one hash must not make lines equal, and the words are hashed together.
    spelled = 2 * percent // (100 - percent) + 1
    read = F.transform(F.split(plain(F.col("text")), "\n"), lambda line: F.when(F.length(F.trim(line)) > 0, F.struct(
        packed_tokens(words_of(line)).alias("t"), line.alias("line"))))
    # Runs of blanks leave an empty word, which sorts first.
    spelling = F.trim(F.concat_ws(" ", F.array_sort(F.array_distinct(words_of(F.col("l.line"))))))
    lines = (ranked.select("doc", "twin", F.posexplode_outer(read).alias("pos", "l")).filter("l IS NOT NULL")
             .select(*LINE, "l.t", F.when(F.size("l.t") <= spelled, F.xxhash64(spelling)).alias("words")))
    n = F.size("t")

    def parity(tokens: Column | str) -> Column:
        return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))

    def quarter(k: int) -> Column:
        return F.when(n >= WIDE, parity(F.filter("t", lambda x: x.bitwiseAND(F.lit(192)) == 64 * k)))

    prefix = F.slice("t", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
    return lines.select(*LINE, F.xxhash64("t").alias("h1"), F.coalesce("words", F.xxhash64(F.lit(1), "t")).alias("h2"),
                        n.alias("n"), parity("t").alias("map"), *[quarter(k).alias(f"map{k}") for k in (1, 2, 3)],
                        F.when(n * (100 - percent) >= percent, prefix).alias("prefix"))


def removed_lines(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """(doc, twin, removed): the positions (from 0) that go, for every document that loses any; ``doc`` is the id, ``twin``
    is ``twin_of`` the text."""
    docs = (docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
            .select(F.col("doc_id").alias("doc"), twin_of(F.col("text")).alias("twin"), "text"))
    lines = written_table(line_table(docs, percent), "lines")
    firsts = (lines.groupBy("h1", "h2").agg(F.min(F.struct(*LINE)).alias("f"), F.count("*").alias("k")).filter("k > 1"))
    copies = lines.join(firsts, ["h1", "h2"]).filter(F.struct(*LINE) != F.col("f"))
    copied = written_table(copies.select(*LINE).distinct(), "copied")
    own = written_table(lines.filter("prefix IS NOT NULL").select(*LINE, *MARKS, "prefix")
                        .join(copied, list(LINE), "left_anti").dropDuplicates(list(LINE)), "own")
    central = written_table(_verified(docs, written_table(central_pairs(own, percent), "central"), percent), "settled")
    sign = F.when(F.col("found"), -1).otherwise(1)
    flagged = written_table(own.join(central.withColumn("found", F.lit(True)), list(LINE), "left")
                            .select(*LINE, *MARKS, "prefix", sign.alias("sign")), "flagged")
    pairs = reduce(DataFrame.unionAll, [written_table(similar_pairs(postings(flagged, k), percent), "pairs")
                                        for k in range(PARTS)]).distinct()
    pairs = written_table(hopeful_pairs(pairs, own, percent).distinct(), "hopeful")
    # A line that goes takes its copies with it, which are gone already.
    gone = copied.unionAll(central).unionAll(_verified(docs, pairs, percent))
    return gone.groupBy("doc", "twin").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def kept_text(text: Column, removed: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(removed, i)), "\n")


def _with_removed(docs: DataFrame, gone: DataFrame, twin: Column) -> tuple[DataFrame, str]:
    """``docs``, whose texts have the digest ``twin``, with the positions that go, in a column whose name comes second."""
    names = {c: free_name(docs.columns, f"line_{c}") for c in gone.columns}
    gone = gone.select(*[F.col(c).alias(names[c]) for c in gone.columns])
    same = (F.col("doc_id") == F.col(names["doc"])) & (twin == F.col(names["twin"]))
    return docs.join(gone, same, "left").select(*docs.columns, names["removed"]), names["removed"]


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, how many go, and which."""
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    # The join takes digests and numbers of lines; texts stay where they are.
    counted = docs.select("doc_id", twin_of(F.col("text")).alias("digest"),
                          F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    told, removed = _with_removed(counted, written_table(removed_lines(docs), "removed"), F.col("digest"))
    return told.select("doc_id", "n_lines",
                       F.coalesce(F.size(removed), F.lit(0)).alias("n_removed"),
                       F.coalesce(F.array_join(removed, ","), F.lit("")).alias("removed"))


OP10_SQL = r"""
WITH given AS (
    SELECT row_number() OVER () AS r, doc_id, substr(md5(text), 1, 15) AS twin, string_split(text, chr(10)) AS l FROM documents),
line AS (
    SELECT DISTINCT doc_id, twin, i AS pos, replace(replace(l[i + 1], chr(9), ' '), chr(13), ' ') AS line
    FROM (SELECT *, unnest(range(len(l))) AS i FROM given WHERE doc_id IS NOT NULL) x),
worded AS (
    SELECT doc_id, twin, pos, list_sort(list_distinct(regexp_extract_all(line, '[^ ]+'))) AS w FROM line WHERE trim(line) <> ''),
numbered AS (SELECT *, min((doc_id, twin, pos)) OVER (PARTITION BY w) AS f FROM worded),
firsts AS (SELECT * FROM numbered WHERE f = (doc_id, twin, pos)),
token AS (SELECT doc_id, twin, pos, len(w) AS n, unnest(w) AS t FROM firsts),
often AS (SELECT t, count(*) AS c FROM token GROUP BY t),
prefix AS (
    SELECT * FROM (
        SELECT token.*, row_number() OVER (PARTITION BY doc_id, twin, pos ORDER BY c, t) AS place FROM token JOIN often USING (t)) x
    WHERE place <= n - ceil(n * 80 / 100.0) + 1),
pair AS (
    SELECT DISTINCT a.doc_id AS da, a.twin AS ta, a.pos AS pa, b.doc_id AS db, b.twin AS tb, b.pos AS pb
    FROM prefix a JOIN prefix b ON a.t = b.t AND (a.doc_id, a.twin, a.pos) < (b.doc_id, b.twin, b.pos)
        AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
gone AS (
    SELECT doc_id, twin, pos FROM numbered WHERE f <> (doc_id, twin, pos)
    UNION
    SELECT db, tb, pb FROM pair JOIN firsts a ON (a.doc_id, a.twin, a.pos) = (da, ta, pa)
        JOIN firsts b ON (b.doc_id, b.twin, b.pos) = (db, tb, pb)
    WHERE len(list_intersect(a.w, b.w)) * 180 >= (len(a.w) + len(b.w)) * 80)
SELECT given.doc_id, CAST(coalesce(any_value(len(l)), 0) AS INTEGER) AS n_lines, CAST(count(g.pos) AS INTEGER) AS n_removed,
    coalesce(string_agg(CAST(g.pos AS VARCHAR), ',' ORDER BY g.pos), '') AS removed
FROM given LEFT JOIN gone g ON given.doc_id = g.doc_id AND given.twin = g.twin GROUP BY given.r, given.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later lines, ``n_chars`` counted anew. A document that loses every line goes; one that
    had no text stays."""
    told, removed = _with_removed(docs, written_table(removed_lines(docs), "removed"), twin_of(F.col("text")))
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col(removed)))
    out = told.filter(F.col(removed).isNull() | (F.size(removed) < F.size(F.split("text", "\n"))))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])
