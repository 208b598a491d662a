"""Personal data: anchors found by Aho-Corasick, expanded by local parsers.

One pass of an automaton over a text finds the anchors: at-signs, plus signs, digits, schemes (``://``, ``mailto:``,
``tel:``) and cue words of identifiers (``iban``, ``account``, ``ssn`` and the like, a parameter). A parser of the anchor's
kind walks left and right from it, decides where the address, number or account begins and ends, and checks it. Each
parser remembers where its last span ended, so the work is linear in the text however many anchors it holds.

Base kinds, leftmost and not overlapping within a kind; a match that fails its check is passed over whole:

- ``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
- ``ip``     four runs of digits with dots between, none above 255
- ``card``   12 to 19 digits, one blank or hyphen between two at most, passing Luhn
- ``phone``  ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 9 to 15 digits

Added kinds, which only cues and schemes reveal:

- ``iban``    two letters, two digits, 11 to 30 further letters or digits in groups, passing the remainder test (mod 97)
- ``account`` after a cue word and at most a few separators: letters, digits, hyphens, dots or slashes with 6 digits at least
- ``login``   ``user:password@`` after a scheme
- ``mailbox`` an address after ``mailto:`` that is no base email, such as one of a host without a dot

Rows: one per row given, repeated ones too. A null or empty text has no spans; its digest is that of the empty string. Ids
are handed on as they are, null ones too; other columns are not read, whatever their names. Texts are searched whole;
an empty table gives an empty result. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.llm.common import given, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account", "login", "mailbox")
#: Words that announce an identifier, in lower case.
CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "conta", "ssn", "passport", "cpf", "cnpj",
        "social security", "customer id", "tax id")

DIGIT = frozenset(string.digits)
WORD = frozenset(string.ascii_letters + string.digits)
LOCAL = WORD | frozenset("._%+-")
HOST = WORD | frozenset("-")
DIAL = DIGIT | frozenset(" ().-")
IDENTIFIER = WORD | frozenset("-./")
BETWEEN = frozenset(" \t:#=.")
MAX_BETWEEN = 8
CLOSING = frozenset(" \t\n\x0b\x0c\r/?#<>\"'")


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters from ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, allowed: frozenset, floor: int) -> int:
    """Start of the run of allowed characters that ends at ``at``, not before ``floor``."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _domain(text: str, at: int) -> int:
    """End of a host with a dot that starts at ``at``; 0 if there is none."""
    end = _run(text, at, HOST)
    if end == at:
        return 0
    dots = 0
    while text[end:end + 1] == ".":
        more = _run(text, end + 1, HOST)
        if more == end + 1:
            break
        end, dots = more, dots + 1
    return end if dots else 0


class Finder:
    """The parsers over one text, each with the place it has read up to."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[tuple[int, int, int]] = []  # start, kind's place in KINDS, end
        self.email_end = self.ip_at = self.card_at = self.phone_at = self.account_at = self.iban_at = 0

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans.append((start, KINDS.index(kind), end))

    def email(self, at: int) -> None:
        start = _back(self.text, at, LOCAL, self.email_end)
        end = _domain(self.text, at + 1) if start < at else 0
        if end:
            self.add("email", start, end)
            self.email_end = end

    def digit(self, at: int) -> None:
        if at >= self.card_at:
            self.card(at)
        if at >= self.ip_at:
            self.ip(at)

    def card(self, at: int) -> None:
        text, end, digits = self.text, at, []
        while True:
            stop = _run(text, end, DIGIT)
            digits.append(text[end:stop])
            if text[stop:stop + 1] in (" ", "-") and text[stop + 1:stop + 2] in DIGIT:
                end = stop + 1
            else:
                break
        self.card_at = stop
        number = "".join(digits)
        if 12 <= len(number) <= 19 and luhn(number):
            self.add("card", at, stop)

    def ip(self, at: int) -> None:
        text, starts, end = self.text, [at], _run(self.text, at, DIGIT)
        first, parts = end, [text[at:end]]
        while len(parts) < 4 and text[end:end + 1] == "." and text[end + 1:end + 2] in DIGIT:
            starts.append(end + 1)
            end = _run(text, end + 1, DIGIT)
            parts.append(text[starts[-1]:end])
        if len(parts) < 4:
            self.ip_at = first  # the next run may begin four parts of its own
            return
        self.ip_at = end
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            self.add("ip", at, end)

    def plus(self, at: int) -> None:
        text = self.text
        if at < self.phone_at or text[at + 1:at + 2] not in DIGIT:
            return
        end = _back(text, _run(text, at + 2, DIAL), DIAL - DIGIT, at + 2)
        if end < at + 4:
            return
        self.phone_at = end
        if 9 <= sum(c in DIGIT for c in text[at:end]) <= 15:
            self.add("phone", at, end)

    def cue(self, at: int, end: int) -> None:
        """The identifier after a cue word that stands by itself."""
        text = self.text
        if (at and text[at - 1] in WORD) or text[end:end + 1] in WORD or end <= self.account_at:
            return
        start, limit = end, end + MAX_BETWEEN
        while start < limit and text[start:start + 1] in BETWEEN:
            start += 1
        if start == end:
            return
        if self.iban(start):
            return
        stop = _back(text, _run(text, start, IDENTIFIER), frozenset("-./"), start)
        if sum(c in DIGIT for c in text[start:stop]) >= 6:
            self.add("account", start, stop)
            self.account_at = stop

    def iban(self, at: int) -> bool:
        """Letters and digits from ``at``, single blanks between groups, whose longest valid prefix of groups counts."""
        text = self.text
        head = text[at:at + 4]
        if at < self.iban_at or len(head) < 4 or not (head.isascii() and head[:2].isalpha() and head[2:].isdigit()):
            return False
        compact, end, best = "", at, 0
        while len(compact) <= 34:
            stop = _run(text, end, WORD)
            if stop == end:
                break
            compact += text[end:stop].upper() if stop - end <= 34 else "X" * 35
            if 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1:
                best = stop
            if text[stop:stop + 1] != " ":
                break
            end = stop + 1
        if best:
            self.add("iban", at, best)
            self.iban_at = best
        return bool(best)

    def scheme(self, end: int) -> None:
        """``user:password@`` after ``://``."""
        text, n, at, colon = self.text, len(self.text), end, -1
        while at < n and text[at] not in CLOSING and text[at] != "@":
            colon = at if colon < 0 and text[at] == ":" else colon
            at += 1
        if at < n and text[at] == "@" and end < colon < at - 1:
            self.add("login", end, at)

    def mailto(self, end: int) -> None:
        at = _run(self.text, end, LOCAL)
        if at > end and self.text[at:at + 1] == "@" and not _domain(self.text, at + 1):
            stop = _run(self.text, at + 1, HOST)
            if stop > at + 1:
                self.add("mailbox", end, stop)

    def tel(self, end: int) -> None:
        """A number after ``tel:`` without the plus sign that would make it a base phone."""
        stop = _back(self.text, _run(self.text, end, DIAL), DIAL - DIGIT, end)
        if 6 <= sum(c in DIGIT for c in self.text[end:stop]) <= 15:
            self.add("account", end, stop)


def automaton(cues: Sequence[str] = CUES):
    """Anchors and what they are; cue words in lower case, upper case and with a capital."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign, kind in (("@", "email"), ("+", "plus"), ("://", "scheme"), ("mailto:", "mailto"), ("tel:", "tel")):
        found.add_word(sign, (kind, len(sign)))
    for d in string.digits:
        found.add_word(d, ("digit", 1))
    for cue in cues:
        for form in {cue.lower(), cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def find(text: str | None, anchors) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of a text, by start and then by kind."""
    if not text:
        return []
    finder = Finder(text)
    for last, (kind, length) in anchors.iter(text):
        if kind in ("scheme", "mailto", "tel"):
            getattr(finder, kind)(last + 1)
        elif kind == "cue":
            finder.cue(last + 1 - length, last + 1)
        else:
            getattr(finder, kind)(last)
    return [(KINDS[kind], start, end) for start, kind, end in sorted(set(finder.spans))]


def spans(docs: DataFrame, cues: Sequence[str] = CUES) -> DataFrame:
    """Per row of ``doc_id, text``: ``doc_id`` and ``spans``, an array of (kind, start, end, value)."""
    cues = tuple(cues)

    span = pa.struct([("kind", "string"), ("start", "int64"), ("end", "int64"), ("value", "string")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton(cues)
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in find(t, anchors)]
                     for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "spans": pa.array(found, pa.list_(span))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        search, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,value:string>>")


def redacted(docs: DataFrame, cues: Sequence[str] = CUES) -> DataFrame:
    """Per row: ``doc_id`` and the text with every span replaced by its kind in angle brackets; of overlapping spans the
    one that starts first, then the longest, then the first kind. Null texts stay null."""
    cues = tuple(cues)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton(cues)
        for b in batches:
            out = []
            for text in b["text"].to_pylist():
                parts, at = [], 0
                for kind, start, end in sorted(find(text, anchors), key=lambda s: (s[1], -s[2])):
                    if start >= at:
                        parts += [text[at:start], f"<{kind}>"]
                        at = end
                out.append(text if not parts else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "text": pa.array(out, "string")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(mask, f"doc_id {kind}, text string")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of their places, and the places of all spans, per document."""
    small_batches(spark)
    def count(kind: str) -> Column:
        return F.size(F.filter("placed", lambda p: p["kind"] == kind)).cast("long")

    placed = F.transform("spans", lambda s: F.struct(
        s["kind"].alias("kind"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("place")))
    base = F.filter("placed", lambda p: p["kind"].isin(*BASE_KINDS))
    rows = spans(given(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long"), placed.alias("placed"))
    return rows.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, lambda p: p["place"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("placed", lambda p: p["place"]), ",").alias("spans"))
