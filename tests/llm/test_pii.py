"""Personal data: anchors and parsers against plain regular expressions."""

import random
import re

import pytest

from fiscolake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        odd, even = digits[-1::-2], digits[-2::-2]
        return 12 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), list(PATTERNS).index(k), m.end(), k) for k, p in PATTERNS.items()
             for m in re.finditer(p, text or "", re.ASCII) if passes(k, m.group())]
    return [(k, s, e) for s, _, e, k in sorted(found)]


@pytest.fixture(scope="module")
def anchors():
    return pii.automaton()


def base(text, anchors):
    return [s for s in pii.find(text, anchors) if s[0] in pii.BASE_KINDS]


def test_base_equals_patterns_on_random_texts(anchors):
    draw = random.Random(3)
    for signs in ("a1.@- +", "0123456789.", "19 -.", "+1 ().-", "ab@..", "4+@. 5", "1 2-3", "a%_@b-é.1\n"):
        for _ in range(3000):
            text = "".join(draw.choice(signs) for _ in range(draw.randrange(40)))
            assert base(text, anchors) == brute(text), text


def test_base_equals_patterns_on_given_texts(spark, anchors):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    found = [base(r.text, anchors) for r in rows]
    assert found == [brute(r.text) for r in rows]
    assert {k for spans in found for k, _, _ in spans} >= {"email", "ip", "card", "phone"}


@pytest.mark.parametrize("text, kind, value", [
    ("IBAN: DE89 3704 0044 0532 0130 00 thanks", "iban", "DE89 3704 0044 0532 0130 00"),
    ("iban GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
    ("Account no. 12", None, None),
    ("account 123-456-789, please", "account", "123-456-789"),
    ("accountant 123456789", None, None),
    ("ssn: 078-05-1120", "account", "078-05-1120"),
    ("see ftp://ana:secret@host/x", "login", "ana:secret"),
    ("see http://host:80/a@b", None, None),
    ("mailto:root@localhost", "mailbox", "root@localhost"),
    ("tel:555-123-4567;", "account", "555-123-4567"),
    ("IBAN DE89 3704 0044 0532 0130 01", None, None),
])
def test_cues_and_schemes(anchors, text, kind, value):
    added = [(k, text[s:e]) for k, s, e in pii.find(text, anchors) if k not in pii.BASE_KINDS]
    assert added == ([(kind, value)] if kind else [])


def test_long_texts_take_linear_work(anchors):
    for text in ("1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" * 150_000, "a" * 300_000 + "@", "account " * 40_000,
                 "1 " * 150_000, "account 1-" * 30_000, "iban DE89" + "A" * 300_000, "x://" * 75_000, "mailto:" * 40_000):
        assert isinstance(pii.find(text, anchors), list)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.c 1.2.3.4", "x"), (1, "a@b.c 1.2.3.4", "y"), (2, "", "z"), (3, None, None), (None, "iban", "")],
                                 "doc_id int, text string, spans string")
    rows = sorted(pii.spans(docs).collect(), key=lambda r: (r.doc_id or 0))
    assert [(r.doc_id, [(s.kind, s.value) for s in r.spans]) for r in rows] == [
        (None, []), *[(1, [("email", "a@b.c"), ("ip", "1.2.3.4")])] * 2, (2, []), (3, [])]
    masked = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert masked == {1: "<email> <ip>", 2: "", 3: None, None: "iban"}
    assert pii.spans(docs.limit(0)).count() == 0


def test_query(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op13_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = [f"{k}:{s}:{e}" for k, s, e in brute(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert r.n_email == sum(w.startswith("email") for w in want) and r.n_phone == sum(w.startswith("phone") for w in want)
