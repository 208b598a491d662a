import base64
import random

import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fiscolake.functions.merges import PIECE, count_tokens, merged, read_ranks
from fiscolake.functions.stems import english_stem, english_stems
from fiscolake.functions.tokens import terms
from fiscolake.operators import retrieve
from fiscolake.operators.chunk import TEXTS_AT_ONCE, _pieces_of, chunk_tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TEXTS = ["", " ", "one", "Hello world. It's 3.14 today!  Is it?\n\nYes, it's.\r\n\tEnd ", "maçã é água; ações\u00a0de 2024. 日本語のテキスト。",
         "a" * 5000, "ab " * 3000, " " * 3000 + "x" + "\n" * 2000, "😀" * 700 + ". " + "!?" * 500, "no stop " * 400, "x.y.z\x00 \x85 \u2028 q. " * 50]


@pytest.fixture(scope="module")
def ranks(spark):
    return read_ranks(spark, f"file://{VOCABULARY}")


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("test", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})


def test_ranks_are_those_of_the_file(ranks):
    with open(VOCABULARY, "rb") as lines:
        assert ranks == {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


def test_merges_match_the_library(ranks, library):
    @given(st.text(max_size=60) | st.text("aeinst .'\n", max_size=200))
    @settings(max_examples=300, deadline=None)
    def check(text):
        mine = [ranks[t] for w in regex.findall(PIECE, text) for t in merged(w.encode(), ranks)]
        assert mine == library.encode_ordinary(text)
    check()


def test_counts_of_whole_columns(spark, ranks, library):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id long, text string")
    got = {r.doc_id: r.n for r in docs.select("doc_id", count_tokens(docs.text, ranks).alias("n")).collect()}
    assert got == {**{i: len(library.encode_ordinary(t)) for i, t in enumerate(TEXTS)}, len(TEXTS): None}


@pytest.mark.parametrize("size,overlap", [(20, 0), (20, 7), (1024, 200), (1, 0)])
def test_chunks_of_tokens(spark, ranks, library, size, overlap):
    draw = random.Random(size + overlap)
    texts = TEXTS + ["".join(draw.choice(["word ", "two. ", "three!\n", "número ", "\n\n", "a.b "]) for _ in range(draw.randrange(400)))
                     for _ in range(30)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens int")
    found = {}
    for r in sorted(chunk_tokens(docs, ranks, size, overlap).collect(), key=lambda r: (int(r.doc_id), r.chunk_no)):
        found.setdefault(int(r.doc_id), []).append(r)
    for i, text in enumerate(texts):
        mine = found.pop(i, [])
        assert [r.chunk_no for r in mine] == list(range(len(mine))) and bool(mine) == bool(text)
        # Only what the vocabulary spells in more tokens than fit (one character) is longer than a chunk.
        assert all(r.n_tokens <= size or len(r.text) == 1 for r in mine)
        assert all(r.text in text for r in mine)
        if not overlap:
            assert "".join(r.text for r in mine) == text
        else:
            at = 0
            for r in mine:      # each chunk goes on where the last one ends, or somewhat before
                start = text.rfind(r.text, 0, at + len(r.text))
                assert start >= 0 and start + len(r.text) > at
                at = start + len(r.text)
            assert at == len(text)
        if size > 1 and text.isascii() and max(map(len, text.split() or [""])) < 12 and "   " not in text and "\n\n\n" not in text and text.isprintable():
            assert [r.n_tokens for r in mine] == [len(library.encode_ordinary(r.text)) for r in mine]
    assert not found


def test_chunks_need_an_overlap_below_their_size(spark, ranks):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert chunk_tokens(docs, ranks).count() == 0
    with pytest.raises(ValueError):
        chunk_tokens(docs, ranks, 10, 10)


# Published pairs of words and stems.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory
consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling
consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring
conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri
knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling
kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights
knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
ties tie cries cri gas gas gaps gap kiwis kiwi this this luxuriated luxuri hoped hope hopping hop hoping hope cry cri by by say say
generate generat generously generous communism communism communication communic arsenal arsenal skies sky dying die herring herring
proceeds proceed succeeding succeed early earli national nation nationality nation conditional condit rational ration vietnamization
vietnam relational relat decisiveness decis sensibility sensibl analogy analog hopefulness hope agreed agre bed bed shed shed youth youth
boyish boyish enjoy enjoy hesitancy hesit possibly possibl trouble troubl troubled troubl sized size falling fall controlling control
roll roll adoption adopt electricity electr formalize formal triplicate triplic goodness good allowance allow inference infer adjustment
adjust bowdlerize bowdler cease ceas rate rate""".split()


def test_stems():
    assert [(w, english_stem(w)) for w in STEMS[::2]] == list(zip(STEMS[::2], STEMS[1::2]))
    assert english_stem("john's") == english_stem("johns'") == "john" and english_stem("ção2") == "ção2"


def test_stems_of_lists(spark):
    rows = [(1, "The Connections connected: connecting"), (2, ""), (3, None), (4, "running " * 5000), (1, "knives")]
    docs = spark.createDataFrame(rows, "id int, text string")
    got = sorted((r.id, len(r.t or []), tuple(sorted(set(r.t or [])))) for r in docs.select("id", terms(docs.text, english_stems).alias("t")).collect())
    assert got == [(1, 1, ("knive",)), (1, 4, ("connect", "the")), (2, 0, ()), (3, 0, ()), (4, 5000, ("run",))]


def test_bm25_of_stems_is_bm25_of_stemmed_texts(spark):
    draw = random.Random(2)
    words = "connect connected connection run running runs happy happiness happily file files filing".split()
    texts = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 20)))) for i in range(50)]
    asked = [(i, " ".join(draw.choices(words, k=2))) for i in range(8)]

    def hits(change, **how):
        docs = spark.createDataFrame([(i, change(t)) for i, t in texts], "item_id long, text string")
        queries = spark.createDataFrame([(i, change(t)) for i, t in asked], "query_id long, text string")
        return sorted(tuple(r) for r in retrieve.bm25_topk(queries, docs, 5, **how).select("query_id", "rank", "item_id", "score").collect())

    found = hits(str, normalize=english_stems)
    assert found and found == hits(lambda t: " ".join(map(english_stem, t.split())))


def test_few_texts_of_a_batch_are_held_at_once():
    """Pieces come out as Arrow arrays of a bounded number of texts, however many a batch has."""
    texts = [["aa bb", "cc"], None, [], *[["aa"]] * (3 * TEXTS_AT_ONCE)]
    found = list(_pieces_of(pa.array(texts, pa.list_(pa.string())), lambda t: len(t.split()), 4))
    assert len(found) == 4 and max(map(len, found)) == TEXTS_AT_ONCE
    lists = pa.concat_arrays(found).to_pylist()
    assert lists[:3] == [[{"text": "aa bb", "n": 2}, {"text": "cc", "n": 1}], [], []] and len(lists) == len(texts)
