from html import unescape
from urllib.parse import urljoin, urlparse

from hypothesis import given, settings
from hypothesis import strategies as st

from fiscolake.functions import html as H
from fiscolake.functions import urls as U
from fiscolake.operators import crawl
from fiscolake.plans.web import crawl_to_json

BASES = ["https://www.gov.br/a/b/c?x=1#top", "http://h.example:8080", "https://h.example/", "http://h/a//b/",
         "https://user@h.example/x.html"]
LINKS = ["", "d", "../up", "../../../up", "./x/./y/../z", "/root/./a/../b", "//other.example/z", "?q=1", "#f",
         "mailto:a@b.example", "javascript:void(0)", "http://abs.example/p?q#f", "https:rel", "..", ".", "/", "a//b",
         "x/..", "/..", "d?u=http://v/w", " d ", "tel:+55", "/a/b/.."]


def test_resolve_matches_the_standard_library(column):
    pairs = [(b, l) for b in BASES for l in LINKS]
    want = [urljoin(b, l.strip()) for b, l in pairs]
    got = column(U.resolve, pairs)
    assert [(p, g, w) for p, g, w in zip(pairs, got, want) if g != w] == []


def test_resolve_property(column):
    part = st.sampled_from(["a", "b.c", "..", ".", "x y", "é"])
    paths = st.lists(st.tuples(st.booleans(), st.lists(part, min_size=1, max_size=6),
                               st.sampled_from(["", "?q", "#f", "?q#f"])), min_size=20, max_size=20)

    @given(paths)
    @settings(max_examples=5, deadline=None)
    def check(links):
        pairs = [("https://h.example/p/q/r", ("/" if root else "") + "/".join(parts) + tail)
                 for root, parts, tail in links]
        assert column(U.resolve, pairs) == [urljoin(b, l) for b, l in pairs]
    check()


def test_authority_and_fragment(column):
    urls = ["https://u@h.example:80/p?q#f", "mailto:a@b", "//h/p", ""]
    assert column(U.authority, urls) == [urlparse(u).netloc for u in urls]
    assert column(U.without_fragment, urls) == [u.split("#", 1)[0] for u in urls]


def test_entities(column):
    texts = ["a &amp; b", "&lt;p&gt; &copy;2024", "&#233;&#xE9;&#X1F600;", "x &unknown; &am y &amp", "no", "",
             "AT&T &amp;amp;", "&nbsp;&middot;"]
    assert column(H.decode_entities, texts) == [unescape(t) for t in texts]


PAGE = """<!DOCTYPE html><html><head><title>
  Imposto &amp; Renda </title><script>var t = "<a href='/no'>x</a>";</script>
<meta content="Uma descri&ccedil;&atilde;o" name="description"><STYLE>p{}</STYLE></head>
<body><!-- <a href="/comment">c</a> --><p>Um<b>a</b>  frase.</p><a href="/root">r</a>
<A class=x HREF='../up?a=1&amp;b=2#f'>u</A><a href=//other.gov.br:8080/z>o</a><a href="mailto:x@y">m</a>
<a name="n">none</a><a href="https://else.example/">e</a><a href="#top">t</a><a data-href="/d" href="">s</a>
<article><h1>T</h1> corpo</article></body></html>"""


def test_page_columns(column):
    url = "https://www.gov.br/a/b/c"
    assert column(H.page_title, [PAGE, "<p>x</p>", "<title> </title>"]) == ["Imposto & Renda", None, None]
    swapped = '<meta name="description" content=\'d "q"\'/>'
    assert column(H.page_description, [PAGE, swapped, "<meta name='keywords' content='k'>", "<meta name=description>"]) == [
        "Uma descrição", 'd "q"', None, None]
    assert column(H.page_text, [PAGE])[0] == (
        "Imposto & Renda Um a frase. r u o m none e t s T corpo")
    assert column(H.main_text, [PAGE, "<p>só</p>", "<main class='m'>x<br>y</main>z"]) == ["T corpo", "só", "x y"]
    links = column(lambda u, h: H.page_links(u, h, "gov.br"), [(url, PAGE)])[0]
    assert links == ["https://www.gov.br/root", "https://www.gov.br/a/up?a=1&b=2",
                     "https://www.gov.br/a/b/c", "https://www.gov.br/a/b/c"]
    ported = column(lambda u, h: H.page_links(u, h, "gov.br:8080"), [(url, PAGE)])[0]
    assert ported == ["https://other.gov.br:8080/z"]


SITE = {
    "http://s.gov.br/x/": '<a href="a">a</a><a href="/y/out">o</a>',
    "http://s.gov.br/x/a": '<a href="b#part">b</a><a href="/x/">home</a><a href="missing">m</a>',
    "http://s.gov.br/x/b": '<a href="a">cycle</a><a href="b">self</a><a href="c">c</a>',
    "http://s.gov.br/x/c": "<p></p>",
    "http://s.gov.br/x/island": '<a href="a">in</a>',
    "http://s.gov.br/y/out": '<a href="/x/island">back</a>',
}


def _site(spark):
    return spark.createDataFrame(list(SITE.items()), "url string, html string")


def test_crawl(spark):
    found = {r.url for r in crawl.crawl(_site(spark), "http://s.gov.br/x/", "gov.br").collect()}
    assert found == {f"http://s.gov.br/x/{n}" for n in ("", "a", "b", "c")}
    assert crawl.reachable(_site(spark), "http://s.gov.br/none", "gov.br").count() == 0


def test_crawl_hub(spark):
    """Every page links to one hub, which links to every page."""
    n = 300
    rows = [("http://h.gov.br/", "".join(f'<a href="/{i}">x</a>' for i in range(n)))]
    rows += [(f"http://h.gov.br/{i}", '<a href="/">hub</a>' * 3) for i in range(n)]
    pages = spark.createDataFrame(rows, "url string, html string")
    assert crawl.reachable(pages, "http://h.gov.br/", "gov.br").count() == n + 1


def test_page_records_and_json(spark, tmp_path):
    records = {r.url: r for r in crawl.page_records(_site(spark)).collect()}
    assert records["http://s.gov.br/x/"].text == "a o" and records["http://s.gov.br/x/"].title is None
    n = crawl_to_json(_site(spark), str(tmp_path / "out"), "http://s.gov.br/x/", "gov.br")
    back = spark.read.json(str(tmp_path / "out"))
    assert n == back.count() == 3  # the page without text is left out
    assert {r.host for r in back.collect()} == {"s.gov.br"}
