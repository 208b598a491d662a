"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: text between the tags of block elements, with the names, classes, ids and roles of the
elements around it. Scripts, styles and comments are no text; character references are decoded once; white space
(no-break spaces too) becomes one blank. Each block gets features of its ancestors and of its text; the field gives
every block one of two labels, main or other, with weights for features and for neighbouring labels. It is trained by
gradient steps on the exact likelihood over pages whose labels are known, and pages are decoded by Viterbi.

``labelled_pages`` draws the training pages from a seeded set of layouts (articles in several containers, beside menus,
headers, footers, sidebars, notices, adverts, forms, reader comments); ``train`` takes any other labelled pages.

Rows: a null or empty page, and one without main blocks, gives an empty text. Tags that are not closed, or closed
without being open, are read as browsers read them in the cases that occur: paragraphs, list items and cells end where
the next one begins. A quote that never closes is a character of its tag. Repeated rows give equal results; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.llm.common import given, small_batches

#: Attributes up to the end of a tag. A quote opens a value only after an equals sign; elsewhere it is a character.
ATTRIBUTES = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
#: Comments, elements without readable text (to their end, or the end of the page; those closed in their own tag hold
#: nothing), and tags.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b(?!-)" + ATTRIBUTES
    + r"(?:(?<=/)>|>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<([/!?]?)([a-zA-Z][a-zA-Z0-9:-]*)(" + ATTRIBUTES + r")(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where another of these begins.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                     "main nav ol pre section table ul".split())


@dataclass
class Block:
    path: str       # ancestors from the outside in, joined by blanks
    text: str
    linked: int     # characters inside links


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in its order."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = [("", "")]
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(stack[-1][1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    for m in MARKUP.finditer(page):
        start = m.start()
        if start > at:
            parts.append(page[at:start])
            linked += (start - at) if in_link else 0
        at = m.end()
        tag = m.group(3)
        if tag is None or m.group(2) in ("!", "?"):
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if m.group(2) else 1
        elif m.group(2):
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            flush()
            ends = ENDS.get(tag, {"p"} if tag in CLOSES_P else ())
            while ends and len(stack) > 1 and stack[-1][0] in ends:
                stack.pop()
            if tag not in VOID:
                names = ""
                if m.group(4):
                    names = "".join(f" .{w}" for found in NAMED.findall(m.group(4))
                                    for w in re.findall(r"[a-z]+", "".join(found).lower()))
                stack.append((tag, f"{stack[-1][1]} {tag}{names}"))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _bin(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def ancestor_features(path: str) -> list[str]:
    names = path.split()
    tags = [n for n in names if n[0] != "."]
    return [f"in:{n}" for n in set(names)] + [f"tag:{tags[-1] if tags else ''}", "bias"]


def text_features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    return [f"chars:{_bin(n, (10, 25, 60, 140, 300))}", f"links:{_bin(block.linked / n, (0.05, 0.3, 0.7))}",
            f"ends:{text[-1] if text[-1] in '.!?:;…' else 'x'}", f"commas:{_bin(text.count(','), (1, 3, 8))}",
            *(["sign:c"] if "©" in text else []), *(["sign:bar"] if "|" in text else [])]


@dataclass
class Field:
    """Weights: per feature for the label main over other, and for a label after a label."""

    weight: dict[str, float] = field(default_factory=dict)
    follow: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    of_path: dict[str, float] = field(default_factory=dict)

    def lean(self, block: Block) -> float:
        w = self.weight
        known = self.of_path.get(block.path)
        if known is None:
            known = sum(w.get(f, 0.0) for f in ancestor_features(block.path))
            if len(self.of_path) < 10_000:
                self.of_path[block.path] = known
        return known + sum(w.get(f, 0.0) for f in text_features(block))

    def decode(self, found: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks; ties go to other."""
        if not found:
            return []
        (oo, om), (mo, mm) = self.follow.tolist()
        other, main = 0.0, self.lean(found[0])
        back = []
        for b in found[1:]:
            back.append((int(main + mo > other + oo), int(main + mm > other + om)))
            other, main = max(other + oo, main + mo), max(other + om, main + mm) + self.lean(b)
        labels = [int(main > other)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, main in zip(found, self.decode(found)) if main)


def train(pages: list[tuple[list[Block], list[int]]], *, steps: int = 150, rate: float = 0.15,
          penalty: float = 0.002) -> Field:
    """Gradient steps (Adam) on the mean log-likelihood of whole pages, by forward and backward sums."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows, chains, longest = [], [], max((len(b) for b, _ in pages), default=0)
    for found, labels in pages:
        for b in found:
            rows.append([names.setdefault(f, len(names)) for f in (*ancestor_features(b.path), *text_features(b))])
        chains.append(labels)
    if not names:
        return Field()
    lengths = np.array([len(c) for c in chains])
    first = np.concatenate(([0], np.cumsum(lengths)))
    of_row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate([np.array(r) for r in rows])
    truth = np.concatenate([np.array(c) for c in chains])
    w, follow = np.zeros(len(names)), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(follow)], [np.zeros_like(w), np.zeros_like(follow)]
    true_follow = np.zeros((2, 2))
    for c in chains:
        np.add.at(true_follow, (c[:-1], c[1:]), 1)
    for step in range(1, steps + 1):
        lean = np.bincount(of_row, w[feature], len(rows))
        score = np.zeros((len(chains), longest, 2))
        inside = np.arange(longest)[None, :] < lengths[:, None]
        score[..., 1][inside] = lean
        alpha = np.zeros_like(score)
        alpha[:, 0] = score[:, 0]
        for t in range(1, longest):
            alpha[:, t] = score[:, t] + np.logaddexp.reduce(alpha[:, t - 1, :, None] + follow[None], axis=1)
        beta = np.zeros_like(score)
        for t in range(longest - 2, -1, -1):
            after = np.logaddexp.reduce(follow[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(inside[:, t + 1, None], after, 0.0)
        last = alpha[np.arange(len(chains)), lengths - 1]
        total = np.logaddexp(last[:, 0], last[:, 1])
        p_main = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None])[inside]
        pair = (alpha[:, :-1, :, None] + follow[None, None] + (score[:, 1:] + beta[:, 1:])[:, :, None, :]
                - total[:, None, None, None])
        expected = (np.exp(np.minimum(pair, 0)) * inside[:, 1:, None, None]).sum((0, 1))
        gradient = [np.bincount(feature, (truth - p_main)[of_row], len(names)) / len(chains) - penalty * w,
                    (true_follow - expected) / len(chains) - penalty * follow]
        for i, (value, g) in enumerate(zip((w, follow), gradient)):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            value += rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    return Field(dict(zip(names, w.tolist())), follow)


def labelled_pages(count: int = 320, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Pages of many layouts; main text is wrapped in a mark that is taken off again to give the labels."""
    draw = random.Random(seed)
    syllables = "ka lo mi ter an so ve ri du ne pal os in ger tu".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(draw.randint(low, high)))

    def sentence(low: int = 4, high: int = 25) -> str:
        return words(low, high).capitalize() + (", " + words(2, 8) if draw.random() < 0.5 else "") + draw.choice("....?!")

    def noisy(text: str) -> str:
        """Text as it comes: without a full stop, in capitals, with signs at the words, as a row of a table."""
        kind = draw.random()
        if kind < 0.12:
            return text.rstrip(".?!,")
        if kind < 0.2:
            return " ".join(w + draw.choice(("&amp;", "***", "$$$", "%%%", "###")) for w in text.split())
        if kind < 0.26:
            return text.upper().replace(" ", "!! ")
        return text.replace(" ", " | ") if kind < 0.3 else f"&copy; {text}" if kind < 0.32 else text

    def main(inner: str) -> str:
        return f"\x01{noisy(inner)}"

    def paragraphs(n: int) -> str:
        out = []
        for _ in range(n):
            kind = draw.random()
            body = " ".join(sentence() for _ in range(draw.randint(1, 5))) if draw.random() < 0.75 else words(1, 3).capitalize() + "."
            if kind < 0.75:
                out.append(f"<p>{main(body)}</p>" if draw.random() < 0.8 else f"<p><b>{main(body)}<br>")
            elif kind < 0.83:
                out.append("<ul>" + "".join(f"<li>{main(sentence(2, 12))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                out.append(f"<h2>{main(words(2, 6).capitalize())}</h2>")
            elif kind < 0.95:
                out.append(f"<blockquote>{main(body)}</blockquote>")
            else:
                out.append("<table><tr>" + "".join(f"<td>{main(words(1, 3))}</td>" for _ in range(3)) + "</tr></table>")
        return "".join(out)

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 2)}</a></li>' for _ in range(n)) + "</ul>"

    def box(names: str, inner: str) -> str:
        return f'<div {draw.choice(("class", "id"))}="{draw.choice(names.split())}">{inner}</div>'

    out = []
    for _ in range(count):
        some = lambda p, s: s if draw.random() < p else ""
        menu = draw.choice((f"<nav>{links(draw.randint(3, 8))}</nav>", box("menu nav navigation breadcrumb", links(5))))
        head = some(0.6, draw.choice((f"<header><h1>{words(1, 3)}</h1><p>{sentence(3, 9)}</p></header>",
                                      box("header masthead topbar", f"<p>{sentence(3, 9)}</p>"))))
        advert = box("ad ads advert advertisement banner sponsor promo", noisy(draw.choice((
            sentence(3, 20), f"<p>{sentence()}</p>", " ".join(sentence() for _ in range(draw.randint(2, 5)))))))
        notice = some(0.4, box("notice cookie consent alert gdpr", f"<p>{sentence(8, 20)}</p><button>{words(1, 2)}</button>"))
        side = some(0.5, draw.choice((f"<aside><h3>{words(1, 3)}</h3>{links(4)}<p>{sentence()}</p></aside>",
                                      box("sidebar related widget recommended", f"<h3>{words(1, 3)}</h3><p>{sentence()}</p>" + links(3)))))
        form = some(0.4, f'<form><label>{words(1, 3)}</label><input name="q"><p>{sentence(3, 12)}</p><button>{words(1, 1)}</button></form>')
        said = "".join(f'<div class="comment"><p>{" ".join(sentence() for _ in range(draw.randint(1, 4)))}</p></div>' for _ in range(3))
        comments = some(0.4, draw.choice((f'<section id="comments"><h3>{words(1, 2)}</h3>{said}</section>', box("comments responses replies", said))))
        foot = draw.choice((f"<footer>&copy; {words(1, 2)}. {sentence(3, 12)}</footer>",
                            box("footer copyright legal", f"<p>&copy; {sentence(3, 12)}</p>" + links(3))))
        title = words(2, 9).capitalize()
        body = f"<h1>{main(title)}</h1>" + paragraphs(draw.randint(1, 6)) + some(0.3, advert)
        body += paragraphs(draw.choice((0, 0, 2, 5, 8)))
        body += some(0.25, box("share social tags", links(3)))
        inside = some(0.15, comments)
        kind = draw.random()
        article = (f"<article>{body}{inside}</article>" if kind < 0.5 else f"<main>{body}{inside}</main>" if kind < 0.65 else
                   box("content article post entry story main", body + inside) if kind < 0.85 else
                   box("page wrapper container text body column", body + inside) if kind < 0.95 else f"<div>{body}{inside}</div>")
        order = [head, menu, notice, some(0.6, advert), *draw.sample([article, side], 2), form, some(0.7, comments), foot]
        if draw.random() < 0.1:    # nothing around the article
            order = [article]
        page = (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
                f"<body>{''.join(order)}</body></html>")
        found = blocks(page)
        labels = [int(b.text.startswith("\x01")) for b in found]
        out.append(([Block(b.path, b.text.lstrip("\x01"), b.linked) for b in found], labels))
    return out


def extract(spark: SparkSession, model: Field):
    """A function of the html column: the main text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def main_text(pages: pd.Series) -> pd.Series:
        return pd.Series([sent.value.text(p) for p in pages], dtype=object)

    return main_text


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    main_text = extract(spark, train(labelled_pages()))
    return (given(spark, sf_dir, "pages").select("page_id", "url", main_text("html").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
