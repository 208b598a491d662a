"""Page columns: links, title, description and readable text of stored HTML."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiscolake.functions.urls import authority, resolve, without_fragment

# Every removed piece of markup leaves this mark, so that the text on its two
# sides stays apart.
_MARK = "\x01"
_SPACE = r"[ \t\n\r\f\x{00a0}]"
COMMENTS = r"(?s)<!--.*?-->"
SCRIPTS = r"(?is)<script[^>]*>.*?</script[^>]*>"
STYLES = r"(?is)<style[^>]*>.*?</style[^>]*>"
TAGS = r"<[a-zA-Z/!?][^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
MAIN = r"(?is)<(article|main)(?:[ \t\n\r\f][^>]*)?>(.*)</(?:article|main)[ \t\n\r\f]*>"
ANCHOR = r"""(?is)<a[ \t\n\r\f](?:[^>]*?[ \t\n\r\f])?href[ \t\n\r\f]*=[ \t\n\r\f]*("[^"]*"|'[^']*'|[^ \t\n\r\f>"']+)"""
META = r"(?is)<meta[ \t\n\r\f][^>]*>"
_IS_DESCRIPTION = r"""(?is)[ \t\n\r\f]name[ \t\n\r\f]*=[ \t\n\r\f]*["']?description["' \t\n\r\f/>]"""
_CONTENT = r"""(?is)[ \t\n\r\f]content[ \t\n\r\f]*=[ \t\n\r\f]*("[^"]*"|'[^']*'|[^ \t\n\r\f>"']+)"""

_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);?"


def _char(codepoint: Column) -> Column:
    """Unicode character of a number, null where there is none."""
    valid = ((codepoint > 0) & (codepoint < 0x110000)
             & ~codepoint.between(0xD800, 0xDFFF))
    padded = F.lpad(F.hex(F.when(valid, codepoint)), 8, "0")
    return F.decode(F.unhex(padded), "UTF-32")


def decode_entities(c: Column) -> Column:
    """Resolve named and numbered character references; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for name, cp in name2codepoint.items() for x in (name, chr(cp))])

    def piece(p: Column) -> Column:
        found = F.regexp_extract(p, _REFERENCE, 0)
        name = F.regexp_extract(p, _REFERENCE, 1)
        number = (F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10))
                  .when(name.startswith("#"), F.substr(name, F.lit(2)))).cast("long")
        char = F.when(name.startswith("#"), _char(number)).otherwise(F.try_element_at(names, name))
        return F.coalesce(F.concat(char, F.substr(p, F.length(found) + 1)), F.concat(F.lit("&"), p))

    parts = F.split(c, "&")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece)
    return F.when(c.contains("&"),
                  F.concat(F.element_at(parts, 1), F.array_join(rest, ""))).otherwise(c)


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def _unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"""^["']|["']$""", "")


def without_code(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    for pattern in (COMMENTS, SCRIPTS, STYLES):
        html = F.regexp_replace(html, pattern, _MARK)
    return html


def plain_text(markup: Column) -> Column:
    """Text pieces between tags, each trimmed, joined by one space."""
    marked = decode_entities(F.regexp_replace(markup, TAGS, _MARK))
    gap = rf"{_SPACE}*{_MARK}[ \t\n\r\f\x{{00a0}}{_MARK}]*"
    joined = F.regexp_replace(marked, gap, " ")
    return _trim(F.regexp_replace(joined, r"[ \t\n\r\f]+", " "))


def page_text(html: Column) -> Column:
    return plain_text(without_code(html))


def page_title(html: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(html, COMMENTS, ""), TITLE, 1)
    return F.nullif(_trim(decode_entities(found)), F.lit(""))


def page_description(html: Column) -> Column:
    metas = F.regexp_extract_all(F.regexp_replace(html, COMMENTS, ""), F.lit(META), F.lit(0))
    described = F.filter(metas, lambda m: m.rlike(_IS_DESCRIPTION))
    content = _unquote(F.regexp_extract(F.get(described, F.lit(0)), _CONTENT, 1))
    return F.nullif(_trim(decode_entities(content)), F.lit(""))


def main_text(html: Column) -> Column:
    """Text of the article or main part, or of the whole page without one."""
    code_free = without_code(html)
    return plain_text(F.when(code_free.rlike(MAIN), F.regexp_extract(code_free, MAIN, 2))
                      .otherwise(code_free))


def page_links(url: Column, html: Column, host_suffix: str) -> Column:
    """Absolute links of a page to hosts with the suffix, without fragments."""
    found = F.regexp_extract_all(without_code(html), F.lit(ANCHOR), F.lit(1))
    absolute = F.transform(found, lambda h: resolve(url, decode_entities(_unquote(h))))
    kept = F.filter(absolute, lambda u: authority(u).endswith(host_suffix))
    return F.transform(kept, without_fragment)
