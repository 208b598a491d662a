"""URL columns: resolving links and picking hosts apart, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generic URI pattern of RFC 3986, appendix B, with named positions below.
_URI = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SCHEME, _HOST, _PATH, _QUERY, _FRAGMENT = 1, 2, 3, 4, 5
_RELATIVE_SCHEMES = ["http", "https", "ftp", "sftp", "file"]


def _part(url: Column, position: int) -> Column:
    return F.regexp_extract(url, _URI, position)


def _remove_dots(path: Column) -> Column:
    """Apply ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))))
    ends_open = F.element_at(segments, -1).isin(".", "..")
    joined = F.array_join(F.when(ends_open, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(base: Column, href: Column) -> Column:
    """The absolute form of ``href`` found on the page ``base``."""
    link = F.btrim(href, F.lit(" \t\r\n\f"))
    scheme = F.lower(_part(link, _SCHEME))
    base_scheme = F.lower(_part(base, _SCHEME))
    path, base_path = _part(link, _PATH), _part(base, _PATH)
    has_query, has_fragment = link.rlike(r"^[^?#]*\?."), link.rlike(r"^[^#]*#.")
    root = F.concat(base_scheme, F.lit("://"), _part(base, _HOST))

    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    # An inner empty segment of a relative link counts for nothing.
    relative = F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path),
                                r"/{2,}", "/")
    merged = F.when(path.startswith("/"), path).otherwise(relative)
    clean = F.when(merged.rlike(r"(^|/)\.\.?(/|$)"), _remove_dots(merged)).otherwise(merged)
    query = F.when(has_query, F.concat(F.lit("?"), _part(link, _QUERY))).otherwise("")
    base_query = F.when(base.rlike(r"^[^?#]*\?."),
                        F.concat(F.lit("?"), _part(base, _QUERY))).otherwise("")
    fragment = F.when(has_fragment, F.concat(F.lit("#"), _part(link, _FRAGMENT))).otherwise("")
    same_page = F.concat(root, base_path, F.when(has_query, query).otherwise(base_query), fragment)

    foreign = (scheme != "") & ((scheme != base_scheme) | ~scheme.isin(_RELATIVE_SCHEMES))
    return (F.when(link == "", base)
            .when(foreign, link)
            .when(link.rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]"),
                  F.concat(base_scheme, F.lit("://"), _part(link, _HOST), path, query, fragment))
            .when(path == "", same_page)
            .otherwise(F.concat(root, clean, query, fragment)))


def authority(url: Column) -> Column:
    """Host with port and user, empty for a URL without one."""
    return _part(url, _HOST)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)
