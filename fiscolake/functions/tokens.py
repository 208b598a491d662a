"""Word columns shared by chunking, embedding and keyword search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"

Normalizer = Callable[[Column], Column]


@dataclass(frozen=True)
class OfLists:
    """A normalizer that takes the list of terms instead of each term, for functions that cannot stand in a lambda."""

    of_list: Normalizer

    def __call__(self, found: Column) -> Column:
        return self.of_list(found)


def same_term(term: Column) -> Column:
    return term


def strip_plural(term: Column) -> Column:
    """Light English stemming: the three plural rules of Harman's S-stemmer."""
    return (F.when(term.rlike("(?<![ae])ies$"), F.regexp_replace(term, "ies$", "y"))
            .when(term.rlike("(?<![aeo])es$"), F.regexp_replace(term, "es$", "e"))
            .when(term.rlike("(?<![us])s$"), F.regexp_replace(term, "s$", ""))
            .otherwise(term))


def words(text: Column) -> Column:
    """Text split at whitespace."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def terms(text: Column, normalize: Normalizer | OfLists = same_term) -> Column:
    """Lower-case search terms; a normalizer drops a term by emptying it."""
    return normalized(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), normalize)


def normalized(found: Column, normalize: Normalizer | OfLists) -> Column:
    """A list of terms as the normalizer gives it, without those it drops."""
    if normalize is same_term:
        return found
    changed = normalize(found) if isinstance(normalize, OfLists) else F.transform(found, normalize)
    return F.filter(changed, lambda t: t != "")
