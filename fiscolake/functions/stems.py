"""English stemming of search terms by the published Porter2 rules.

R1 is what follows the first consonant after a vowel, R2 the same within R1. Steps 0 to 5 take off or change the longest
ending of their list, if it lies in the region they name.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from fiscolake.functions.tokens import OfLists

# The lists of the published rules.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
           "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
           "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
           "andes": "andes"}
DONE_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
REGION_AFTER = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
          "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
          "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
          "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "",
          "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous",
          "ive", "ize", "ion")

_VOWEL = "[aeiouy]"
_REGION = re.compile(f"{_VOWEL}[^aeiouy]")
_SHORT_END = re.compile(f"(?:[^aeiouy]{_VOWEL}[^aeiouywxY]|^{_VOWEL}[^aeiouy])$")
_HAS_VOWEL = re.compile(_VOWEL)
#: Different terms a worker remembers.
REMEMBERED = 1 << 17


def _region(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has, or nothing."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _plural(word: str) -> str:
    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if end == "s" and _HAS_VOWEL.search(word[:-2]) else word


def _past(word: str, r1: int) -> str:
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    stem = word[:len(word) - len(end)]
    if not end:
        return word
    if end in ("eed", "eedly"):
        return f"{stem}ee" if len(stem) >= r1 else word
    if not _HAS_VOWEL.search(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return f"{stem}e"
    if stem.endswith(DOUBLES):
        return stem[:-1]
    return f"{stem}e" if r1 >= len(stem) and _SHORT_END.search(stem) else stem


def _step_2(word: str, r1: int) -> str:
    end = _ending(word, STEP_2)
    stem = word[:len(word) - len(end)]
    if not end or len(stem) < r1 or (end == "ogi" and not stem.endswith("l")):
        return word
    if end == "li" and not stem.endswith(tuple(BEFORE_LI)):
        return word
    return stem + STEP_2[end]


def _step_3(word: str, r1: int, r2: int) -> str:
    end = _ending(word, STEP_3)
    stem = word[:len(word) - len(end)]
    if not end or len(stem) < (r2 if end == "ative" else r1):
        return word
    return stem + STEP_3[end]


def _step_4(word: str, r2: int) -> str:
    end = _ending(word, STEP_4)
    stem = word[:len(word) - len(end)]
    if not end or len(stem) < r2 or (end == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def _step_5(word: str, r1: int, r2: int) -> str:
    stem = word[:-1]
    if word.endswith("e") and (len(stem) >= r2 or (len(stem) >= r1 and not _SHORT_END.search(stem))):
        return stem
    return stem if word.endswith("ll") and len(stem) >= r2 else word


@lru_cache(REMEMBERED)
def english_stem(term: str) -> str:
    """The stem of a lower-case term."""
    if len(term) < 3:
        return term
    if term in SPECIAL:
        return SPECIAL[term]
    # Y is a consonant: at the start, or after a vowel.
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", term.removeprefix("'"))
    r1 = next((len(p) for p in REGION_AFTER if word.startswith(p)), None) or _region(word, 0)
    r2 = _region(word, r1)
    word = word.removesuffix("'").removesuffix("'s")
    word = _plural(word)
    if word in DONE_AFTER_1A:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = f"{word[:-1]}i"
    word = _step_5(_step_4(_step_3(_step_2(word, r1), r1, r2), r2), r1, r2)
    return word.replace("Y", "y")


def _stemmed(lists: pa.Array) -> pa.Array:
    """Stems of lists of terms; each different term of a batch is worked out once."""
    coded = lists.flatten().dictionary_encode()
    stems = pa.array([None if w is None else english_stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices), mask=pc.is_null(lists))


@OfLists
def english_stems(found):
    """Normalizer of search terms: the stem of every term."""
    @arrow_udf("array<string>")
    def stems(lists: pa.Array) -> pa.Array:
        return _stemmed(lists)

    return stems(F.coalesce(found, F.array().cast("array<string>")))
