"""Column functions for tax text: money, identity numbers, codes, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiscolake.schemas import MONEY

_BLANKS = " \t\n\r\f\v"

# The beneficiary flags of the tax program and their labels.
BENEFICIARY_LABELS = {
    "T": "titular",
    "D": "dependente",
    "A": "alimentando",
    "V": "alimentando",
}

# The id that stands for a missing one, and the summary of a return.
ZERO_ID = "00000000000"
SUMMARY = "Declaração IRPF-2025 de %s (CPF %s)."

# Optional sign, digits with dots as thousands marks, at most two decimals
# (zeros beyond them change nothing).
BR_MONEY = r"^[+-]?[0-9.]*(,[0-9]{0,2}0*)?$"
PLAIN_MONEY = r"^[+-]?[0-9]+([.][0-9]{0,2}0*)?$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def not_blank(c: Column) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def or_default(c: Column, default: str) -> Column:
    return F.coalesce(not_blank(strip(c)), F.lit(default))


def parse_money(c: Column) -> Column:
    """``1.234,56`` to a decimal. Missing or empty is zero; text that is no
    amount of two decimals and twelve whole digits is null."""
    text = strip(F.coalesce(not_blank(c), F.lit("0,00")))
    plain = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(text.rlike(BR_MONEY), plain.try_cast(MONEY))


def plain_money(c: Column) -> Column:
    """``1234.56`` to a decimal under the same limits; missing stays null."""
    text = strip(c)
    return F.when(text.rlike(PLAIN_MONEY), text.try_cast(MONEY))


def only_digits(c: Column) -> Column:
    # Most ids hold nothing else, and finding that out is cheaper than replacing.
    return F.when(c.rlike("[^0-9]"), F.regexp_replace(c, "[^0-9]", "")).otherwise(c)


def pad_code(c: Column) -> Column:
    """Two digits at least; longer codes and the empty code stay as they are."""
    return F.when(F.length(c) == 1, F.concat(F.lit("0"), c)).otherwise(c)


def first_nonempty(*cols: Column, default: str | None = None) -> Column:
    return F.coalesce(*[not_blank(c) for c in cols], F.lit(default).cast("string"))


def beneficiary_label(flag: Column) -> Column:
    pairs = [F.lit(x) for kv in BENEFICIARY_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(flag)),
                      F.lit(BENEFICIARY_LABELS["T"]))


def local_name(tag: Column) -> Column:
    """Tag without namespace, written either ``{uri}tag`` or ``prefix:tag``."""
    return F.regexp_extract(tag, r"([^{}:]*)$", 1)


def document_date(text: Column, as_of: Column) -> Column:
    """Year-month-day text to a date; anything else gives ``as_of``."""
    trimmed = strip(text)
    parsed = F.when(trimmed.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), trimmed.try_cast("date"))
    return F.coalesce(parsed, as_of)


def summary_sentence(name: Column, cpf: Column) -> Column:
    return F.format_string(SUMMARY,
                           F.coalesce(name, F.lit("declarante")),
                           F.coalesce(cpf, F.lit("???")))


def copy_forward(repeat: Column, previous: Column, current: Column) -> Column:
    """Last year's value where the line asks to repeat it and has none of its own."""
    empty = F.coalesce(current, F.lit(0).cast(MONEY)) == 0
    return F.when(F.coalesce(repeat, F.lit(False)) & empty, previous).otherwise(current)


def summary_text(c: Column) -> Column:
    """Text of a summary given as an object with ``text`` or as a bare string."""
    return F.coalesce(F.get_json_object(c, "$.text"),
                      F.when(~F.coalesce(c.startswith("{"), F.lit(False)), c))


def percent_change(before: Column, after: Column) -> Column:
    return (after - before).cast("double") / F.nullif(before.cast("double"), F.lit(0.0)) * 100


def kilobytes(length: Column) -> Column:
    """Size in KB with two decimals, halves to the even digit."""
    kb = (length.cast("decimal(19,0)") * F.lit("0.0009765625").cast("decimal(10,10)"))
    return F.concat(F.bround(kb, 2).cast("decimal(20,2)").cast("string"), F.lit(" KB"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
