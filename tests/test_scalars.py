import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from fiscolake.functions import scalars as S


def test_parse_money(column):
    cases = {
        "1.234,56": Decimal("1234.56"), "0,5": Decimal("0.50"), "10": Decimal("10.00"),
        "": Decimal("0.00"), None: Decimal("0.00"), " 7,10 ": Decimal("7.10"),
        "1234.56": Decimal("123456.00"), "-3,00": Decimal("-3.00"), "1,500": Decimal("1.50"),
        "1,239": None, "abc": None, "   ": None, "1,2,3": None, "10,": Decimal("10.00"),
        "999.999.999.999,99": Decimal("999999999999.99"), "1.000.000.000.000,00": None,
    }
    assert column(S.parse_money, list(cases)) == list(cases.values())


def test_plain_money(column):
    cases = {"1234.56": Decimal("1234.56"), "7": Decimal("7.00"), "1.239": None, "1.230": Decimal("1.23"),
             "1,5": None, None: None, "-2.5": Decimal("-2.50")}
    assert column(S.plain_money, list(cases)) == list(cases.values())


def test_ids_and_codes(column):
    assert column(S.only_digits, ["123.456.789-09", None, "x", ""]) == ["12345678909", None, "", ""]
    assert column(S.pad_code, ["1", "12", "105", "", None]) == ["01", "12", "105", "", None]


def test_first_nonempty(column):
    values = [("", None, "c"), ("a", "b", "c"), (None, "", None)]
    assert column(lambda *c: S.first_nonempty(*c, default="z"), values) == ["c", "a", "z"]
    assert column(lambda *c: S.first_nonempty(*c), values) == ["c", "a", None]


def test_beneficiary_label(column):
    assert column(S.beneficiary_label, ["T", "d", "A", "v", "", None, "?"]) == [
        "titular", "dependente", "alimentando", "alimentando", "titular", "titular", "titular"]


def test_document_date(column):
    day = datetime.date
    got = column(lambda c: S.document_date(c, F.lit("2025-05-31").cast("date")),
                 ["2025-04-01", "2024-1-9", "01/02/2025", "2024-02-30", "2024-01-02T10:00", None, " 2025-04-02 "])
    last = day(2025, 5, 31)
    assert got == [day(2025, 4, 1), day(2024, 1, 9), last, last, last, last, day(2025, 4, 2)]


def test_summaries(column):
    assert column(S.summary_sentence, [("Ana", "1"), (None, None)]) == [
        "Declaração IRPF-2025 de Ana (CPF 1).", "Declaração IRPF-2025 de declarante (CPF ???)."]
    assert column(S.summary_text, ['{"text":"á"}', "plain", None, "{}"]) == ["á", "plain", None, None]


def test_copy_forward(column):
    d = Decimal
    values = [(True, d("5.00"), None), (True, d("5.00"), d("0.00")), (True, d("5.00"), d("7.00")),
              (False, d("5.00"), None), (None, d("5.00"), d("0.00"))]

    def run(r, a, b):
        return S.copy_forward(r, a.cast("decimal(14,2)"), b.cast("decimal(14,2)"))
    values = [(r, None if a is None else str(a), None if b is None else str(b)) for r, a, b in values]
    assert column(run, values, "boolean,string,string") == [
        d("5.00"), d("5.00"), d("7.00"), None, d("0.00")]


def test_small_helpers(column):
    assert column(S.local_name, ["{http://x/y}bens", "rf:bens", "bens"]) == ["bens"] * 3
    assert column(S.kilobytes, [0, 1024, 1536, 37, 128], "long") == [
        f"{n / 1024:.2f} KB" for n in (0, 1024, 1536, 37, 128)]
    got = column(S.percent_change, [(100.0, 150.0), (0.0, 5.0), (None, 1.0)], "double")
    assert got == [50.0, None, None]
    assert column(lambda c: S.or_default(c, "00"), [" ", "", None, " 1 "]) == ["00", "00", "00", "1"]
