"""Forms of personal data that a narrower search left in the text."""

import pytest
from pyspark.sql import functions as F

from sharewise.llm import pii


def _replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return pii.pseudonymise(df.withColumn("kind", F.lit(1)), "k").orderBy("doc_id").collect()


def test_key_without_a_digit(spark):
    for prefix, row in zip(
        ("AKIA", "ASIA"),
        _replaced(spark, [f"the key {p}MDUHKUVBLCCCCEQX was left" for p in ("AKIA", "ASIA")]),
        strict=True,
    ):
        assert "MDUHKUVBLCCCCEQX" not in row.text and row.text.startswith(f"the key {prefix}")
        assert row.pii["secret"] == 1


def _check(number):
    plain = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


IBANS = [
    ("ES91 2100 0418 4502 0005 1332", " BIC CAIXESBB"),
    ("BE68 5390 0754 7034", " EUR 50"),
    ("BE68539007547034", " EUR"),
    ("BE68 5390 0754 7034", " BANK CODE ABC"),
    ("GB82 WEST 1234 5698 7654 32", " AB"),
]


def test_word_behind_an_account_number(spark):
    # A country that the table does not know, with right check digits.
    account = "1234 5678 9012 3456"
    check = 98 - _check(f"ZZ00 {account}")
    known = [*IBANS, (f"ZZ{check:02d} {account}", " EUR"), (f"ZZ{check:02d} {account}", " NOTE ABC")]
    for (number, behind), row in zip(
        known, _replaced(spark, [f"pay {n}{b}" for n, b in known]), strict=True
    ):
        assert row.pii["iban"] == 1 and row.text.endswith(behind)
        new = row.text.removeprefix("pay ").removesuffix(behind)
        assert new != number and len(new) == len(number) and new[:2] == number[:2]
        assert _check(new) == 1


def test_two_account_numbers_in_a_row(spark):
    (row,) = _replaced(spark, ["BE68 5390 0754 7034 ES91 2100 0418 4502 0005 1332"])
    assert row.pii["iban"] == 2 and "5390" not in row.text and "0418" not in row.text


PHONES = [
    "+33 6 12 34 56 78", "06 12 34 56 78", "06.12.34.56.78", "+33 (0)6 12 34 56 78",
    "+49 30 901820", "+49 151 23456789", "+49 (0)151 23456789", "0151 23456789", "030 901820",
    "030/901820", "0049 151 23456789", "+34 612 34 56 78", "+34 91 123 45 67", "+1 (988) 555-2485",
]


def test_phone_numbers_of_several_countries(spark):
    for number, row in zip(PHONES, _replaced(spark, [f"call {n}, ok" for n in PHONES]), strict=True):
        new = row.text.removeprefix("call ").removesuffix(", ok")
        assert row.pii["phone"] == 1, number
        assert new != number and len(new) == len(number)
        assert [c for c in new if not c.isdigit()] == [c for c in number if not c.isdigit()]


@pytest.mark.parametrize("lead", ["+33 6 12 34 56 78", "+49 30 901820", "030 901820", "05"])
def test_what_follows_a_phone_number_is_found(spark, lead):
    behind = {"01.02.2024": "date", "1985-02-28": "date", "123-45-6789": "ssn"}
    if lead != "05":  # "05 4111 1111" is a number of the usual form
        behind["4111 1111 1111 1111"] = "card"
    rows = _replaced(spark, [f"{lead} {x} end" for x in behind])
    for kind, row in zip(behind.values(), rows, strict=True):
        assert row.pii[kind] == 1, row.text


def test_numbers_that_are_no_phone_numbers_stay(spark):
    same = ["0.12345678", "01-02-2024", "1.05.123456", "x06 12 34 56 78", "07 1234"]
    assert [r.text for r in _replaced(spark, same)] == same


FIGURES = [
    "In 2019 3000 4000 people came", "pages 100-234 5678", "ratio 12 345 6789",
    "prices 12.500 1200", "version 1.2.3.4", "Release 10.20.30.40 is out", "v1.2.3.4",
    "Smith (2019) 123-145", "1 234 567 890", "from 1990-2000 3000 went", "12 345 678", "3 1415 9265",
    "212 555 12345", "612 345 678", "1.212.555.1234",
]


def test_ordinary_figures_stay(spark):
    found = _replaced(spark, FIGURES)
    assert [r.text for r in found] == FIGURES
    assert not any(sum(r.pii.values()) for r in found)


@pytest.mark.parametrize("number", ["988-555-2485", "(988) 555-2485", "988.555.2485", "(030) 9018 2000"])
def test_national_forms_are_found(spark, number):
    (row,) = _replaced(spark, [f"call {number}, ok"])
    assert row.pii["phone"] == 1 and number not in row.text


MILLION = 1_000_000
LONG = [
    "x@" + "a." * (MILLION // 2) + "com", "x" * MILLION, "a@" * (MILLION // 2), "." * MILLION,
    "x@" + "a-" * (MILLION // 2), "1" * MILLION, "1." * (MILLION // 2), "12 " * (MILLION // 3),
    "+1" * (MILLION // 2), "0 1" * (MILLION // 3), "DE12" * (MILLION // 4), "AKIA" * (MILLION // 4),
    "token=" * (MILLION // 6), "1-" * (MILLION // 2), "x%" * (MILLION // 2) + "@b.com",
]


def test_tokens_of_a_million_signs(spark):
    found = _replaced(spark, [*LONG, "token=" + "a1" * (MILLION // 2), "mail a@b.example.com. End"])
    assert [r.text for r in found[: len(LONG) - 1]] == LONG[:-1]
    assert found[len(LONG) - 1].pii["email"] == 1
    secret = found[len(LONG)]
    assert secret.pii["secret"] == 1 and len(secret.text) == 6 + MILLION and "a1" * 20 not in secret.text
    assert found[-1].pii["email"] == 1 and found[-1].text.endswith(". End")


def test_columns_of_the_same_names_stay(spark):
    df = spark.createDataFrame([(1, "call +1 (988) 555-2485")], "doc_id bigint, text string")
    taken = ("pii", "finds", "Gaps", "__pii_finds", "__pii_gaps", "kind", "new")
    out = pii.pseudonymise(df.withColumns({c: F.lit(c) for c in taken}), "k")
    (row,) = out.collect()
    assert [row[c] for c in taken] == list(taken)
    assert row["pii_"]["phone"] == 1 and out.columns == ["doc_id", "text", *taken, "pii_"]
    assert pii.pseudonymise(df.filter("false"), "k").collect() == []
