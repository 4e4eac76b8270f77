"""Scalar parsers: money, category pairs, date specs, spec values (driver side and column side)."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.category import split_pair
from tallyframe.functions.dates import parse_flex_date, parse_relative_date, resolve_date_spec
from tallyframe.functions.money import amount_literal, parse_amount
from tallyframe.operators.filters import SpecError, amount_predicate, values_and_cond


@pytest.mark.parametrize(
    "text,value",
    [
        ("1,234.56", Decimal("1234.56")),
        ("-1,234.56", Decimal("-1234.56")),
        ("(1,234.56)", Decimal("-1234.56")),
        ("$1,234.56", Decimal("1234.56")),
        ("$-5", Decimal("-5")),
        ("12.5%", Decimal("12.5")),
        (" $7.00 ", Decimal("7.00")),
        ("", None),
        (None, None),
    ],
)
def test_parse_amount_column(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(parse_amount(F.col("t")).alias("v")).first().v
    assert got == value


@pytest.mark.parametrize("text", ["- 223.92", "$(1.00)", "abc", "1.2.3", "-$1.00"])
def test_parse_amount_rejects(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_amount(F.col("t")).alias("v")).first().v is None
    with pytest.raises(ValueError):
        amount_literal(text)


def test_amount_literal():
    assert amount_literal("10,928.45") == Decimal("10928.45")
    assert amount_literal(-3) == Decimal("-3")
    assert amount_literal("$2,000.00") == Decimal("2000.00")


def test_split_pair():
    assert split_pair("Food : Groceries") == ("Food", "Groceries")
    assert split_pair("Food :") == ("Food", None)
    assert split_pair("Food") == ("Food", None)
    assert split_pair("A:B:C") == ("A", "B:C")


def test_flex_dates():
    assert parse_flex_date("2022", True) == date(2022, 1, 1)
    assert parse_flex_date("2022", False) == date(2022, 12, 31)
    assert parse_flex_date("2024-02", False) == date(2024, 2, 29)
    assert parse_flex_date("2022-12-15", False) == date(2022, 12, 15)
    assert parse_flex_date("12/15/2022", True) is None


def test_relative_dates():
    a = date(2022, 12, 15)
    assert parse_relative_date("15d", a, True) == date(2022, 11, 30)
    assert parse_relative_date("2w", a, True) == date(2022, 12, 1)
    assert parse_relative_date("0m", a, True) == date(2022, 12, 1)
    assert parse_relative_date("0m", a, False) == date(2022, 12, 31)
    assert parse_relative_date("-1m", a, True) == date(2022, 11, 1)
    assert parse_relative_date("0y", a, True) == date(2022, 1, 1)
    assert parse_relative_date("1y", a, False) == date(2021, 12, 31)
    assert parse_relative_date("0d", a, True) is None
    assert resolve_date_spec("2021-03", True, None) == date(2021, 3, 1)


def test_values_and_cond():
    assert values_and_cond("x") == (["x"], "=")
    assert values_and_cond("!x") == (["x"], "<>")
    assert values_and_cond(["!", "a", "b"]) == (["a", "b"], "<>")
    assert values_and_cond(["!%", "%a"]) == (["%", "%a"], "<>")
    assert values_and_cond([1996, 1998]) == (["1996", "1998"], "=")


def test_amount_spec_errors():
    with pytest.raises(SpecError):
        amount_predicate("- 223.92", F.col("Amount"))
    with pytest.raises(SpecError):
        amount_predicate(["<>", "1"], F.col("Amount"))
    with pytest.raises(SpecError):
        amount_predicate(["=>", "1"], F.col("Amount"))
