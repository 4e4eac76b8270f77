"""Exports with faults: nothing is lost, re-parented or misread in silence."""

import os
import tempfile
from datetime import date
from decimal import Decimal

import pytest

from tallyframe.operators import checks as C
from tallyframe.operators import normalize as N
from tallyframe.plans import ingest as I
from tallyframe.sources import exports as X

LINES = "file string, line_no long, line string, modified timestamp"


def table(spark, lines, file="f"):
    return spark.createDataFrame([(file, i + 1, t, None) for i, t in enumerate(lines)], LINES)


def txns(spark, rows):
    return table(spark, ["Title", "Num,Date,Payee,Account,Memo,Category,Amount", *rows, "Grand Total,,,,,,0.00"])


def test_a_wrong_date_is_a_reject_and_no_part(spark):
    got = I.parse_txn_exports(txns(spark, ["1,2022-01-01,A,X,,Food,(1.00)", "2,02/01/2022,B,X,,Food,(2.00)", ",,,,,Rent,(3.00)", "3,2022-01-03,C,X,,Food,(4.00)"]))
    rows = sorted((r.Payee, r.Amount) for r in got.rows.collect())
    assert rows == [("A", Decimal("-1.0000")), ("C", Decimal("-4.0000"))]
    assert sorted((r.line_no, r.value) for r in got.date_rejects.collect()) == [(4, "02/01/2022"), (5, None)]


def test_a_wrong_amount_is_a_reject(spark):
    got = I.parse_txn_exports(txns(spark, ["1,2022-01-01,A,X,,Food,- 1.00", "2,2022-01-02,B,X,,Food,", "3,2022-01-03,C,X,,Food,(4.00)"]))
    assert [(r.Payee, r.Amount) for r in got.rows.collect()] == [("C", Decimal("-4.0000"))]
    assert sorted((r.line_no, r.value) for r in got.amount_rejects.collect()) == [(3, "- 1.00"), (4, None)]


def test_items_named_total_stay(spark):
    lines = ["Title", "Category,Total", "Expense Categories,", "Food,1.00", "Total Wine,2.00", "Rent,3.00", "Total Expense Categories,6.00", "Stray,9.00", "Strange Header,", "Grand Total,6.00"]
    kind = X.KINDS["income_spending"]
    rows, _ = X.split_footer(X.read_export(table(spark, lines), kind), "Grand Total", "Category")
    typed, _ = N.normalize_amounts(rows, ["Total"])
    items = N.label_sections_1level(typed, I.SPENDING_SECTIONS)
    assert sorted((r.Category, r.TxnType) for r in items.collect()) == [("Food", "Expense"), ("Rent", "Expense"), ("Total Wine", "Expense")]
    problems = N.section_problems_1level(typed, I.SPENDING_SECTIONS)
    assert sorted((r.Category, r.problem) for r in problems.collect()) == [("Strange Header", "unknown section"), ("Stray", "row outside any section")]


def test_two_levels_with_items_named_total(spark):
    lines = ["Balances", "As of 01/31/2022", "Account,Total", "Assets,", "Investment Accounts,", "Total Return Fund,5.00", "Other Fund,6.00", "Total Investment Accounts,11.00", "Total Assets,11.00", "Net Worth,11.00"]
    items, footer, problems = I.parse_balances(table(spark, lines))
    assert sorted((r.Account, r.Type, r.Subtype) for r in items.collect()) == [("Other Fund", "Assets", "Investment Accounts"), ("Total Return Fund", "Assets", "Investment Accounts")]
    assert problems.count() == 0 and footer.first().Total == Decimal("11.0000")


def test_more_than_forty_columns(spark):
    dates = [f"{m:02d}/01/{y}" for y in range(2015, 2020) for m in range(1, 13)]
    lines = ["Title", ",".join(["Category", *dates, "Total"]), ",".join(["Income", *[""] * len(dates), ""]), ",".join(["Pay", *["1.00"] * len(dates), f"{len(dates)}.00"]), ",".join(["Total Income", *["1.00"] * len(dates), "60.00"]), "Income less Expenses,60.00"]
    kind = X.KINDS["monthly_income_expenses"]
    df = table(spark, lines)
    assert X.export_problems(df, kind).count() == 0
    assert {r.Category: r.Total for r in X.read_export(df, kind).collect()}["Pay"] == "60.00"
    cells = X.read_asof_columns(df, kind).filter("name = 'Pay'").collect()
    assert len(cells) == 60 and {c.value for c in cells} == {"1.00"} and max(c.Date for c in cells) == date(2019, 12, 1)


def test_windows_1252_and_line_numbers_across_blocks(spark):
    folder = tempfile.mkdtemp(prefix="tallyframe-cp1252-")
    body = "".join(f"line {i} – €{i}\r\n" for i in range(1, 3001))
    for name in ("a.csv", "b.csv"):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(body.encode("cp1252"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = X.read_lines(spark, folder)
        got = sorted((r.file[-5:], r.line_no, r.line) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(name, i, f"line {i} – €{i}") for name in ("a.csv", "b.csv") for i in range(1, 3001)]
    assert len(X.CP1252_BYTES) == len(X.CP1252_TEXT) == 27 and X.CP1252_BYTES.encode("latin-1").decode("cp1252") == X.CP1252_TEXT


def test_keys_that_cannot_be_checked_raise(spark):
    rows = spark.createDataFrame([("A",)], "Account string")
    with pytest.raises(KeyError):
        C.duplicates({"Txns": rows})
    with pytest.raises(KeyError):
        C.orphans({"Txns": rows})


def test_attributes_are_merged_with_as_of_columns(spark):
    one = spark.createDataFrame([("A", "x", None, "1.00")], "Account string, Bank string, Number string, `01/31/2022` string")
    two = spark.createDataFrame([("A", "y", "2.00", None), ("B", None, "3.00", "7.00")], "Account string, Bank string, `02/28/2022` string, `01/31/2022` string")
    got = {(r.Account, r.Bank, str(r.Date), r.Balance) for r in N.merge_asof([one, two], "Account", ["Bank"]).collect()}
    assert got == {("A", "y", "2022-01-31", "1.00"), ("A", "y", "2022-02-28", "2.00"), ("B", None, "2022-02-28", "3.00"), ("B", None, "2022-01-31", "7.00")}
