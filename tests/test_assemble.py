"""Exports of several kinds to a whole ledger, and to a checked one."""

from datetime import date, datetime
from decimal import Decimal

from tallyframe.operators import checks as C
from tallyframe.plans import pivot as P
from tallyframe.plans.assemble import ledger_from_lines

FILES = {
    "txns.csv": [
        "All transactions", "Num,Date,Payee,C,Account,Memo,Category,Amount",
        "1,2022-01-05,Grocer,R,Checking,,Food : Groceries,(10.00)", "2,2022-01-06,Boss,,Checking,,Wages,100.00",
        "3,2022-02-01,,,Checking,,Transfer To : Savings,(20.00)", "4,13/02/2022,Bad,,Checking,,Food,(1.00)",
        "5,2022-02-03,Odd,,Checking,,Food,- 5.00", "Grand Total,,,,,,,70.00",
    ],
    "balances.csv": [
        "Balances", "As of 02/28/2022", "Account,Total", "Assets,", "Bank,", "Checking,70.00", "Savings,20.00", "Total Bank,90.00", "Total Assets,90.00", "Net Worth,90.00",
    ],
    "details.csv": ["Details", "As of 01/31/2022", "Account,Abbreviation,Balance,Bank Name,Account Number,Limit,Balance", "Checking,chk,5.00,First,123,,90.00", "Spare,sp,1.00,First,9,,1.00"],
    "spending.csv": ["Spending", "Category,01/31/2022,02/28/2022,Total", "Income Categories,,,", "Wages,100.00,,100.00", "Total Income Categories,100.00,,100.00", "Expense Categories,,,", "Food,10.00,0.50,10.50", "Total Expense Categories,10.00,0.50,10.50", "Grand Total,90.00,-0.50,89.50"],
    "junk.csv": ["hello"],
}


def test_ledger_from_exports(spark):
    rows = [(name, i + 1, line, datetime(2022, 3, 1)) for name, lines in FILES.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "file string, line_no long, line string, modified timestamp")
    ledger = ledger_from_lines(spark, lines, {"eras": {"E": {"date_from": "2022"}}})
    tables = {k: v.cache() for k, v in ledger.tables().items()}
    txns = tables["Txns"].orderBy("N").collect()
    assert [(r.N, r.Payee, r.Category, r.Subcategory, r.XferAccount, r.Amount, r.EraName) for r in txns] == [
        (1, "Grocer", "Food", "Groceries", None, Decimal("-10.0000"), "E"),
        (2, "Boss", "Wages", None, None, Decimal("100.0000"), "E"),
        (3, None, "Transfer To", None, "Savings", Decimal("-20.0000"), "E"),
    ]
    accounts = {r.Account: r for r in tables["Accounts"].collect()}
    assert set(accounts) == {"Checking", "Savings", "Spare"}
    assert (accounts["Checking"].AccountClassification, accounts["Checking"].AccountCategory, accounts["Checking"].OpeningBalance, accounts["Checking"].BankName) == ("Assets", "Bank", Decimal("5.0000"), "First")
    types = {(r.Category, r.Subcategory): r.TxnType for r in tables["Categories"].collect()}
    assert types[("Wages", None)] == "Income" and types[("Food", "Groceries")] == "Expense"
    assert {(r.Account, str(r.Date), r.Balance) for r in tables["AccountBalances"].collect()} == {
        ("Checking", "2022-01-31", Decimal("90.0000")), ("Checking", "2022-02-28", Decimal("70.0000")), ("Savings", "2022-02-28", Decimal("20.0000")), ("Spare", "2022-01-31", Decimal("1.0000")),
    }
    assert {(r.Category, r.Date, r.Balance) for r in tables["CategoryBalances"].collect()} == {
        ("Wages", date(2022, 1, 31), Decimal("100.0000")), ("Food", date(2022, 1, 31), Decimal("10.0000")), ("Food", date(2022, 2, 28), Decimal("0.5000")),
    }
    assert tables["Loans"].count() == tables["TxnsInv"].count() == 0
    assert all(r.violations == 0 for r in C.orphans(tables).collect()) and C.orphans(tables).count() == 9
    problems = {(r.file, r.line_no, r.problem, r.value) for r in ledger.problems().collect()}
    assert problems == {("junk.csv", None, "unknown kind", None), ("txns.csv", 6, "Date", "13/02/2022"), ("txns.csv", 7, "Amount", "- 5.00")}
    assert P.pivot(ledger, {"select": {"txntype": "Expense"}, "options": {"rows": "category", "columns": "total"}}).count() == 2
