"""Real export files on disk: cp1252 text with CRLF, read through binaryFile into the line table."""

import os
import tempfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import ingest as I
from tallyframe.sources import exports as X

TXNS = (
    "Account transactions\r\nAll accounts\r\nConverted to base currency: US dollar\r\n1/1/2022 through 12/31/2022\r\n\r\n"
    "Num,Date,Payee,C,Account,Memo,Category,Amount,Running Balance\r\n"
    ",2022-01-05,Café Ré,R,Checking,,Food : Groceries,\"(1,234.50)\",\r\n"
    "12,2022-01-06,ACME Corp,,Checking,paycheck,,\"$2,000.00\",\r\n"
    ",,,,,,Wages & Salary : Gross,\"2,500.00\",\r\n"
    ",,,,,tax,Taxes : Federal,(500.00),\r\n"
    "**VOID**,2022-01-07,Nobody,,Checking,,Food,(1.00),\r\n"
    "Grand Total,,,,,,,765.50,\r\n"
)
BALANCES = (
    "Account balances\r\nUS dollar\r\nAs of 12/31/2022\r\nAccount,Total\r\n"
    "Assets,\r\nBank and Cash Accounts,\r\nChecking,100.00\r\nTotal Bank and Cash Accounts,100.00\r\nTotal Assets,100.00\r\n"
    "Liabilities,\r\nCredit Cards,\r\nVisa,40.00\r\nTotal Credit Cards,40.00\r\nTotal Liabilities,40.00\r\nNet Worth,60.00\r\n"
)


def test_files_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="tallyframe-files-")
    for name, text in (("txns.csv", TXNS), ("balances.csv", BALANCES), ("junk.csv", "hello\r\nworld\r\n")):
        with open(os.path.join(d, name), "wb") as f:
            f.write(text.encode("cp1252"))
    lines = X.read_lines(spark, os.path.join(d, "*.csv"))
    kinds = {os.path.basename(r.file): r.kind for r in X.classify_exports(lines).collect()}
    assert kinds == {"txns.csv": "account_txns", "balances.csv": "account_balances", "junk.csv": None}
    txn_lines = lines.filter(F.col("file").endswith("txns.csv"))
    imp = I.parse_txn_exports(txn_lines)
    got = sorted((r.Payee, r.Category, r.Subcategory, float(r.Amount), r.Split) for r in imp.rows.collect())
    assert got == [
        ("ACME Corp", "Taxes", "Federal", -500.0, "Y"),
        ("ACME Corp", "Wages & Salary", "Gross", 2500.0, "Y"),
        ("Café Ré", "Food", "Groceries", -1234.5, None),
    ]
    assert imp.check_total().first().ok
    items, foot, problems = I.parse_balances(lines.filter(F.col("file").endswith("balances.csv")))
    assert sorted((r.Account, r.Type, r.Subtype) for r in items.collect()) == [("Checking", "Assets", "Bank and Cash Accounts"), ("Visa", "Liabilities", "Credit Cards")]
    chk = I.check_net_worth(items, foot).first()
    assert chk.sum_ok and chk.net_worth_ok
    assert {os.path.basename(r.file): str(r.as_of) for r in X.as_of_date(lines, fallback_mtime=False).collect()}["balances.csv"] == "2022-12-31"
    probs = X.export_problems(lines.filter(F.col("file").endswith("junk.csv")), X.KINDS["account_txns"]).collect()
    assert [p.problem for p in probs] == ["header row not found"]


def test_list_exports_sorts_and_removes_repeats(spark):
    d = tempfile.mkdtemp(prefix="tallyframe-list-")
    for name in ("b.csv", "a.csv", "c.txt"):
        with open(os.path.join(d, name), "w") as f:
            f.write("x\n")
    found = X.list_exports(spark, [os.path.join(d, "*.csv"), os.path.join(d, "a.*")])
    assert [os.path.basename(f) for f in found] == ["a.csv", "b.csv"]


def _ledger(spark, rows):
    from tallyframe.plans.assemble import ledger_from_lines

    text = ["Txns", "Num,Date,Payee,Account,Memo,Category,Amount", *rows, "Grand Total,,,,,,0.00"]
    lines = spark.createDataFrame([("f", i + 1, t, None) for i, t in enumerate(text)], "file string, line_no long, line string, modified timestamp")
    return ledger_from_lines(spark, lines)


def test_store_commits_whole_generations(spark, monkeypatch):
    from tallyframe.ledger import Ledger
    from tallyframe.sources import store

    path = os.path.join(tempfile.mkdtemp(prefix="tallyframe-store-"), "ledger")
    first = _ledger(spark, ["1,2022-01-02,A,X,,Food,(1.00)", "2,2022-01-01,B,X,,Rent,(2.00)"])
    store.write_ledger(first, path)
    read = store.read_ledger(spark, path)
    assert read.generation == 1 and set(read.tables()) == {"Txns", "TxnsInv", "Accounts", "Payees", "Categories", "Eras", "Loans", "AccountBalances", "CategoryBalances"}
    assert [(r.N, r.Payee) for r in read.tables()["Txns"].orderBy("N").collect()] == [(1, "B"), (2, "A")]

    # a write that fails half way leaves the old generation whole
    broken = _ledger(spark, ["9,2022-05-05,Z,Y,,Fuel,(9.00)"])
    whole = Ledger.over

    def half(self, facts, order_key):
        new = whole(self, facts, order_key)
        new.__dict__["categories"] = facts.selectExpr("raise_error('lost') AS Category")
        return new

    monkeypatch.setattr(Ledger, "over", half)
    with pytest.raises(Exception, match="lost"):
        store.write_ledger(broken, path)
    monkeypatch.undo()
    again = store.read_ledger(spark, path)
    assert again.generation == 1 and sorted(r.Payee for r in again.payees.collect()) == ["A", "B"]

    # an append comes after what is stored, and the dimensions hold both
    store.append_ledger(_ledger(spark, ["3,2021-12-31,C,W,,Food,(3.00)", "4,2022-03-01,A,X,,Food,(4.00)"]), path)
    both = store.read_ledger(spark, path)
    assert both.generation == 2
    assert [(r.N, r.Payee) for r in both.tables()["Txns"].orderBy("N").collect()] == [(1, "B"), (2, "A"), (3, "C"), (4, "A")]
    assert sorted(r.Account for r in both.accounts.collect()) == ["W", "X"] and both.payees.count() == 3
    assert [r.generation for r in (read, again)] == [1, 1] and read.txns.count() == 2  # readers keep their generation

    # a writer that started from an older manifest cannot commit
    with pytest.raises(store.CommitError):
        store.commit(spark, path, 2, {})
    assert len(store.drop_unlisted(spark, path)) == 1
    assert store.read_ledger(spark, path).txns.count() == 4


def test_heads_are_judged_before_bodies_are_read(spark):
    d = tempfile.mkdtemp(prefix="tallyframe-heads-")
    texts = {
        "a.csv": ["x"] * 40 + ["As of 01/31/2022", "Account,Total", "Assets,", "A,1.00", "Total Assets,1.00", "Net Worth,1.00"],
        "b.csv": ["As of 01/31/2021", "Account,Total", "Net Worth,0.00"],
        "c.csv": ["Account,Total", "Memo As of 01/31/2022,1.00", "Net Worth,1.00"],
        "d.csv": ["Num,Date,Payee,Account,Memo,Category,Amount"],
        "e.csv": ["hello"],
    }
    for name, lines in texts.items():
        with open(os.path.join(d, name), "w") as f:
            f.write("\r\n".join(lines))
    heads = X.judge_heads(X.scan_heads(spark, d), date(2022, 1, 1), date(2022, 12, 31)).cache()
    got = {os.path.basename(r.file): (r.kinds, str(r.as_of), r.opened, r.problem) for r in heads.collect()}
    both = ["account_balances", "account_balances_details"]
    assert got == {
        "a.csv": (both, "2022-01-31", True, None), "b.csv": (both, "2021-01-31", False, None), "c.csv": (both, "None", False, "no as-of date"),
        "d.csv": (["account_txns"], "None", True, None), "e.csv": ([], "None", False, "unknown kind"),
    }
    lines = X.open_exports(spark, heads)
    assert {os.path.basename(r.file) for r in lines.select("file").distinct().collect()} == {"a.csv", "d.csv"}
    assert {os.path.basename(r.file): r.kind for r in X.classify_exports(lines).collect()} == {"a.csv": "account_balances", "d.csv": "account_txns"}
