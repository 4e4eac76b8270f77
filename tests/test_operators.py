"""Stateful and ledger operators on small hand-written frames with known answers."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import ledger as L
from tallyframe.operators import normalize as N
from tallyframe.operators.filters import FilterContext, SpecError, apply_select
from tallyframe.operators.numbering import number_rows


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_flatten_splits_and_voids(spark):
    data = [
        ("f", 1, "1", "2022-01-01", "P1", "A", "Food", "x", "-10"),
        ("f", 2, None, None, None, None, "Food", None, "-4"),
        ("f", 3, None, None, None, None, "Fun", "own", "-6"),
        ("f", 4, "2", "2022-01-02", "P2", "A", "Rent", None, "-100"),
        ("f", 5, "**VOID**", "2022-01-03", "P3", "A", "Food", "v", "-50"),
        ("f", 6, None, None, None, None, "Food", None, "-50"),
        ("g", 1, "9", "2022-02-01", "Q", "B", "Pay", None, "100"),
    ]
    df = spark.createDataFrame(data, "file string, line_no long, Num string, Date string, Payee string, Account string, Category string, Memo string, Amount string")
    df = df.withColumn("Date", F.to_date("Date"))
    flat = N.flatten_splits(df)
    got = rows(flat, "file", "line_no", "Num", "Payee", "Memo", "Split")
    assert got == [
        ("f", 2, "1", "P1", "x", "Y"),
        ("f", 3, "1", "P1", "own", "Y"),
        ("f", 4, "2", "P2", None, None),
        ("f", 6, "**VOID**", "P3", "v", "Y"),
        ("g", 1, "9", "Q", None, None),
    ]
    assert rows(N.drop_voids(flat), "line_no") == [(1,), (2,), (3,), (4,)]


def test_sections_two_level(spark):
    lines = [
        ("Assets", None),
        ("Bank", None),
        ("Checking", "100"),
        ("Savings", "200"),
        ("Total Bank", "300"),
        ("Other", None),
        ("Bank", "5"),  # an account with the same name as a section
        ("Total Other", "5"),
        ("Total Assets", "305"),
        ("Liabilities", None),
        ("Cards", None),
        ("Visa", "50"),
        ("Total Cards", "50"),
        ("Total Liabilities", "50"),
    ]
    df = spark.createDataFrame([("b", i + 1, a, t) for i, (a, t) in enumerate(lines)], "file string, line_no long, Account string, Total string")
    items, problems = N.label_sections_2level(df)
    assert rows(items, "Account", "Type", "Subtype") == [
        ("Bank", "Assets", "Other"),
        ("Checking", "Assets", "Bank"),
        ("Savings", "Assets", "Bank"),
        ("Visa", "Liabilities", "Cards"),
    ]
    assert problems.count() == 0


def test_sections_problems(spark):
    lines = [("Assets", None), ("Bank", None), ("X", "1"), ("Total Assets", "1")]
    df = spark.createDataFrame([("b", i + 1, a, t) for i, (a, t) in enumerate(lines)], "file string, line_no long, Account string, Total string")
    _, problems = N.label_sections_2level(df)
    assert [r.problem for r in problems.collect()] == ["total does not close the open section"]


def test_sections_one_level(spark):
    lines = [("Income Categories", None), ("Wages", "10"), ("Total Income Categories", "10"), ("Expense Categories", None), ("Food", "3"), ("Total Expense Categories", "3")]
    df = spark.createDataFrame([("s", i + 1, a, t) for i, (a, t) in enumerate(lines)], "file string, line_no long, Category string, Total string")
    got = N.label_sections_1level(df, {"Income Categories": "Income", "Expense Categories": "Expense"})
    assert rows(got, "Category", "TxnType") == [("Food", "Expense"), ("Wages", "Income")]


def test_loans(spark):
    data = [("l", 1, "Car", "Interest : Car", "Bank"), ("l", 2, None, "Fees", "DMV"), ("l", 3, "Home", "Interest : Home", "Bank")]
    df = spark.createDataFrame(data, "file string, line_no long, Loan string, category string, Payee string")
    got = N.loan_payee_categories(df)
    assert rows(got, "Loan", "Payee", "Category", "Subcategory") == [
        ("Car", "Bank", "Interest", "Car"),
        ("Car", "DMV", "Fees", None),
        ("Home", "Bank", "Interest", "Home"),
    ]


def test_number_rows_hot_key(spark):
    # one date holds most rows: numbering must still be dense and in order
    data = [(date(2020, 1, 1 if i % 10 else 2), i) for i in range(5000)]
    df = spark.createDataFrame(data, "d date, k long")
    got = number_rows(df, ["d", "k"], "N", num_partitions=7)
    expect = df.withColumn("N", F.row_number().over(Window.orderBy("d", "k")))
    assert rows(got, "d", "k", "N") == rows(expect, "d", "k", "N")
    per = number_rows(df, ["k"], "N", partition_by=["d"], num_partitions=5)
    expect2 = df.withColumn("N", F.row_number().over(Window.partitionBy("d").orderBy("k")))
    assert rows(per, "d", "k", "N") == rows(expect2, "d", "k", "N")


def test_intervals_and_assignment(spark):
    eras = {"Era C": {"date_to": "2019"}, "Era B": {"date_to": "2020"}, "Era A": {"date_to": "..."}}
    iv = L.build_intervals(spark, eras)
    assert [(r.EraName, r.EraDateFrom, r.EraDateTo) for r in iv.orderBy("era_no").collect()] == [
        ("Era C", None, date(2019, 12, 31)),
        ("Era B", date(2020, 1, 1), date(2020, 12, 31)),
        ("Era A", date(2021, 1, 1), None),
    ]
    tx = spark.createDataFrame([(date(2018, 5, 1),), (date(2020, 1, 1),), (date(2023, 1, 1),)], "Date date")
    assert rows(L.assign_interval(tx, iv), "Date", "EraName") == [
        (date(2018, 5, 1), "Era C"),
        (date(2020, 1, 1), "Era B"),
        (date(2023, 1, 1), "Era A"),
    ]
    # two eras, gap between them: unassigned rows stay NULL
    iv2 = L.build_intervals(spark, {"E1": {"date_from": "2019", "date_to": "2019"}, "E2": {"date_from": "2021", "date_to": "2021"}})
    assert L.assign_interval(tx, iv2).filter(F.col("EraName").isNull()).count() == 3
    with pytest.raises(L.ConfigError):
        L.build_intervals(spark, {"X": {"date_from": "2019", "date_to": "2020"}, "Y": {"date_from": "2020-06", "date_to": "2021"}})


def test_rewrites_chain_and_counts(spark):
    tx = spark.createDataFrame(
        [("Checking", "United States Treasury", "Tax", Decimal("-5")), ("Checking", "Grocer", "Food", Decimal("-3")), ("Savings", "United States Treasury", "Tax", Decimal("-1"))],
        "Account string, Payee string, Category string, Amount decimal(15,4)",
    ).withColumns({"Subcategory": F.lit(None).cast("string"), "Memo": F.lit(None).cast("string"), "Date": F.lit(date(2020, 1, 1))})
    rules = [
        {"payee": "US Treasury Dept", "select": {"account": "Checking", "payee": "United States Treasury"}},
        {"category": "Taxes : Federal", "select": {"payee": "US Treasury Dept"}},
    ]
    out, flags = L.apply_rewrites(tx, rules)
    assert [r.modified for r in L.rewrite_counts(out, flags).orderBy("rule").collect()] == [1, 1]
    assert rows(out, "Account", "Payee", "Category", "Subcategory")[0] == ("Checking", "Grocer", "Food", None)
    assert ("Checking", "US Treasury Dept", "Taxes", "Federal") in rows(out, "Account", "Payee", "Category", "Subcategory")
    with pytest.raises(L.ConfigError):
        L.apply_rewrites(tx, [{"select": {"payee": "x"}}])


def test_accounts_priorities(spark):
    tx = spark.createDataFrame(
        [("Checking", date(2020, 1, 1), None), ("Checking", date(2020, 3, 1), "Savings"), ("Visa", date(2020, 2, 1), "Loan1")],
        "Account string, Date date, XferAccount string",
    )
    loans = spark.createDataFrame([("Loan1",)], "Loan string")
    bal = spark.createDataFrame([("Brokerage",), ("Checking",)], "Account string")
    a = L.accounts(tx, loans=loans, balance_names=bal)
    got = {r.Account: (r.AccountClassification, r.TxnDateMin, r.XferOnly) for r in a.collect()}
    assert got["Checking"] == (None, date(2020, 1, 1), None)
    assert got["Savings"] == (None, date(2020, 3, 1), 1)  # new transfer target
    assert got["Loan1"] == ("Liabilities", date(2020, 2, 1), 1)  # known without txns: dates upserted
    assert got["Brokerage"] == (None, None, None)


def test_filter_errors(spark):
    df = spark.createDataFrame([("a",)], "EraName string")
    with pytest.raises(SpecError):
        apply_select(df, {"era": "%x"}, FilterContext())


def test_pivot_overlap_error():
    from tallyframe.plans.pivot import resolve_dims

    with pytest.raises(SpecError):
        resolve_dims({"rows": "yyyy"})
    rows_, cols, total = resolve_dims({"rows": ["yyyy", "yyyymm"], "columns": "total"})
    assert rows_ == ["DateYYYY", "DateYYYYMM"] and cols == [] and total  # totals need no column dimension
    assert resolve_dims({"rows": ["payee", "subcategory"]})[0] == ["Category", "Subcategory", "Payee"]


def test_running_across_chunks(spark, monkeypatch):
    import random

    from tallyframe.operators import scan

    rnd = random.Random(7)
    data = [(f"f{rnd.randint(0, 2)}", i, rnd.choice([None, None, f"v{i}"]), rnd.randint(-3, 3)) for i in range(400)]
    df = spark.createDataFrame(data, "file string, line_no long, v string, x int")
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    expect = df.withColumn("lv", F.last("v", ignorenulls=True).over(w)).withColumn("sx", F.sum("x").over(w))
    got = scan.running(df, "file", "line_no", last={"lv": F.col("v")}, total={"sx": F.col("x")}, chunk=7)
    assert rows(got, "file", "line_no", "lv", "sx") == rows(expect, "file", "line_no", "lv", "sx")
    # the split flattening and section labelling give the same answer with tiny chunks
    flat_data = [("f", 1, "1", "2022-01-01", "P1", "A", "x"), ("f", 2, None, None, None, None, None), ("f", 3, None, None, None, None, "own"), ("f", 4, "2", "2022-01-02", "P2", "A", None), ("f", 5, None, None, None, None, None)]
    fd = spark.createDataFrame(flat_data, "file string, line_no long, Num string, Date string, Payee string, Account string, Memo string").withColumn("Date", F.to_date("Date"))
    big = rows(N.flatten_splits(fd), "line_no", "Num", "Memo", "Split")
    monkeypatch.setattr(scan, "CHUNK_LINES", 2)
    assert rows(N.flatten_splits(fd), "line_no", "Num", "Memo", "Split") == big == [(2, "1", "x", "Y"), (3, "1", "own", "Y"), (5, "2", None, "Y")]


def test_rewrite_config_errors(spark):
    tx = spark.createDataFrame([("A", "P", "C")], "Account string, Payee string, Category string").withColumns(
        {"Date": F.lit(date(2020, 1, 1)), "Amount": F.lit(Decimal("1")).cast("decimal(15,4)"), "Memo": F.lit(None).cast("string"), "Subcategory": F.lit(None).cast("string")}
    )
    with pytest.raises(L.ConfigError):  # bad date spec
        L.apply_rewrites(tx, [{"txndate": "20x0-01", "select": {"payee": "P"}}])
    with pytest.raises(L.ConfigError):  # only a select, nothing to modify
        L.apply_rewrites(tx, [{"select": {"payee": "P"}}])
    with pytest.raises(L.ConfigError):  # an empty select list
        L.apply_rewrites(tx, [{"payee": "Q", "select": {"payee": []}}])
    with pytest.raises(L.ConfigError):  # directive not allowed in rewrites
        L.apply_rewrites(tx, [{"payee": "Q", "select": {"txntype": "Expense"}}])


def test_export_missing_columns(spark):
    from tallyframe.sources import exports as X

    lines = ["Title", "Num,Date,Payee,Amount", "1,2022-01-01,A,1.00"]
    df = spark.createDataFrame([("f", i + 1, t, None) for i, t in enumerate(lines)], "file string, line_no long, line string, modified timestamp")
    probs = X.export_problems(df, X.KINDS["account_txns"]).collect()
    assert [p.problem for p in probs] == ["missing columns: Account, Category"]
    assert X.read_export(df, X.KINDS["account_txns"]).count() == 0
