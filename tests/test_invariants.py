"""Invariants on the small test tables, plus the store and sinks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from small_tables import SMALL
from tallyframe.operators import checks as C
from tallyframe.operators.filters import FilterContext, SpecError, apply_select
from tallyframe.plans import fanout as K
from tallyframe.plans import pivot as P
from tallyframe.plans import reports as R
from tallyframe.sources import binding
from tallyframe.sources import exports as X
from tallyframe.sources.store import read_ledger, write_ledger, write_reports


def test_pivot_corner_is_the_total(ledger):
    spec = {"select": {"txntype": "Expense"}}
    piv = P.pivot(ledger, spec)
    corner = piv.filter(F.col("Category") == "Total").select("Total").first()[0]
    total = apply_select(ledger.view, spec["select"], ledger.ctx()).agg(F.sum("Amount")).first()[0]
    assert corner == total
    # column totals add up to the corner too
    year_cols = [c for c in piv.columns if c[:2] in ("19", "20")]
    row = piv.filter(F.col("Category") == "Total").first()
    assert sum(row[c] for c in year_cols if row[c] is not None) == corner


def test_pivot_has_no_column_limit(spark):
    from types import SimpleNamespace

    rows = [(f"c{i % 3}", f"t{i:04d}", 1) for i in range(1400)]
    view = spark.createDataFrame(rows, "Category string, TxnType string, Amount int").withColumn("Amount", F.col("Amount").cast("decimal(15,4)"))
    small = SimpleNamespace(view=view, accounts=None, ctx=FilterContext, eras=None)
    wide = P.pivot(small, {"options": {"rows": "category", "columns": "txntype"}})
    assert len(wide.columns) == 1402 and wide.filter("Category = 'Total'").first()["Total"] == 1400


def test_pivot_labels_that_read_like_margins(spark):
    from types import SimpleNamespace

    rows = [("Total", "Total", "x", -5), ("Food", "Total", "a|b", -7), ("Food", "b", "a", -11), ("Food", "a|b", "c", 1), ("Food", "a", "b|c", 2)]
    view = spark.createDataFrame(rows, "Category string, TxnType string, TxnClass string, Amount int").withColumn("Amount", F.col("Amount").cast("decimal(15,4)"))
    small = SimpleNamespace(view=view, accounts=None, ctx=FilterContext, eras=None)
    one = P.pivot(small, {"options": {"rows": "category", "columns": "txntype"}})
    assert "\\Total" in one.columns
    last = one.collect()[-1]
    assert last["Total"] == -20 and last["\\Total"] == -12
    two = P.pivot(small, {"options": {"rows": "category", "columns": ["txntype", "txnclass"]}})
    row = two.filter("Category = 'Food'").first()
    assert row["a\\|b|c"] == 1 and row["a|b\\|c"] == 2 and row["Total"] == -15
    flags = P.pivot_long(small, {"options": {"rows": "category", "columns": "txntype"}}).filter("RowTotal AND ColumnTotal").collect()
    assert [r.Amount for r in flags] == [-20]


def test_fanout_own_directive_chooses_the_reports(ledger):
    accounts = [r.Account for r in ledger.accounts.orderBy("Account").limit(3).collect()]
    got = {r.foreach for r in K.domain(ledger, {"select": {"account": accounts[:2]}}, "account").collect()}
    assert got == set(accounts[:2])
    rest = {r.foreach for r in K.domain(ledger, {"select": {"account": ["!", accounts[0]]}}, "account").collect()}
    assert accounts[0] not in rest and accounts[1] in rest
    with_class = ledger.accounts.filter("AccountClassification = 'Assets'").select("Account").distinct().count()
    fan = K.foreach_accounts(ledger, {"select": {"account_classification": "Assets"}}, "account_classification")
    assert {r.foreach for r in fan.select("foreach").distinct().collect()} == {"Assets"} and fan.count() <= with_class


def test_unknown_directives_and_wrong_dates(ledger):
    for spec in ({"accounts": "x"}, {"date_from": "20x0"}, {"date_to": "0d"}, {"date_from": "0w"}, {"yyyy": "two"}):
        with pytest.raises(SpecError):
            apply_select(ledger.view, spec, ledger.ctx())


def test_fanout_partitions_add_up(ledger):
    spec = {"select": {"category": "PROMO"}}
    fan = K.foreach_txns(ledger, spec, "account")
    whole = apply_select(ledger.view, spec["select"], ledger.ctx()).count()
    assert fan.count() == whole
    per = fan.groupBy("foreach").agg(F.count(F.lit(1)).alias("n"), F.max("N").alias("mx"))
    assert all(r.n == r.mx for r in per.collect())  # N restarts at 1 in every report


def test_checks_are_clean(ledger):
    tables = {"Txns": ledger.txns_numbered(), "Accounts": ledger.accounts, "Payees": ledger.payees, "Categories": ledger.categories, "Eras": ledger.eras}
    assert all(r.violations == 0 for r in C.orphans(tables).collect())
    assert all(r.duplicates == 0 for r in C.duplicates(tables).collect())
    assert all(r.nulls == 0 for r in C.not_null(tables).collect())
    assert C.fanout(ledger.txns, ledger.view).first().ok


def test_column_exclusion(ledger):
    rep = R.txns_report(ledger, {"select": {"txntype": "Income"}, "columns": ["!", "Memo", "Txn Class"]}, drop_constant=False)
    assert "Memo" not in rep.columns and "TxnClass" not in rep.columns and "Payee" in rep.columns


def test_store_roundtrip_and_sinks(spark, ledger):
    d = tempfile.mkdtemp(prefix="tallyframe-store-")
    write_ledger(ledger, os.path.join(d, "ledger"))
    stored = read_ledger(spark, os.path.join(d, "ledger"), binding.LEDGER_CONFIG)
    assert stored.txns.count() == ledger.txns.count()
    n = stored.txns_numbered().agg(F.min("N").alias("lo"), F.max("N").alias("hi"), F.count_distinct("N").alias("k"), F.count(F.lit(1)).alias("c")).first()
    assert (n.lo, n.hi, n.k) == (1, n.c, n.c)  # dense 1..n
    a = P.pivot(ledger, {"select": {"txntype": "Income"}}).collect()
    b = P.pivot(stored, {"select": {"txntype": "Income"}}).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    with pytest.raises(FileNotFoundError):
        read_ledger(spark, os.path.join(d, "nothing"))
    empty = stored.view.filter(F.lit(False))
    fan = K.foreach_txns(stored, {"select": {"category": "PROMO"}}, "era")
    written = write_reports({"promo by era": fan, "empty": empty}, os.path.join(d, "reports"))
    assert set(written) == {"promo by era"}
    assert spark.read.parquet(written["promo by era"]).select("foreach").distinct().count() >= 1
    assert not X.write_interim(empty, os.path.join(d, "interim-empty"))
    assert X.write_interim(stored.payees, os.path.join(d, "interim"))
    assert spark.read.option("header", True).csv(os.path.join(d, "interim")).count() == stored.payees.count()
