"""What an import of exports writes: lines and facts once."""

import os

from pyspark.sql import functions as F
from small_tables import SMALL
from test_assemble import FILES

from tallyframe.plans import assemble as A
from tallyframe.plans import catalog
from tallyframe.session import shared_path
from tallyframe.sources import binding
from tallyframe.sources import export_binding as EB
from tallyframe.sources.exports import LINE_SCHEMA
from tallyframe.sources.store import read_ledger, write_ledger


def line_table(spark):
    return spark.createDataFrame([(name, i + 1, line, None) for name, lines in FILES.items() for i, line in enumerate(lines)] + [(None, 1, "Num,", None)], LINE_SCHEMA)


def made(spark, kind):
    top = os.path.dirname(shared_path(spark, "x")).removeprefix("file:")
    return {n for n in os.listdir(top) if n.startswith(kind)} if os.path.isdir(top) else set()


def test_the_bulk_of_the_lines_stays_where_it_is(spark, monkeypatch):
    lines = line_table(spark).filter("file IS NULL OR file IN ('txns.csv', 'details.csv', 'junk.csv')")
    want = {k: sorted(map(tuple, A.ledger_from_lines(spark, lines).of_kind(k).collect())) for k in ("account_txns", "account_balances_details")}
    monkeypatch.setattr(A, "BULK_LINES", 5)
    ledger = A.ledger_from_lines(spark, lines)
    assert ledger._bulk == "account_txns"
    assert {k: sorted(map(tuple, ledger.of_kind(k).collect())) for k in want} == want and len(want["account_txns"]) == len(FILES["txns.csv"])
    assert {r.kind for r in ledger._dealt.select("kind").distinct().collect()} == {"account_balances_details"}
    assert ledger.of_kind("account_txns").columns == ledger.lines.columns
    half = A.ledger_from_lines(spark, line_table(spark))
    assert half._bulk is None, "no kind has more than half of the lines"


def test_stored_transactions_are_not_copied_before_they_are_numbered(spark, tmp_path):
    ledger = A.ledger_from_lines(spark, line_table(spark), {"eras": {"E": {"date_from": "2022"}}})
    want = sorted(map(tuple, ledger.tables()["Txns"].drop("N").collect()), key=str)
    before = made(spark, "facts-") | made(spark, "txns-")
    write_ledger(ledger, str(tmp_path / "ledger"))
    assert made(spark, "facts-") | made(spark, "txns-") == before
    stored = read_ledger(spark, str(tmp_path / "ledger")).tables()["Txns"]
    assert sorted(map(tuple, stored.drop("N").collect()), key=str) == want
    assert sorted(r.N for r in stored.collect()) == list(range(1, len(want) + 1))


def test_spending_is_rendered_from_totals(spark, ledger, monkeypatch):
    monkeypatch.setattr(binding, "_TOTALS", {})
    for monthly in (False, True):
        got, want = EB.spending_export_lines(catalog._totals_view(spark, SMALL), monthly), EB.spending_export_lines(ledger.view, monthly)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 20
    monkeypatch.setattr(binding, "_TOTALS", {})
    monkeypatch.setattr(binding, "_FACTS", {})
    before = made(spark, "facts-")
    fresh = binding.category_totals(spark, SMALL)
    assert made(spark, "facts-") == before, "the facts are stored for a few totals"
    assert fresh.agg(F.sum("Amount")).first()[0] == ledger.txns.agg(F.sum("Amount")).first()[0]
