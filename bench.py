"""Headline timings: build + store the ledger once, then run the headline reports on it.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyframe.ledger import Ledger  # noqa: E402
from tallyframe.operators import checks as C  # noqa: E402
from tallyframe.operators.filters import apply_select  # noqa: E402
from tallyframe.plans import fanout as K  # noqa: E402
from tallyframe.plans import ingest as I  # noqa: E402
from tallyframe.plans import pivot as P  # noqa: E402
from tallyframe.plans import reports as R  # noqa: E402
from tallyframe.session import local_session  # noqa: E402
from tallyframe.sources import binding  # noqa: E402
from tallyframe.sources import export_binding as EB  # noqa: E402
from tallyframe.sources.store import read_ledger, write_ledger  # noqa: E402


def run(df) -> None:
    """Execute the whole plan without collecting rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="tallyframe-bench")
    scratch = tempfile.mkdtemp(prefix="tallyframe-bench-")
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    built = Ledger.from_testdata(spark, sf_dir)
    timed("ledger_build", lambda: write_ledger(built, os.path.join(scratch, "ledger")))
    lg = read_ledger(spark, os.path.join(scratch, "ledger"), binding.LEDGER_CONFIG)

    headline = {
        "pivot_default": lambda: P.pivot(lg, {"select": {"txntype": "Expense"}}),
        "pivot_era_cols": lambda: P.pivot(lg, {"select": {"txntype": "!Transfer"}, "options": {"rows": "category", "columns": "era"}}),
        "pivot_account_attrs": lambda: P.pivot(lg, {"options": {"rows": ["account_classification", "account_category"], "columns": "txntype"}}),
        "pivot_total": lambda: P.pivot(lg, {"options": {"rows": ["yyyy", "yyyymm"], "columns": "total"}}),
        "txns_all": lambda: R.txns_report(lg, {}),
        "txns_filtered": lambda: R.txns_report(lg, {"select": {"account": "NATION_1", "date_from": "1998-01", "date_to": "1998-06"}}),
        "txns_consolidated": lambda: R.txns_report(lg, {"consolidate": "yyyymm", "select": {"txntype": "Income"}}, drop_constant=False),
        "foreach_account": lambda: K.foreach_txns(lg, {"select": {"category": "PROMO"}}, "account"),
        "foreach_pivot_yyyy": lambda: K.foreach_pivot(lg, {"options": {"rows": "category", "columns": "txntype"}}, "yyyy"),
        "filter_like_relative": lambda: apply_select(lg.view, {"memo": "%%ring%", "date_from": "-12m"}, lg.ctx()),
        "categories_report": lambda: R.categories_report(lg, {"select": {"txnclass": "!Discretionary"}}),
        "single_payee": lambda: R.single_payee_categories(lg, {"select": {"txntype": "Expense"}}),
        "check_orphans": lambda: C.orphans({"Txns": lg.txns, "Accounts": lg.accounts, "Payees": lg.payees, "Categories": lg.categories, "Eras": lg.eras}),
        "check_duplicates": lambda: C.duplicates({"Txns": lg.txns_numbered(), "Accounts": lg.accounts, "Payees": lg.payees}),
    }
    for name, make in headline.items():
        timed(name, lambda make=make: run(make()))

    # the export files exist before ingestion starts: render them (untimed) as a stored line table
    lines_dir = os.path.join(scratch, "export_lines")
    EB.txn_export_lines(spark, sf_dir).write.parquet(lines_dir)

    def ingest():
        imp = I.parse_txn_exports(spark.read.parquet(lines_dir))
        imp.rows.write.parquet(os.path.join(scratch, "imported"))
        imported = spark.read.parquet(os.path.join(scratch, "imported"))
        run(C.control_total(imported, imp.footer))

    timed("ingest_exports", ingest)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
