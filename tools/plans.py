"""Summarize the physical plans of the headline queries (stored ledger) into PLANS.md.

Usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tallyframe.ledger import Ledger  # noqa: E402
from tallyframe.operators.filters import apply_select  # noqa: E402
from tallyframe.plans import fanout as K  # noqa: E402
from tallyframe.plans import pivot as P  # noqa: E402
from tallyframe.plans import reports as R  # noqa: E402
from tallyframe.session import local_session  # noqa: E402
from tallyframe.sources import binding  # noqa: E402
from tallyframe.sources.store import read_ledger, write_ledger  # noqa: E402


def summary(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        s = line.strip(" :+-")
        if re.match(r"(Exchange|BroadcastExchange|SortMergeJoin|BroadcastHashJoin|BroadcastNestedLoopJoin|ShuffledHashJoin|HashAggregate|Window|Generate|Expand|FileScan)", s):
            s = re.sub(r"#\d+L?", "", s)
            s = re.sub(r"Location: [^,]+, ", "", s)
            s = re.sub(r", \[plan_id=\d+\]", "", s)
            out.append(s[:230])
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    d = tempfile.mkdtemp(prefix="tallyframe-plans-")
    write_ledger(Ledger.from_testdata(spark, sf), os.path.join(d, "ledger"))
    lg = read_ledger(spark, os.path.join(d, "ledger"), binding.LEDGER_CONFIG)
    cases = {
        "filtered view (pushdown + pruning)": apply_select(lg.view, {"account": "NATION_1", "date_from": "1998-01", "date_to": "1998-06"}, lg.ctx()).select("Date", "Amount", "TxnType"),
        "account-class filter (semi-join)": apply_select(lg.view, {"account_classification": "!Assets", "txntype": "Transfer"}, lg.ctx()).select("Date", "Amount"),
        "pivot pre-aggregate (grouping sets)": P.pivot_base(lg, {"select": {"txntype": "Expense"}}, ["Category", "Subcategory"], ["DateYYYY"]).groupBy("Category", "Subcategory", "DateYYYY").sum("Amount"),
        "pivot (final, from the materialized aggregate)": P.pivot(lg, {"select": {"txntype": "Expense"}}),
        "transactions report (range-partitioned numbering)": R.txns_report(lg, {"select": {"account": "NATION_1"}}, drop_constant=False),
        "fan-out by account": K.foreach_txns(lg, {"select": {"category": "PROMO"}}, "account"),
        "single-payee categories": R.single_payee_categories(lg, {"select": {"txntype": "Expense"}}),
    }
    lines = [
        "# Physical plans of headline queries",
        "",
        f"Generated by `tools/plans.py` on the stored ledger built from `{sf}` (local[8], AQE on).",
        "Only exchanges, joins, aggregates, windows, generators and scans are listed (top-down).",
        "",
    ]
    for name, df in cases.items():
        df.write.format("noop").mode("overwrite").save()  # AQE: the final plan is known after a run
        lines += [f"## {name}", "", "```", *summary(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
