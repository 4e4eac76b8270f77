"""Sections by stack summaries: against a plain stack, whatever the chunk and the depth."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import normalize as N
from tallyframe.operators import sections as S
from tallyframe.plans import ingest as I

LINES = "file string, line_no long, line string, modified timestamp"


def brute(lines):
    """(line_no, stack, role) of (line_no, name, opens) lines."""
    stack, out = [], []
    for n, name, opens in lines:
        role = "item"
        if opens:
            stack.append(name)
            role = "open"
        elif name.startswith("Total "):
            if stack and stack[-1] == name[6:]:
                stack.pop()
                role = "close"
            elif name[6:] in stack:
                role = "fault"
        out.append((n, list(stack), role))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_against_a_stack(spark, chunk):
    rng = random.Random(chunk)
    rows, want = [], {}
    for f in range(12):
        lines, n = [], 0
        for _ in range(rng.randint(0, 120)):
            n += rng.randint(1, 3)
            kind = rng.random()
            name = rng.choice("ABCD")
            lines.append((n, name if kind < 0.6 else f"Total {name}", kind < 0.35))
        rows += [(f"f{f}", *x) for x in lines]
        want |= {(f"f{f}", n): (s, r) for n, s, r in brute(lines)}
    df = spark.createDataFrame(rows, "file string, line_no long, name string, opens boolean")
    got = {(r.file, r.line_no): (r._stack, r._role) for r in S.open_sections(df, "name", F.col("opens"), chunk).collect()}
    assert got == want
    assert {r for _, r in want.values()} == {"open", "close", "item", "fault"} and max(len(s) for s, _ in want.values()) > 5


def test_a_rejected_total_opens_nothing(spark):
    text = ["Spending", "Category,Total", "Expense Categories,", "Food,1x2", "Rent,3.00", "Gas,4.00", "Total Expense Categories,x", "Stray,1.00", "Grand Total,7.00"]
    lines = spark.createDataFrame([("f", i + 1, t, None) for i, t in enumerate(text)], LINES)
    items, _ = I.parse_spending(lines)
    assert sorted((r.Category, r.TxnType) for r in items.collect()) == [("Gas", "Expense"), ("Rent", "Expense")]
    assert [(r.line_no, r.problem) for r in I.spending_problems(lines).collect()] == [(8, "row outside any section")]
    assert sorted((r.line_no, r.value) for r in I.amount_problems(lines, "income_spending").collect()) == [(4, "1x2"), (7, "x")]


def test_two_levels_with_rejects_and_faults(spark):
    text = ["B", "As of 01/31/2022", "Account,Total", "Assets,", "Bank,", "A,1.00", "B,?", "C,3.00", "Total Assets,4.00", "Total Bank,4.00", "Deep,", "Deeper,", "Total Deeper,0.00", "Total Deep,0.00", "Total Assets,4.00", "Lost,1.00", "Net Worth,4.00"]
    lines = spark.createDataFrame([("f", i + 1, t, None) for i, t in enumerate(text)], LINES)
    items, _, problems = I.parse_balances(lines)
    assert sorted((r.Account, r.Type, r.Subtype) for r in items.collect()) == [("A", "Assets", "Bank"), ("C", "Assets", "Bank")]
    assert sorted((r.line_no, r.problem) for r in problems.collect()) == [(9, "total does not close the open section"), (12, "third section level"), (16, "row outside any section")]


def test_one_window_whatever_the_depth(spark):
    rows = spark.createDataFrame([("f", 1, "Assets", None), ("f", 2, "Bank", None), ("f", 3, "A", 1.0)], "file string, line_no long, Account string, Total double")
    plan = N.label_sections_2level(rows)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" :+-").startswith("Window ") for line in plan.splitlines()) == 1
