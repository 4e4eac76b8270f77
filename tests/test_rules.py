"""Ordered rewrite rules: each row meets the rules that may apply to it, and no rule that applies is missed."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ledger as L
from tallyframe.operators import rules as R
from tallyframe.operators.filters import FilterContext
from tallyframe.plans.catalog_imports import _many_rules

SCHEMA = "Account string, Payee string, Category string, Subcategory string, Memo string, Amount decimal(15,4), Date date"


def literals(rules):
    return R.rules_literal(rules, [L._rule_assignments(r) for r in rules], FilterContext())


def some_rows(rnd, n=300):
    words = [None, "a", "A b", "ab%", "b_", "Group 1", "group 1", "Énd", "x\\y", ""]
    return [tuple(rnd.choice(words) for _ in range(5)) + (rnd.choice([None, Decimal(rnd.randint(-5, 5))]), rnd.choice([None, date(2020, rnd.randint(1, 12), 3)])) for _ in range(n)]


def some_rules(rnd, n=40):
    texts = ["a", "A b", "%b", "%%b%", "a_%", "Group 1", "!a", "%", "!%", "b_", "%%Énd", "ab%"]
    rules = []
    for _ in range(n):
        select = {rnd.choice(["payee", "account", "memo"]): rnd.choice([rnd.choice(texts), [rnd.choice(["a", "A b", "%%b%", "Group 1"]) for _ in range(2)]])}
        if rnd.random() < 0.3:
            select["category"] = [rnd.choice(["a", "a:", "A b:Group 1", "Group 1"])]
        if rnd.random() < 0.3:
            select["amount"] = rnd.choice(["< 0", ">= 2", "!= 1"])
        sets = {"payee": rnd.choice(["a", "A b", "Group 1", "b_"]), "memo": rnd.choice([None, "b", "ab%"]), "category": rnd.choice(["a", "A b : Group 1", "Group 1"])}
        rules.append({k: sets[k] for k in rnd.sample(list(sets), rnd.randint(1, 2))} | {"select": select})
    return rules


@pytest.mark.parametrize("most", [R.MOST_FOLLOWING, 50])
def test_no_rule_that_applies_is_left_out(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_FOLLOWING", most)
    rnd = random.Random(4)
    txns = spark.createDataFrame(some_rows(rnd), SCHEMA).coalesce(1).cache()
    for _ in range(3):
        rules = some_rules(rnd)
        every, met = literals(rules)
        got = R.fold_rules(txns, every, met).collect()
        assert got == R.fold_rules(txns, every, F.sequence(F.lit(0), F.lit(len(rules) - 1))).collect()
        assert sum(len(r[R.HITS]) for r in got) > 100


def test_a_row_meets_only_what_may_apply(spark):
    rules = _many_rules()
    _, met = literals(rules)
    rows = spark.createDataFrame([(None, p, None, None, None, None, None) for p in ("Supplier#000000007", "Supplier#000000900", "Group 07", None)], SCHEMA)
    found = [r.met for r in rows.coalesce(1).select(met.alias("met")).collect()]
    assert found == [[6, 260 + 7, 280 + 7], [], [260 + 7, 280 + 7], []]
