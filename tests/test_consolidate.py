"""Monthly consolidation: what a group shows of its first transaction, and how much of it travels."""

import random
from datetime import date
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import functions as F

from tallyframe.ledger import SOURCE_ORDER
from tallyframe.plans import reports as R

SCHEMA = (
    "Date date, Account string, Payee string, Category string, Subcategory string, XferAccount string, Amount decimal(15,4), TxnType string, TxnClass string, Memo string, C string, "
    "EraName string, SrcDate date, SrcOrder long, SrcLine int"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def some_rows(n=400):
    rnd = random.Random(2)
    out = []
    for i in range(n):
        day = rnd.choice([date(2020, m, d) for m in (1, 2) for d in (1, 9)])
        text = [rnd.choice([None, "a", "b"]) for _ in range(8)]
        out.append((day, *text[:5], rnd.choice([None, Decimal(rnd.randint(-3, 3))]), "Expense", text[5], text[6], text[7], rnd.choice([None, "e"]), rnd.choice([None, day]), rnd.choice([None, 1, 2]), rnd.choice([None, 1])))
    return out + out[:20]


def key(values):
    return tuple((v is not None, v) if v is not None else (False,) for v in values)


def test_a_group_shows_its_first_transaction(spark):
    data = some_rows()
    rows, order, shown = R.layout(SimpleNamespace(order_key=SOURCE_ORDER), spark.createDataFrame(data, SCHEMA), {"consolidate": "yyyymm"})
    groups = {}
    for r in (dict(zip(NAMES, r, strict=True)) for r in data):
        r["DateYYYYMM"] = r["Date"].replace(day=1)
        groups.setdefault(tuple(r[c] for c in R.CONSOLIDATED_BY), []).append(r)
    got = {tuple(r[c] for c in R.CONSOLIDATED_BY): r for r in rows.collect()}
    assert got.keys() == groups.keys() and len(got) < len(data)
    places = {}
    for k, members in groups.items():
        least = min(key(m[c] for c in SOURCE_ORDER) for m in members)
        first = [m for m in members if key(m[c] for c in SOURCE_ORDER) == least]
        assert tuple(got[k][c] for c in R.CONSOLIDATED_FIRST) in {tuple(m[c] for c in R.CONSOLIDATED_FIRST) for m in first}
        amounts = [m["Amount"] for m in members if m["Amount"] is not None]
        assert got[k].Amount == (sum(amounts) if amounts else None)
        places[k] = (key([got[k].DateYYYYMM, got[k].Category, got[k].Subcategory, got[k].Payee, got[k].Account]), least)
    in_order = [tuple(r[c] for c in R.CONSOLIDATED_BY) for r in rows.orderBy(*[F.col(c).asc_nulls_first() for c in order]).collect()]
    assert [places[k] for k in in_order] == sorted(places.values())


def test_a_groups_first_transaction_travels_once(spark):
    rows, order, _ = R.layout(SimpleNamespace(order_key=SOURCE_ORDER), spark.createDataFrame(some_rows(), SCHEMA), {"consolidate": "yyyymm"})
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and plan.count("min(struct") == 1
    assert not any(f.dataType.typeName() == "struct" for f in rows.schema.fields) and len(order) == len(set(order))
