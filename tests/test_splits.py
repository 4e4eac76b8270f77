"""Split transactions are flattened in one pass over the lines, wherever a file is cut."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import normalize as N
from tallyframe.operators import scan
from tallyframe.operators.fill import filled
from tallyframe.plans import ingest as I
from tallyframe.sources import exports as X

SCHEMA = "file string, line_no long, Num string, Date date, Payee string, Account string, Memo string, Amount int, _has_date boolean"
COLUMNS = ["file", "line_no", "Num", "Date", "Payee", "Account", "Memo", "Amount", "Split"]


def some_rows():
    from datetime import date

    rnd = random.Random(7)
    out = []
    for file in ("a", "b", "c", "d"):
        line = 0
        for _ in range(60):
            line += rnd.choice([1, 1, 1, 4])
            dated = rnd.random() < 0.4
            day = date(2020, 1, rnd.randint(1, 28)) if dated and rnd.random() < 0.9 else None
            text = [rnd.choice([None, f"{file}{line}"]) if dated else None for _ in range(3)]
            out.append((file, line, text[0], day, text[1], text[2], rnd.choice([None, f"m{line}"]), line, dated))
    return out


def flattened(rows):
    out = []
    for i, r in enumerate(rows):
        below = rows[i + 1] if i + 1 < len(rows) and rows[i + 1][0] == r[0] else None
        if r[8] and below and not below[8]:
            continue
        above = next((p for p in reversed(rows[: i + 1]) if p[0] == r[0] and p[8]), None)
        part = not r[8] and above is not None
        p = above if part else r
        out.append((r[0], r[1], p[2], p[3], p[4], p[5], r[6] if r[6] is not None or not part else p[6], r[7], "Y" if part else None))
    return out


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_parts_take_from_the_dated_row_above(spark, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK_LINES", chunk)
    rows = some_rows()
    mixed = random.Random(1).sample(rows, len(rows))
    for data, parts in ((rows, 1), (rows, 7), (mixed, 5)):
        frame = spark.createDataFrame(data, SCHEMA).coalesce(1) if parts == 1 else spark.createDataFrame(spark.sparkContext.parallelize(data, parts), SCHEMA)
        got = sorted(map(tuple, N.flatten_splits(frame).select(*COLUMNS).collect()), key=lambda r: r[:2])
        assert got == flattened(rows)


def started(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_not_dealt_out_again(spark, tmp_path):
    text = ["All", "Num,Date,Payee,Account,Memo,Category,Amount", "1,2020-01-01,P,A,m,X,(3.00)", ",,,,,Y,(1.00)", ",,,,,Z,(2.00)", "Grand Total,,,,,,(3.00)"]
    spark.createDataFrame([("f", i + 1, t, None) for i, t in enumerate(text)], X.LINE_SCHEMA).write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    parsed = started(X.read_export(lines, X.KINDS["account_txns"]))
    assert "SortMergeJoin" not in parsed and "Exchange hashpartitioning" not in parsed, "lines are shuffled to meet their header"
    got = I.parse_txn_exports(lines).rows
    assert "LeftAnti" not in started(got), "flattened rows are shuffled to find the parents"
    assert [(r.Num, r.Category, r.Split) for r in got.orderBy("line_no").collect()] == [("1", "Y", "Y"), ("1", "Z", "Y")]


@pytest.mark.parametrize("batch", [1, 4, 10_000])
def test_lines_in_order_are_filled_where_they_lie(spark, batch):
    rows = some_rows()
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for parts in (1, 9):
            frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), SCHEMA)
            assert filled(frame, "file", "line_no", F.col("_has_date"), ["Num"]) is not None
            flat = N.flatten_splits(frame)
            assert "hashpartitioning" not in started(flat), "lines that lie in order are dealt out"
            assert sorted(map(tuple, flat.select(*COLUMNS).collect()), key=lambda r: r[:2]) == flattened(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_lines_out_of_order_are_dealt_out(spark):
    rows = some_rows()
    turned = spark.createDataFrame(spark.sparkContext.parallelize(rows[::-1], 2), SCHEMA)  # runs of one row, one after the other
    assert sorted(map(tuple, N.flatten_splits(turned).select(*COLUMNS).collect()), key=lambda r: r[:2]) == flattened(rows)
    for data in (rows[:5] + rows[4:], rows[::2] + rows[1::2], [(r[0], None, *r[2:]) if i == 7 else r for i, r in enumerate(rows)]):
        frame = spark.createDataFrame(spark.sparkContext.parallelize(data, 2), SCHEMA)
        assert filled(frame, "file", "line_no", F.col("_has_date"), ["Num"]) is None
