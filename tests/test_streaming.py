"""Incremental export ingestion: two runs over a folder that receives a new file in between."""

import os
import tempfile

from tallyframe.streaming.ingest import stream_txn_exports

HEAD = "Account transactions\r\nAll accounts\r\nUS dollar\r\n1/1/2022 through 12/31/2022\r\nNum,Date,Payee,Account,Category,Amount\r\n"


def _write(d, name, rows, total):
    with open(os.path.join(d, name), "wb") as f:
        f.write((HEAD + rows + f"Grand Total,,,,,{total}\r\n").encode("cp1252"))


def test_incremental(spark):
    base = tempfile.mkdtemp(prefix="tallyframe-stream-")
    src, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    _write(src, "a.csv", "1,2022-01-01,A,Checking,Food,(1.00)\r\n2,2022-01-02,B,Checking,Rent,(2.00)\r\n", "(3.00)")
    with open(os.path.join(src, "junk.csv"), "w") as f:
        f.write("not an export\n")
    stream_txn_exports(spark, src, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    _write(src, "b.csv", "3,2022-02-01,C,Savings,Pay,$5.00\r\n", "5.00")
    stream_txn_exports(spark, src, out, ck).awaitTermination()
    got = sorted((r.Payee, float(r.Amount)) for r in spark.read.parquet(out).collect())
    assert got == [("A", -1.0), ("B", -2.0), ("C", 5.0)]
