"""Keys over whole tables: no row is outside what they read (rows against SQL: test_oracle.py)."""

import __spark_entry__ as E
from small_tables import SMALL


def test_keys_that_read_every_row(spark, ledger):
    queries = E.queries()
    n = ledger.txns.count()
    assert queries["txns_columns_all"](spark, SMALL).count() == n
    assert queries["txns_inv_all"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/events.parquet").count()
    total = sum(r[0] for r in ledger.txns.select("Amount").collect())
    whole = queries["txns_consolidated_all"](spark, SMALL)
    assert abs(sum(r.Amount for r in whole.collect()) - float(total)) < 0.01
    last = [r for r in queries["pivot_cols_multi_all"](spark, SMALL).collect() if r.EraName == "Total"]
    assert len(last) == 1 and abs(last[0].Total - float(total)) < 0.01
    income = queries["drop_constant_columns_all"](spark, SMALL)
    assert income.count() == queries["txns_all"](spark, SMALL).filter("TxnType = 'Income'").count() and "TxnType" not in income.columns
