"""Registered queries over faulty exports, long rule and interval lists, and their DuckDB oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import ledger as L
from ..sources import dirty_binding as D
from ..session import cut_lineage, shared_path
from ..sources import export_binding as EB
from ..sources import exports as X
from ..sources.store import read_ledger, write_ledger
from . import ingest as I
from .assemble import ledger_from_lines
from . import pivot as P
from . import reports as R
from .catalog import _ORDERS_SQL, _ledger_with, _pivot_sql, _rendered, on_ledger, register
from .oracle import REPORT_ORDER, with_ledger

# ---------------------------------------------------------------------------------------------
# sections with rejects


def _sections_rejects(spark: SparkSession, sf: str) -> DataFrame:
    lines = D.supplier_sections(spark, sf)
    items, _, problems = I.parse_balances(lines)
    found = items.groupBy("file", "Type", "Subtype").agg(F.count(F.lit(1)).alias("n"), F.sum("Total").cast("double").alias("total"))
    rejects = I.amount_problems(lines, "account_balances").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    faults = problems.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("double")
    return found.unionByName(rejects.select("file", F.lit("rejected total").alias("Type"), none.alias("Subtype"), "n", zero.alias("total"))).unionByName(
        faults.select("file", F.lit("fault").alias("Type"), none.alias("Subtype"), "n", zero.alias("total"))
    )


register(
    "sections_rejects",
    """WITH s AS (SELECT 'suppliers_' || r_name AS file, n_name, s_suppkey % 7 = 0 AS bad, CAST(s_acctbal AS DECIMAL(15,4)) AS bal
         FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
       SELECT file, 'Assets' AS "Type", n_name AS Subtype, COUNT(*) AS n, CAST(SUM(CAST(round(bal, 2) AS DECIMAL(15,4))) AS DOUBLE) AS total
       FROM s WHERE NOT bad GROUP BY file, n_name
       UNION ALL SELECT file, 'rejected total', NULL, COUNT(*), NULL FROM s WHERE bad GROUP BY file""",
)(_sections_rejects)

# ---------------------------------------------------------------------------------------------
# what an import leaves out


def _import_problems(spark: SparkSession, sf: str) -> DataFrame:
    ledger = ledger_from_lines(spark, D.faulty_orders(spark, sf))
    found = ledger.problems().groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
    kept = ledger.txn_import.rows.select(F.lit("(kept)").alias("problem"), "file").groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
    return found.unionByName(kept)


register(
    "import_problems",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey // 5000 AS f FROM orders),
       p AS (SELECT 'Date' AS problem, f FROM o WHERE k % 97 = 0
             UNION ALL SELECT 'Amount', f FROM o WHERE k % 89 = 0 OR k % 83 = 0
             UNION ALL SELECT '(kept)', f FROM o WHERE k % 97 <> 0 AND k % 89 <> 0 AND k % 83 <> 0)
       SELECT problem, COUNT(*) AS n, COUNT(DISTINCT f) AS files FROM p GROUP BY problem
       UNION ALL SELECT 'missing columns: Category', COUNT(DISTINCT k % 2), COUNT(DISTINCT k % 2) FROM o
       UNION ALL SELECT 'unknown kind', 1, 1""",
)(_import_problems)


def _txns_inv_rejects(spark: SparkSession, sf: str) -> DataFrame:
    got = I.import_investments(D.faulty_investments(EB.investment_rows(spark, sf)))
    kept = got.rows.select(F.lit("kept").alias("what"), F.col("Price").isNotNull().cast("int").alias("priced"), "Total")
    kept = kept.groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.sum("priced").cast("long").alias("priced"), F.sum("Total").cast("double").alias("total"))
    none = F.lit(None).cast("long")

    def counted(rows: DataFrame, what: F.Column) -> DataFrame:
        return rows.groupBy(what.alias("what")).agg(F.count(F.lit(1)).alias("n")).select("what", "n", none.alias("priced"), none.cast("double").alias("total"))

    dates = counted(got.date_rejects, F.when(F.col("value").isNull(), F.lit("no date")).otherwise(F.lit("wrong date")))
    return kept.unionByName(dates).unionByName(counted(got.amount_rejects, F.concat(F.lit("wrong "), F.col("column"))))


register(
    "txns_inv_rejects",
    """WITH e AS (SELECT event_id AS k, CAST(round(value, 2) AS DECIMAL(15,4)) AS v FROM events)
       SELECT 'kept' AS what, COUNT(*) AS n, CAST(COUNT(*) FILTER (WHERE k % 19 <> 0) AS BIGINT) AS priced, CAST(SUM(v) AS DOUBLE) AS total
       FROM e WHERE k % 13 <> 0 AND k % 17 <> 0
       UNION ALL SELECT 'wrong date', COUNT(*), NULL, NULL FROM e WHERE k % 13 = 0
       UNION ALL SELECT 'no date', COUNT(*), NULL, NULL FROM e WHERE k % 17 = 0 AND k % 13 <> 0
       UNION ALL SELECT 'wrong Price', COUNT(*), NULL, NULL FROM e WHERE k % 19 = 0""",
)(_txns_inv_rejects)

# ---------------------------------------------------------------------------------------------
# long rule lists (L2) and long interval lists

RULE_SUPPLIERS, RULE_GROUPS = 260, 20


def _many_rules() -> list[dict]:
    """Suppliers into groups, then what the groups' transactions become: 300 rules that feed each other."""
    rules = [{"payee": f"Group {i % RULE_GROUPS:02d}", "select": {"payee": f"Supplier#{i:09d}", "amount": f"< {-100 * i}"}} for i in range(1, RULE_SUPPLIERS + 1)]
    rules += [{"category": f"Household : Group {g:02d}", "select": {"payee": f"%Group {g:02d}", "yyyy": [1995 + g % 4, 1999]}} for g in range(RULE_GROUPS)]
    rules += [{"memo": None, "payee": "Others", "select": {"payee": f"Group {g:02d}", "category": [f"Household:Group {g:02d}"]}} for g in range(RULE_GROUPS)]
    return rules


def _rewrite_many(spark: SparkSession, sf: str) -> DataFrame:
    lg = _ledger_with({"rewrites": _many_rules()})(spark, sf)
    rows = lg.txns.groupBy("Payee", "Category", "Subcategory", F.col("Memo").isNull().alias("no_memo"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("total"))


register(
    "rewrite_many",
    with_ledger(
        f"""SELECT Payee, Category, Subcategory, no_memo, COUNT(*) AS n, CAST(SUM(Amount) AS DOUBLE) AS total FROM (
              SELECT CASE WHEN h THEN 'Others' WHEN g IS NOT NULL THEN 'Group ' || g ELSE Payee END AS Payee,
                CASE WHEN h THEN 'Household' ELSE Category END AS Category, CASE WHEN h THEN 'Group ' || g ELSE Subcategory END AS Subcategory,
                (CASE WHEN h THEN NULL ELSE Memo END) IS NULL AS no_memo, Amount
              FROM (SELECT *, g IS NOT NULL AND year(Date) IN (1995 + CAST(g AS INT) % 4, 1999) AS h FROM (
                SELECT *, CASE WHEN Payee LIKE 'Supplier#%' AND CAST(substr(Payee, 10) AS BIGINT) BETWEEN 1 AND {RULE_SUPPLIERS}
                    AND Amount < -100 * CAST(substr(Payee, 10) AS BIGINT) THEN lpad(CAST(CAST(substr(Payee, 10) AS BIGINT) % {RULE_GROUPS} AS VARCHAR), 2, '0') END AS g
                FROM txns) a) b) c
            GROUP BY ALL"""
    ),
)(_rewrite_many)


def _account_months(txns: DataFrame) -> DataFrame:
    """Per account, an interval for each month with transactions but every fourth: from the month's first day to the
    next month's (which both share); the account's last one has no end."""
    months = txns.select("Account", F.trunc("Date", "month").alias("m")).distinct()
    no = (F.year("m") * 12 + F.month("m")).cast("int")
    last = txns.groupBy("Account").agg(F.max(F.trunc("Date", "month")).alias("last"))
    return months.join(last, "Account").filter(F.month("m") % 4 != 0).select(
        "Account",
        F.concat("Account", F.lit(" "), F.date_format("m", "yyyy-MM")).alias("EraName"),
        F.col("m").alias("EraDateFrom"),
        F.when(F.col("m") < F.col("last"), F.add_months("m", 1)).alias("EraDateTo"),
        no.alias("era_no"),
    )


on_ledger(
    "assign_interval_long",
    with_ledger(
        """SELECT Account, Span, COUNT(*) AS n, CAST(SUM(Amount) AS DOUBLE) AS total FROM (
             SELECT t.Account, t.Amount, i.name AS Span FROM (SELECT *, row_number() OVER () AS id FROM txns) t
             LEFT JOIN (
               SELECT a.Account, a.Account || ' ' || strftime(m, '%Y-%m') AS name, m AS f,
                 CASE WHEN m < last THEN CAST(m + INTERVAL 1 MONTH AS DATE) END AS e
               FROM (SELECT DISTINCT Account, CAST(date_trunc('month', Date) AS DATE) AS m FROM txns) a
               JOIN (SELECT Account, CAST(MAX(date_trunc('month', Date)) AS DATE) AS last FROM txns GROUP BY Account) b ON a.Account = b.Account
               WHERE month(m) % 4 <> 0) i
             ON i.Account = t.Account AND t.Date >= i.f AND (i.e IS NULL OR t.Date <= i.e)
             QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY i.f DESC) = 1) x
           GROUP BY Account, Span"""
    ),
    lambda lg: L.assign_interval_long(lg.txns, _account_months(lg.txns), ["Account"], out_col="Span").groupBy("Account", "Span").agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("total")),
)

# ---------------------------------------------------------------------------------------------
# two-phase file scan


def _prune_exports_head(spark: SparkSession, sf: str) -> DataFrame:
    found = EB.write_files(EB.yearly_balance_lines(spark, sf), shared_path(spark, f"exports-{uuid.uuid4().hex}"))
    heads = cut_lineage(X.judge_heads(X.scan_heads(spark, found), date(1997, 1, 1), date(1999, 12, 31)), "heads")
    items = I.parse_balances(X.open_exports(spark, heads))[0].groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("Total").alias("total"))
    joined = heads.join(items, "file", "left")
    return joined.select(EB.file_label(F.col("file")).alias("file"), "as_of", "opened", "problem", "n", "total")


register(
    "prune_exports_head",
    """WITH oa AS (SELECT n_name AS a, year(CAST(o_orderdate AS DATE)) AS y, CAST(o_totalprice AS DECIMAL(15,4)) AS p
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
       b AS (SELECT e.y, oa.a, CAST(round(SUM(p), 2) AS DECIMAL(15,4)) AS bal FROM generate_series(1995, 2001) e(y) JOIN oa ON oa.y <= e.y GROUP BY e.y, oa.a),
       f AS (SELECT y, COUNT(*) AS n, CAST(SUM(bal) AS DOUBLE) AS total FROM b GROUP BY y)
       SELECT 'balances_' || y AS file, y || '-12-31' AS as_of, y BETWEEN 1997 AND 1999 AS opened, NULL AS problem,
         CASE WHEN y BETWEEN 1997 AND 1999 THEN n END AS n, CASE WHEN y BETWEEN 1997 AND 1999 THEN total END AS total FROM f
       UNION ALL SELECT 'balances_undated', NULL, FALSE, 'no as-of date', NULL, NULL
       UNION ALL SELECT 'letter', NULL, FALSE, 'unknown kind', NULL, NULL""",
)(_prune_exports_head)


OTHER_KINDS = ("balances", "spending", "monthly", "loans", "details", "investments")


def _kinds(spark: SparkSession, sf: str, kinds: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_rendered(spark, sf, k) for k in kinds])


def _seven_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The line table of exports of all seven kinds (stored)."""
    return _kinds(spark, sf, ("txns", *OTHER_KINDS))


def _write_seven_kinds(spark: SparkSession, sf: str) -> str:
    """Exports of all seven kinds as files. The transactions, nearly all of the lines, are written as they are rendered: a
    file's lines are together then, and stored first they would be shuffled once more."""
    path = shared_path(spark, f"exports-{uuid.uuid4().hex}")
    txns = EB.txn_export_lines(spark, sf)
    # lines without a file's name are one file, whatever their kind
    EB.write_files(_kinds(spark, sf, OTHER_KINDS).unionByName(txns.filter("file IS NULL")), path)
    return EB.write_files(txns.filter("file IS NOT NULL"), path, gathered=True, mode="append")


def _classify_heads(spark: SparkSession, sf: str) -> DataFrame:
    found = _write_seven_kinds(spark, sf)
    heads = cut_lineage(X.judge_heads(X.scan_heads(spark, found)), "heads")
    kinds = X.classify_exports(X.open_exports(spark, heads))
    both = heads.join(kinds, "file")
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.max("as_of").alias("as_of"))


register(
    "classify_heads",
    """SELECT 'account_txns' AS kind, COUNT(DISTINCT o_orderkey // 1000) AS files, NULL AS as_of FROM orders
       UNION ALL SELECT 'investment_txns', COUNT(DISTINCT event_id // 10000), NULL FROM events
       UNION ALL SELECT 'account_balances', 1, '2001-12-31' UNION ALL SELECT 'account_balances_details', 1, '2001-06-30'
       UNION ALL SELECT 'loan_terms', 1, '2001-06-30' UNION ALL SELECT 'income_spending', 1, NULL UNION ALL SELECT 'monthly_income_expenses', 1, NULL""",
)(_classify_heads)

# ---------------------------------------------------------------------------------------------
# the whole import (E1 - E3, S8, S9): seven kinds of exports -> nine tables -> store -> nine tables

_MEASURES = {"Txns": "Amount", "TxnsInv": "Total", "Accounts": "OpeningBalance", "Loans": "LoanAmount", "AccountBalances": "Balance", "CategoryBalances": "Balance"}


def _table_sums(tables: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for name, df in tables.items():
        total = F.sum(_MEASURES[name]).cast("double") if name in _MEASURES else F.lit(None).cast("double")
        parts.append(df.agg(F.count(F.lit(1)).alias("n"), total.alias("total")).select(F.lit(name).alias("table"), "n", "total"))
    return reduce(DataFrame.unionByName, parts)


def _ledger_of_exports(spark: SparkSession, sf: str):
    return ledger_from_lines(spark, _seven_kinds(spark, sf), {"eras": {"Early": {"date_to": "1997"}, "Late": {"date_from": "1998"}}}, stored=True)


def _ledger_from_exports(spark: SparkSession, sf: str) -> DataFrame:
    ledger = _ledger_of_exports(spark, sf)
    ok = ledger.control_totals().filter("ok").agg(F.count(F.lit(1)).alias("n")).select(F.lit("(files whose control total holds)").alias("table"), "n", F.lit(None).cast("double").alias("total"))
    bad = ledger.problems().agg(F.count(F.lit(1)).alias("n")).select(F.lit("(problems)").alias("table"), "n", F.lit(None).cast("double").alias("total"))
    return _table_sums(ledger.tables()).unionByName(ok).unionByName(bad)


_LEDGER_SUMS = """
t AS (SELECT * FROM flat WHERE Num <> '**VOID**'),
inv AS (SELECT 'USER_' || user_id AS u, event_type, CAST(round(value, 2) AS DECIMAL(15,4)) AS v FROM events),
det AS (SELECT n_name, COUNT(*) AS n, CAST(SUM(CAST(c_acctbal AS DECIMAL(15,4))) AS DECIMAL(15,4)) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
bal AS (SELECT n_name, CAST(COALESCE(SUM(CAST(s_acctbal AS DECIMAL(15,4))), 0) AS DECIMAL(15,4)) AS bal FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name),
loan AS (SELECT c_mktsegment AS seg, CAST(round(SUM(abs(CAST(c_acctbal AS DECIMAL(15,4)))), 2) AS DECIMAL(15,4)) AS amt FROM customer GROUP BY 1),
acc AS (SELECT Account AS a FROM t UNION SELECT u FROM inv UNION SELECT 'NATION_0' FROM inv WHERE event_type = 'purchase' UNION SELECT seg FROM loan UNION SELECT n_name FROM bal UNION SELECT n_name FROM det),
sums AS (
  SELECT 'Txns' AS "table", COUNT(*) AS n, CAST(SUM(Amount) AS DOUBLE) AS total FROM t
  UNION ALL SELECT 'TxnsInv', COUNT(*), CAST(SUM(v) AS DOUBLE) FROM inv
  UNION ALL SELECT 'Accounts', COUNT(*), (SELECT CAST(SUM(n) AS DOUBLE) FROM det) FROM acc
  UNION ALL SELECT 'Payees', COUNT(DISTINCT Payee), NULL FROM t
  UNION ALL SELECT 'Categories', COUNT(*), NULL FROM (SELECT DISTINCT Category, Subcategory FROM t)
  UNION ALL SELECT 'Eras', 2, NULL
  UNION ALL SELECT 'Loans', COUNT(*), CAST(SUM(amt) AS DOUBLE) FROM loan
  UNION ALL SELECT 'AccountBalances', (SELECT COUNT(*) FROM bal) + (SELECT COUNT(*) FROM det),
    CAST((SELECT SUM(CAST(round(bal, 2) AS DECIMAL(15,4))) FROM bal) + (SELECT SUM(CAST(round(bal, 2) AS DECIMAL(15,4))) FROM det) AS DOUBLE)
  UNION ALL SELECT 'CategoryBalances', 0, NULL)
"""

register(
    "ledger_from_exports",
    f"""WITH {_ORDERS_SQL.strip()}, {_LEDGER_SUMS.strip()}
       SELECT * FROM sums
       UNION ALL SELECT '(files whose control total holds)', (SELECT COUNT(DISTINCT o_orderkey // 1000) FROM orders) + 3, NULL
       UNION ALL SELECT '(problems)', 0, NULL""",
)(_ledger_from_exports)


def _ledger_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, f"ledger-{uuid.uuid4().hex}")
    write_ledger(_ledger_of_exports(spark, sf), path)
    stored = read_ledger(spark, path)
    numbered = stored.tables()["Txns"].agg(F.count_distinct("N").alias("n"), F.max("N").cast("double").alias("total")).select(F.lit("(numbers)").alias("table"), "n", "total")
    return _table_sums(stored.tables()).unionByName(numbered)


register(
    "ledger_round_trip",
    f"""WITH {_ORDERS_SQL.strip()}, {_LEDGER_SUMS.strip()}
       SELECT * FROM sums UNION ALL SELECT '(numbers)', COUNT(*), CAST(COUNT(*) AS DOUBLE) FROM t""",
)(_ledger_round_trip)

# ---------------------------------------------------------------------------------------------
# constraints on tables that break them (C4, C6 - C8), and eras with gaps


def _broken_tables(lg) -> dict[str, DataFrame]:
    """The ledger's tables with faults that follow from keys: parents taken away, numbers given twice, values missing."""
    line = F.col("SrcLine")
    txns = lg.txns.withColumns(
        {
            "N": F.col("SrcOrder") * 10 + F.when(line == 3, F.lit(2)).otherwise(line),
            "Amount": F.when(line != 5, F.col("Amount")),
            "Date": F.when(F.col("SrcOrder") % 50 != 0, F.col("Date")),
        }
    )
    part = F.col("AccountNo")
    balances = lg.accounts.select("Account", F.regexp_extract("Account", "([0-9]+)$", 1).cast("int").alias("AccountNo"))
    twice = lg.payees.filter(F.col("Payee").endswith("3"))
    return {
        "Txns": txns,
        "Accounts": lg.accounts.filter("Account NOT IN ('NATION_3', 'NATION_4')"),
        "Payees": lg.payees.filter(~F.col("Payee").endswith("7")).unionByName(twice),
        "Categories": lg.categories.filter("Subcategory IS NULL OR Subcategory <> 'Brand#1'"),
        "Eras": lg.eras.filter("EraName <> 'Era B'"),
        "TxnsInv": balances.select("Account", F.concat(F.lit("NATION_"), (part + 20).cast("string")).alias("XferAccount"), F.when(part % 5 != 0, F.lit("Buy")).alias("Activity")),
        "Loans": balances.filter(part % 2 == 1).select(F.col("Account").alias("Loan")),
        "AccountBalances": balances.select("Account", F.lit(1).cast("decimal(15,4)").alias("Balance")),
    }


on_ledger(
    "check_constraints",
    with_ledger(
        """, b AS (SELECT Account, CAST(regexp_extract(Account, '([0-9]+)$', 1) AS INT) AS p FROM accts),
           par AS (SELECT Account FROM accts WHERE Account NOT IN ('NATION_3', 'NATION_4')),
           pay AS (SELECT Payee FROM (SELECT DISTINCT Payee FROM txns WHERE Payee IS NOT NULL) x WHERE Payee NOT LIKE '%7'),
           n AS (SELECT SrcOrder * 10 + CASE WHEN SrcLine = 3 THEN 2 ELSE SrcLine END AS n FROM txns)
           SELECT 'foreign key' AS kind, 'Txns' AS "table", 'Account' AS columns, 'Accounts' AS parent, (SELECT COUNT(*) FROM txns WHERE Account NOT IN (SELECT Account FROM par)) AS violations
           UNION ALL SELECT 'foreign key', 'Txns', 'XferAccount', 'Accounts', (SELECT COUNT(*) FROM txns WHERE XferAccount IS NOT NULL AND XferAccount NOT IN (SELECT Account FROM par))
           UNION ALL SELECT 'foreign key', 'Txns', 'Payee', 'Payees', (SELECT COUNT(*) FROM txns WHERE Payee LIKE '%7')
           UNION ALL SELECT 'foreign key', 'Txns', 'Category,Subcategory', 'Categories', (SELECT COUNT(*) FROM txns WHERE Subcategory = 'Brand#1')
           UNION ALL SELECT 'foreign key', 'Txns', 'EraName', 'Eras', (SELECT COUNT(*) FROM txns WHERE EraName = 'Era B')
           UNION ALL SELECT 'foreign key', 'TxnsInv', 'Account', 'Accounts', (SELECT COUNT(*) FROM b WHERE Account NOT IN (SELECT Account FROM par))
           UNION ALL SELECT 'foreign key', 'TxnsInv', 'XferAccount', 'Accounts', (SELECT COUNT(*) FROM b WHERE 'NATION_' || (p + 20) NOT IN (SELECT Account FROM par))
           UNION ALL SELECT 'foreign key', 'Loans', 'Loan', 'Accounts', (SELECT COUNT(*) FROM b WHERE p % 2 = 1 AND Account NOT IN (SELECT Account FROM par))
           UNION ALL SELECT 'foreign key', 'AccountBalances', 'Account', 'Accounts', (SELECT COUNT(*) FROM b WHERE Account NOT IN (SELECT Account FROM par))
           UNION ALL SELECT 'unique', 'Txns', 'N', NULL, (SELECT COUNT(*) FROM (SELECT n FROM n GROUP BY n HAVING COUNT(*) > 1) x)
           UNION ALL SELECT 'unique', 'Accounts', 'Account', NULL, 0
           UNION ALL SELECT 'unique', 'Payees', 'Payee', NULL, (SELECT COUNT(*) FROM pay WHERE Payee LIKE '%3')
           UNION ALL SELECT 'not null', 'Txns', 'Amount', NULL, (SELECT COUNT(*) FROM txns WHERE SrcLine = 5)
           UNION ALL SELECT 'not null', 'Txns', 'Date', NULL, (SELECT COUNT(*) FROM txns WHERE SrcOrder % 50 = 0)
           UNION ALL SELECT 'not null', 'TxnsInv', 'Activity', NULL, (SELECT COUNT(*) FROM b WHERE p % 5 = 0)"""
    ).replace("\n, b AS", ",\n b AS"),
    # constraints that a test row cannot break (key columns of the dimensions) are left to their own keys
    lambda lg: C.constraints(_broken_tables(lg)).filter("kind <> 'not null' OR (table = 'Txns' AND columns IN ('Amount', 'Date')) OR (table = 'TxnsInv' AND columns = 'Activity')"),
)

register(
    "check_unassigned_gaps",
    with_ledger("SELECT COUNT(*) FILTER (WHERE year(Date) NOT IN (1996, 1998, 2000)) AS unassigned, COUNT(*) AS txns FROM txns"),
)(lambda spark, sf: C.unassigned(_ledger_with({"eras": {str(y): {"date_from": str(y), "date_to": str(y)} for y in (1996, 1998, 2000)}})(spark, sf).txns))

# ---------------------------------------------------------------------------------------------
# categories on columns

_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

on_ledger(
    "pivot_cols_category",
    _pivot_sql([("COALESCE(EraName, '')", "EraName")], [(c, f"c = '{c}'") for c in _TYPES], "TxnType <> 'Transfer'").replace("SELECT COALESCE(EraName, '') AS EraName,", "SELECT COALESCE(EraName, '') AS EraName, Category AS c,"),
    lambda lg: P.pivot(lg, {"select": {"txntype": "!Transfer"}, "options": {"rows": "era", "columns": "category"}}),
)

# ---------------------------------------------------------------------------------------------
# display names

on_ledger(
    "txns_display",
    with_ledger(
        f"""SELECT ROW_NUMBER() OVER (ORDER BY {REPORT_ORDER}) AS N, Num, strftime(Date, '%Y-%m-%d') AS Date, Account, Payee, Category,
              Subcategory, XferAccount AS "Transfer Account", CAST(Amount AS DOUBLE) AS Amount, TxnType AS "Txn Type", TxnClass AS "Txn Class", Memo, Split, C,
              EraName AS "Era" FROM v"""
    ),
    lambda lg: R.display(R.txns_report(lg, {}, drop_constant=False)),
)
