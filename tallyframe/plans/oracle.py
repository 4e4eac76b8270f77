"""DuckDB SQL twins of the registered queries (the correctness oracle).

The ledger binding is restated as CTEs over the raw test tables; each query's SQL appends its
own SELECT. Conventions at the boundary: money as DOUBLE of the exact decimal, dates as ISO text,
counts and years as BIGINT, NULLS FIRST where order defines a number.
"""

from __future__ import annotations

XFER_CATS = "('Buy Investment/CD', 'Credit Card Payment', 'Principal Transfer', 'Transfer From', 'Transfer To')"

LEDGER = f"""
raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS Num, CAST(l_shipdate AS DATE) AS Date, cn.n_name AS Account,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE s_name END AS Payee,
    CASE WHEN l_linenumber = 7 THEN 'Transfer To' ELSE p_type END AS Category,
    CASE WHEN l_linenumber = 7 THEN sn.n_name WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS RawSub,
    CAST((CASE WHEN p_type = 'PROMO' OR l_returnflag = 'R' THEN 1 ELSE -1 END)
         * CAST(l_extendedprice AS DECIMAL(15,4)) AS DECIMAL(15,4)) AS Amount,
    l_linestatus AS C,
    CASE WHEN l_discount = 0 THEN NULL ELSE p_name END AS Memo,
    l_orderkey AS SrcOrder, l_linenumber AS SrcLine
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN part ON l_partkey = p_partkey),
txns AS (
  SELECT Num, Date, Account, Payee, Category,
    CASE WHEN Category IN {XFER_CATS} THEN NULL ELSE RawSub END AS Subcategory,
    CASE WHEN Category IN {XFER_CATS} THEN RawSub END AS XferAccount,
    Amount, C, CAST(NULL AS VARCHAR) AS Split, Memo,
    CASE WHEN Date >= DATE '1999-01-01' THEN 'Era A'
         WHEN Date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' THEN 'Era B'
         WHEN Date <= DATE '1996-12-31' THEN 'Era C' END AS EraName,
    Date AS SrcDate, SrcOrder, SrcLine
  FROM raw),
cats AS (
  SELECT Category, Subcategory, TxnType,
    CASE WHEN Category = 'MEDIUM' AND Subcategory = 'Brand#1' THEN 'Essential'
         WHEN Category = 'STANDARD' THEN 'Essential'
         WHEN TxnType <> 'Expense' THEN TxnType ELSE 'Discretionary' END AS TxnClass,
    TxnDateMin, TxnDateMax
  FROM (SELECT Category, Subcategory, CASE WHEN Category = 'PROMO' THEN 'Income' ELSE 'Expense' END AS TxnType,
          MIN(Date) AS TxnDateMin, MAX(Date) AS TxnDateMax
        FROM txns WHERE Category NOT IN {XFER_CATS} GROUP BY Category, Subcategory) c0),
v AS (
  SELECT t.*,
    CASE WHEN t.XferAccount IS NOT NULL THEN 'Transfer' ELSE c.TxnType END AS TxnType,
    CASE WHEN t.XferAccount IS NOT NULL THEN 'Transfer' ELSE c.TxnClass END AS TxnClass,
    CASE WHEN t.XferAccount IS NOT NULL THEN NULL WHEN t.Subcategory IS NULL THEN t.Category
         ELSE t.Category || ' : ' || t.Subcategory END AS CategorySubcategory
  FROM txns t LEFT JOIN cats c ON t.Category = c.Category AND t.Subcategory IS NOT DISTINCT FROM c.Subcategory),
acfg AS (
  SELECT n_name AS Account, r_name AS cat,
    CASE WHEN r_name IN ('AFRICA', 'AMERICA', 'ASIA') THEN 'Assets' WHEN r_name = 'EUROPE' THEN 'Liabilities' END AS cls
  FROM nation JOIN region ON n_regionkey = r_regionkey),
accts0 AS (
  SELECT Account, MIN(Date) AS TxnDateMin, MAX(Date) AS TxnDateMax, CAST(NULL AS INTEGER) AS XferOnly
  FROM txns GROUP BY Account
  UNION ALL
  SELECT XferAccount, MIN(Date), MAX(Date), 1 FROM txns
  WHERE XferAccount IS NOT NULL AND XferAccount NOT IN (SELECT Account FROM txns) GROUP BY XferAccount),
accts AS (
  SELECT a.Account, g.cls AS AccountClassification, CASE WHEN g.cls IS NOT NULL THEN g.cat END AS AccountCategory,
    CAST(NULL AS VARCHAR) AS Abbreviation, CAST(NULL AS VARCHAR) AS BankName, CAST(NULL AS VARCHAR) AS AccountNumber,
    CAST(NULL AS DOUBLE) AS AccountLimit, CAST(NULL AS DOUBLE) AS OpeningBalance,
    a.TxnDateMin, a.TxnDateMax, a.XferOnly, CAST(NULL AS DATE) AS OpenedDate, CAST(NULL AS DATE) AS ClosedDate
  FROM accts0 a LEFT JOIN acfg g ON a.Account = g.Account)
"""

# Import order of transactions (N) and the report order that renumbers them.
N_ORDER = (
    "SrcDate NULLS FIRST, SrcOrder NULLS FIRST, SrcLine NULLS FIRST, Account NULLS FIRST, Payee NULLS FIRST, "
    "Category NULLS FIRST, Subcategory NULLS FIRST, XferAccount NULLS FIRST, Amount NULLS FIRST, Memo NULLS FIRST, C NULLS FIRST"
)
REPORT_ORDER = f"Date NULLS FIRST, Category NULLS FIRST, Subcategory NULLS FIRST, Payee NULLS FIRST, Account NULLS FIRST, {N_ORDER}"


def with_ledger(body: str, extra_ctes: str = "") -> str:
    """``WITH <ledger CTEs>[, extra] <body>``."""
    ctes = LEDGER.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"


def d(col: str, alias: str | None = None) -> str:
    """Date column as ISO text."""
    return f"strftime({col}, '%Y-%m-%d') AS {alias or col.split('.')[-1]}"


def m(expr: str, alias: str) -> str:
    """Money as DOUBLE."""
    return f"CAST({expr} AS DOUBLE) AS {alias}"
