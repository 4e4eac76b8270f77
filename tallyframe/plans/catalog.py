"""Registered queries (one per operator of the inventory) and their DuckDB oracle SQL.

Every query reads the test tables (through the ledger binding) and returns a DataFrame with
boundary types: money as DOUBLE, dates as ISO text, integers as BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ledger import Ledger
from ..operators import checks as C
from ..operators import ledger as L
from ..operators.filters import apply_select, merge_specs
from . import fanout as K
from . import pivot as P
from . import reports as R
from .oracle import N_ORDER, REPORT_ORDER, with_ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_LEDGERS: dict[tuple[str, str], Ledger] = {}


def ledger_for(spark: SparkSession, sf_dir: str) -> Ledger:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LEDGERS:
        _LEDGERS[key] = Ledger.from_testdata(spark, sf_dir)
    return _LEDGERS[key]


def to_boundary(df: DataFrame) -> DataFrame:
    """Decimal -> DOUBLE, date -> ISO text, int -> BIGINT (the oracle's conventions)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: to_boundary(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def on_ledger(name: str, sql: str | None, fn: Callable[[Ledger], DataFrame]) -> None:
    register(name, sql)(lambda spark, sf_dir: fn(ledger_for(spark, sf_dir)))


# ---------------------------------------------------------------------------------------------
# filters (F1 - F16): the filtered rows of the enriched view

ROW_COLS = ["Date", "Account", "Payee", "Category", "Subcategory", "XferAccount", "Amount", "Memo", "TxnType", "EraName"]
ROW_SQL = "strftime(Date, '%Y-%m-%d') AS Date, Account, Payee, Category, Subcategory, XferAccount, CAST(Amount AS DOUBLE) AS Amount, Memo, TxnType, EraName"
ANCHOR = "(SELECT MIN(TxnDateMax) FROM accts WHERE TxnDateMin IS NOT NULL)"


def _filter_query(name: str, spec: dict, where: str) -> None:
    on_ledger(name, with_ledger(f"SELECT {ROW_SQL} FROM v WHERE {where}"), lambda lg: apply_select(lg.view, spec, lg.ctx()).select(*ROW_COLS))


_filter_query("filter_in", {"payee": ["Supplier#000000001", "Supplier#000000002"]}, "Payee IN ('Supplier#000000001', 'Supplier#000000002')")
_filter_query("filter_not_in", {"account": ["!", "NATION_1", "NATION_2"]}, "Account NOT IN ('NATION_1', 'NATION_2')")
_filter_query("filter_like", {"memo": "%%RING%"}, "lower(Memo) LIKE '%ring%'")
_filter_query("filter_not_like", {"memo": "!%small%"}, "NOT (lower(Memo) LIKE 'small%')")
_filter_query("filter_like_any", {"payee": ["%Supplier#00000001_", "%%#0000000_5"]}, "(lower(Payee) LIKE 'supplier#00000001_' OR lower(Payee) LIKE '%#0000000_5')")
_filter_query("filter_blank", {"memo": "%"}, "Memo IS NULL")
_filter_query("filter_not_blank", {"memo": "!%"}, "Memo IS NOT NULL")
_filter_query("filter_blank_or_like", {"memo": ["%", "%", "%%bolt"]}, "(Memo IS NULL OR lower(Memo) LIKE '%bolt')")
_filter_query("filter_not_any_like", {"memo": ["!%", "%%ring%", "%%bolt%"]}, "NOT (lower(Memo) LIKE '%ring%' OR lower(Memo) LIKE '%bolt%')")
_filter_query(
    "filter_category",
    {"category": ["MEDIUM:", "SMALL:Brand#3", "PROMO"]},
    "((Category = 'MEDIUM' AND Subcategory IS NULL) OR (Category = 'SMALL' AND Subcategory = 'Brand#3') OR Category = 'PROMO')",
)
_filter_query(
    "filter_not_category",
    {"category": ["!", "MEDIUM:Brand#1", "LARGE", "ECONOMY", "SMALL", "STANDARD"]},
    "NOT ((Category = 'MEDIUM' AND Subcategory = 'Brand#1') OR Category = 'LARGE' OR Category = 'ECONOMY' OR Category = 'SMALL' OR Category = 'STANDARD')",
)
_filter_query(
    "filter_classification",
    {"account_classification": "!Assets"},
    "Account IN (SELECT Account FROM accts WHERE AccountClassification <> 'Assets')",
)
_filter_query(
    "filter_account_category",
    {"account_category": ["EUROPE", "ASIA"]},
    "Account IN (SELECT Account FROM accts WHERE AccountCategory IN ('EUROPE', 'ASIA'))",
)
_filter_query("filter_yyyy", {"yyyy": [1996, 1998], "date_from": "2000"}, "year(Date) IN (1996, 1998)")
_filter_query("filter_not_yyyy", {"yyyy": ["!1996", 1998, 1999, 2000, 2001]}, "year(Date) NOT IN (1996, 1998, 1999, 2000, 2001)")
_filter_query(
    "filter_date_range",
    {"date_from": "1997-03", "date_to": "1996"},
    "Date BETWEEN DATE '1996-12-31' AND DATE '1997-03-01'",
)
_filter_query("filter_date_from", {"date_from": "2001-10-15"}, "Date >= DATE '2001-10-15'")
_filter_query("filter_date_to", {"date_to": "1995-02"}, "Date <= DATE '1995-02-28'")
_filter_query(
    "filter_relative",
    {"date_from": "-6m", "date_to": "0m"},
    f"Date BETWEEN CAST(date_trunc('month', {ANCHOR}) - INTERVAL 6 MONTH AS DATE) AND last_day({ANCHOR})",
)
_filter_query(
    "filter_relative_days",
    {"date_from": "45d"},
    f"Date >= {ANCHOR} - INTERVAL 45 DAY",
)
_filter_query(
    "filter_relative_years",
    {"date_from": "1y", "date_to": "-1y"},
    f"Date BETWEEN make_date(year({ANCHOR}) - 1, 1, 1) AND make_date(year({ANCHOR}) - 1, 12, 31)",
)
_filter_query("filter_amount", {"amount": "<= -50,000"}, "Amount <= -50000")
_filter_query("filter_amount_ne", {"amount": ["!=", "-1,000.5"]}, "Amount <> -1000.5")
_filter_query("filter_amount_eq", {"amount": "$2,000.00"}, "Amount = 2000")
_filter_query("filter_amount_between", {"amount": ["<>", 1000, -1000]}, "Amount BETWEEN -1000 AND 1000")
_filter_query(
    "filter_merged",
    merge_specs({"account_classification": "Assets", "date_from": "1998"}, {"date_from": "2000", "txntype": "Income"}),
    "Account IN (SELECT Account FROM accts WHERE AccountClassification = 'Assets') AND Date >= DATE '2000-01-01' AND TxnType = 'Income'",
)
_filter_query("filter_era", {"era": ["Era C", "Era A"], "txnclass": "Essential"}, "EraName IN ('Era C', 'Era A') AND TxnClass = 'Essential'")

# ---------------------------------------------------------------------------------------------
# ledger build

on_ledger(
    "tag_transfers",
    with_ledger("SELECT Account, XferAccount, COUNT(*) AS n, CAST(SUM(Amount) AS DOUBLE) AS total FROM txns WHERE XferAccount IS NOT NULL GROUP BY Account, XferAccount"),
    lambda lg: lg.txns.filter(F.col("XferAccount").isNotNull()).groupBy("Account", "XferAccount").agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("total")),
)
on_ledger(
    "payees",
    with_ledger("SELECT Payee, strftime(MIN(Date), '%Y-%m-%d') AS TxnDateMin, strftime(MAX(Date), '%Y-%m-%d') AS TxnDateMax FROM txns WHERE Payee IS NOT NULL GROUP BY Payee"),
    lambda lg: lg.payees,
)
on_ledger(
    "categories",
    with_ledger("SELECT Category, Subcategory, TxnType, TxnClass, strftime(TxnDateMin, '%Y-%m-%d') AS TxnDateMin, strftime(TxnDateMax, '%Y-%m-%d') AS TxnDateMax FROM cats"),
    lambda lg: lg.categories,
)
on_ledger(
    "accounts",
    with_ledger(
        "SELECT Account, AccountClassification, AccountCategory, Abbreviation, BankName, AccountNumber, AccountLimit, OpeningBalance, "
        "strftime(TxnDateMin, '%Y-%m-%d') AS TxnDateMin, strftime(TxnDateMax, '%Y-%m-%d') AS TxnDateMax, CAST(XferOnly AS BIGINT) AS XferOnly, "
        "strftime(OpenedDate, '%Y-%m-%d') AS OpenedDate, strftime(ClosedDate, '%Y-%m-%d') AS ClosedDate FROM accts"
    ),
    lambda lg: lg.accounts,
)
on_ledger(
    "unknown_account_category",
    with_ledger("SELECT Account, cat AS category, 'no classification' AS problem FROM acfg WHERE cls IS NULL"),
    lambda lg: lg.unknown_account_categories(),
)
on_ledger(
    "enrich",
    with_ledger("SELECT TxnType, TxnClass, CategorySubcategory, COUNT(*) AS n, CAST(SUM(Amount) AS DOUBLE) AS total FROM v GROUP BY ALL"),
    lambda lg: lg.view.groupBy("TxnType", "TxnClass", "CategorySubcategory").agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("total")),
)
on_ledger(
    "intervals",
    with_ledger(
        "SELECT e.EraName, strftime(e.f, '%Y-%m-%d') AS EraDateFrom, strftime(e.t, '%Y-%m-%d') AS EraDateTo, CAST(e.era_no AS BIGINT) AS era_no, "
        "COUNT(txns.Date) AS txns FROM (VALUES ('Era C', NULL, DATE '1996-12-31', 0), ('Era B', DATE '1997-01-01', DATE '1998-12-31', 1), "
        "('Era A', DATE '1999-01-01', NULL, 2)) e(EraName, f, t, era_no) LEFT JOIN txns ON txns.EraName = e.EraName GROUP BY ALL"
    ),
    lambda lg: lg.eras.join(lg.txns.groupBy("EraName").agg(F.count(F.lit(1)).alias("txns")), "EraName", "left")
    .select("EraName", "EraDateFrom", "EraDateTo", "era_no", F.coalesce("txns", F.lit(0)).alias("txns")),
)
on_ledger(
    "assign_interval",
    with_ledger("SELECT EraName, year(Date) AS yyyy, COUNT(*) AS n FROM txns GROUP BY ALL"),
    lambda lg: lg.txns.groupBy("EraName", F.year("Date").cast("long").alias("yyyy")).agg(F.count(F.lit(1)).alias("n")),
)


def _ledger_with(cfg_update: dict) -> Callable[[SparkSession, str], Ledger]:
    def make(spark: SparkSession, sf_dir: str) -> Ledger:
        from ..sources import binding

        cfg = {**binding.LEDGER_CONFIG, **cfg_update}
        return Ledger.from_testdata(spark, sf_dir, cfg)

    return make


_REWRITE_RULES = [
    {"payee": "Preferred Supplier", "select": {"account": "NATION_1", "payee": ["Supplier#000000001", "Supplier#000000002"]}},
    {"category": "Household : Preferred", "select": {"payee": "Preferred Supplier", "amount": "< -20,000"}},
    {"memo": "big refund", "select": {"amount": "> 50000", "yyyy": 1997}},
    {"txndate": "2001-06", "select": {"payee": "%Preferred%", "date_from": "2001-07"}},
]
register(
    "rewrite_counts",
    with_ledger(
        """SELECT CAST(rule AS BIGINT) AS rule, modified FROM (VALUES
        (0, (SELECT COUNT(*) FROM txns WHERE Account = 'NATION_1' AND Payee IN ('Supplier#000000001', 'Supplier#000000002'))),
        (1, (SELECT COUNT(*) FROM txns WHERE Account = 'NATION_1' AND Payee IN ('Supplier#000000001', 'Supplier#000000002') AND Amount < -20000)),
        (2, (SELECT COUNT(*) FROM txns WHERE Amount > 50000 AND year(Date) = 1997)),
        (3, (SELECT COUNT(*) FROM txns WHERE Account = 'NATION_1' AND Payee IN ('Supplier#000000001', 'Supplier#000000002') AND Date >= DATE '2001-07-01'))
        ) t(rule, modified)"""
    ),
)(lambda spark, sf: _ledger_with({"rewrites": _REWRITE_RULES})(spark, sf).rewrite_counts().select(F.col("rule").cast("long"), F.col("modified").cast("long")))

register(
    "rewrite_chain",
    with_ledger(
        """SELECT CASE WHEN r1 THEN 'Preferred Supplier' ELSE Payee END AS Payee,
             CASE WHEN r2 THEN 'Household' ELSE Category END AS Category,
             CASE WHEN r2 THEN 'Preferred' ELSE Subcategory END AS Subcategory,
             CASE WHEN r3 THEN 'big refund' ELSE Memo END AS Memo,
             strftime(CASE WHEN r4 THEN DATE '2001-06-30' ELSE Date END, '%Y-%m-%d') AS Date,
             COUNT(*) AS n, CAST(SUM(Amount) AS DOUBLE) AS total
           FROM (SELECT *, (Account = 'NATION_1' AND Payee IN ('Supplier#000000001', 'Supplier#000000002')) AS r1,
                   (Account = 'NATION_1' AND Payee IN ('Supplier#000000001', 'Supplier#000000002') AND Amount < -20000) AS r2,
                   (Amount > 50000 AND year(Date) = 1997) AS r3,
                   (Account = 'NATION_1' AND Payee IN ('Supplier#000000001', 'Supplier#000000002') AND Date >= DATE '2001-07-01') AS r4
                 FROM txns) x
           WHERE r1 OR r3
           GROUP BY ALL"""
    ),
)(
    lambda spark, sf: (
        lambda lg: lg.txns.filter((F.col("Payee") == "Preferred Supplier") | (F.col("Memo") == "big refund"))
        .groupBy("Payee", "Category", "Subcategory", "Memo", "Date")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("total"))
    )(_ledger_with({"rewrites": _REWRITE_RULES})(spark, sf))
)

# ---------------------------------------------------------------------------------------------
# reports (R1 - R11)

on_ledger(
    "txns",
    with_ledger(
        f"""SELECT ROW_NUMBER() OVER (ORDER BY {REPORT_ORDER}) AS N, Num, strftime(Date, '%Y-%m-%d') AS Date, Payee, Category,
              Subcategory, XferAccount, CAST(Amount AS DOUBLE) AS Amount, TxnType, TxnClass, Memo, Split, C, EraName
            FROM v WHERE Account = 'NATION_1' AND Date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'"""
    ),
    lambda lg: R.txns_report(lg, {"select": {"account": "NATION_1", "date_from": "1998-01", "date_to": "1998-06"}}),
)
on_ledger(
    "txns_all",
    with_ledger(
        f"""SELECT ROW_NUMBER() OVER (ORDER BY {REPORT_ORDER}) AS N, Num, strftime(Date, '%Y-%m-%d') AS Date, Account, Payee, Category,
              Subcategory, XferAccount, CAST(Amount AS DOUBLE) AS Amount, TxnType, TxnClass, Memo, Split, C, EraName FROM v"""
    ),
    lambda lg: R.txns_report(lg, {}),
)
on_ledger(
    "txns_transfers",
    with_ledger(
        f"""SELECT ROW_NUMBER() OVER (ORDER BY {REPORT_ORDER}) AS N, Num, strftime(Date, '%Y-%m-%d') AS Date, Account, Payee, Category,
              XferAccount, CAST(Amount AS DOUBLE) AS Amount, TxnClass, Memo, Split, C, EraName
            FROM v WHERE TxnType = 'Transfer' AND year(Date) = 2000"""
    ),
    lambda lg: R.txns_report(lg, {"select": {"txntype": "Transfer", "yyyy": 2000}}),
)
on_ledger(
    "txns_consolidated",
    with_ledger(
        f"""SELECT ROW_NUMBER() OVER (ORDER BY M NULLS FIRST, Category NULLS FIRST, Subcategory NULLS FIRST, Payee NULLS FIRST, Account NULLS FIRST, fn) AS N,
              strftime(M, '%Y-%m-%d') AS Date, Account, Payee, Category, Subcategory, CAST(Amount AS DOUBLE) AS Amount, TxnType, TxnClass, EraName
            FROM (SELECT CAST(date_trunc('month', Date) AS DATE) AS M, Payee, Category, Subcategory, TxnType, TxnClass, SUM(Amount) AS Amount,
                    arg_min_null(Account, n) AS Account, arg_min_null(EraName, n) AS EraName, MIN(n) AS fn
                  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {N_ORDER}) AS n FROM v
                        WHERE Account IN (SELECT Account FROM accts WHERE AccountClassification = 'Liabilities') AND TxnType = 'Income') x
                  GROUP BY M, Payee, Category, Subcategory, TxnType, TxnClass) g"""
    ),
    lambda lg: R.txns_report(lg, {"consolidate": "yyyymm", "select": {"account_classification": "Liabilities", "txntype": "Income"}}, drop_constant=False),
)
on_ledger(
    "txns_columns",
    with_ledger(
        f"""SELECT ROW_NUMBER() OVER (ORDER BY {REPORT_ORDER}) AS N, strftime(Date, '%Y-%m-%d') AS Date, Account, CAST(Amount AS DOUBLE) AS Amount, EraName
            FROM v WHERE TxnClass = 'Essential' AND Amount < -90000"""
    ),
    lambda lg: R.txns_report(lg, {"select": {"txnclass": "Essential", "amount": "< -90000"}, "columns": ["Date", "Account", "Amount", "Era"]}),
)
on_ledger(
    "drop_constant_columns",
    with_ledger(
        f"""SELECT ROW_NUMBER() OVER (ORDER BY {REPORT_ORDER}) AS N, Num, strftime(Date, '%Y-%m-%d') AS Date, Account, Payee, Category,
              Subcategory, CAST(Amount AS DOUBLE) AS Amount, TxnClass, Memo, Split, C
            FROM v WHERE TxnType = 'Income' AND EraName = 'Era B' AND Account IN ('NATION_2', 'NATION_3')"""
    ),
    lambda lg: R.txns_report(lg, {"select": {"txntype": "Income", "era": "Era B", "account": ["NATION_2", "NATION_3"]}}),
)
# the same over the whole table; only a selection makes a column constant, so the last one keeps one directive
on_ledger(
    "txns_consolidated_all",
    with_ledger(
        f"""SELECT ROW_NUMBER() OVER (ORDER BY M NULLS FIRST, Category NULLS FIRST, Subcategory NULLS FIRST, Payee NULLS FIRST, Account NULLS FIRST, fn) AS N,
              strftime(M, '%Y-%m-%d') AS Date, Account, XferAccount, Payee, Category, Subcategory, CAST(Amount AS DOUBLE) AS Amount, TxnType, TxnClass, EraName
            FROM (SELECT CAST(date_trunc('month', Date) AS DATE) AS M, Payee, Category, Subcategory, TxnType, TxnClass, SUM(Amount) AS Amount,
                    arg_min_null(Account, n) AS Account, arg_min_null(XferAccount, n) AS XferAccount, arg_min_null(EraName, n) AS EraName, MIN(n) AS fn
                  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {N_ORDER}) AS n FROM v) x
                  GROUP BY M, Payee, Category, Subcategory, TxnType, TxnClass) g"""
    ),
    lambda lg: R.txns_report(lg, {"consolidate": "yyyymm"}, drop_constant=False),
)
on_ledger(
    "txns_columns_all",
    with_ledger(f"SELECT ROW_NUMBER() OVER (ORDER BY {REPORT_ORDER}) AS N, strftime(Date, '%Y-%m-%d') AS Date, Account, CAST(Amount AS DOUBLE) AS Amount, EraName FROM v"),
    lambda lg: R.txns_report(lg, {"columns": ["Date", "Account", "Amount", "Era"]}),
)
on_ledger(
    "drop_constant_columns_all",
    with_ledger(
        f"""SELECT ROW_NUMBER() OVER (ORDER BY {REPORT_ORDER}) AS N, Num, strftime(Date, '%Y-%m-%d') AS Date, Account, Payee, Category,
              Subcategory, CAST(Amount AS DOUBLE) AS Amount, TxnClass, Memo, Split, C, EraName
            FROM v WHERE TxnType = 'Income'"""
    ),
    lambda lg: R.txns_report(lg, {"select": {"txntype": "Income"}}),
)
on_ledger(
    "accounts_report",
    with_ledger(
        "SELECT Account, AccountCategory, Abbreviation, BankName, AccountNumber, AccountLimit, OpeningBalance, strftime(TxnDateMin, '%Y-%m-%d') AS TxnDateMin, "
        "strftime(TxnDateMax, '%Y-%m-%d') AS TxnDateMax, strftime(OpenedDate, '%Y-%m-%d') AS OpenedDate, strftime(ClosedDate, '%Y-%m-%d') AS ClosedDate "
        "FROM accts WHERE XferOnly IS NULL AND Account NOT IN (SELECT Account FROM accts WHERE AccountClassification IN ('Assets'))"
    ),
    lambda lg: R.accounts_report(lg, {"select": {"account_classification": "!Assets"}}),
)
on_ledger(
    "accounts_not_class",
    with_ledger(
        "SELECT Account, AccountClassification, strftime(TxnDateMin, '%Y-%m-%d') AS TxnDateMin "
        "FROM accts WHERE XferOnly IS NULL AND Account NOT IN (SELECT Account FROM accts WHERE AccountCategory IN ('EUROPE', 'AFRICA'))"
    ),
    lambda lg: R.accounts_report(lg, {"select": {"account_category": ["!", "EUROPE", "AFRICA"]}}).select("Account", "AccountClassification", "TxnDateMin"),
)
on_ledger(
    "categories_report",
    with_ledger("SELECT Category, Subcategory, TxnType, TxnClass, strftime(TxnDateMin, '%Y-%m-%d') AS TxnDateMin, strftime(TxnDateMax, '%Y-%m-%d') AS TxnDateMax FROM cats WHERE TxnClass <> 'Discretionary'"),
    lambda lg: R.categories_report(lg, {"select": {"txnclass": "!Discretionary"}}),
)
on_ledger(
    "naked_categories",
    with_ledger("SELECT DISTINCT Category FROM v WHERE Subcategory IS NULL AND Category IN (SELECT Category FROM cats WHERE Subcategory IS NOT NULL)"),
    R.naked_categories,
)
on_ledger(
    "unclassified_accounts",
    with_ledger("SELECT Account, strftime(TxnDateMin, '%Y-%m-%d') AS TxnDateMin, strftime(TxnDateMax, '%Y-%m-%d') AS TxnDateMax FROM accts WHERE AccountClassification IS NULL"),
    R.unclassified_accounts,
)
on_ledger("distinct_years", with_ledger("SELECT DISTINCT year(Date) AS yyyy FROM v"), lambda lg: R.distinct_years(lg).select(F.col("yyyy").cast("long")))
on_ledger("distinct_values", with_ledger("SELECT DISTINCT TxnClass FROM v"), lambda lg: R.distinct_values(lg, "TxnClass"))
on_ledger(
    "import_profile",
    with_ledger("SELECT COUNT(*) AS rows, COUNT(DISTINCT Account) AS accounts, strftime(MIN(Date), '%Y-%m-%d') AS date_min, strftime(MAX(Date), '%Y-%m-%d') AS date_max FROM txns"),
    lambda lg: R.import_profile(lg.txns),
)
on_ledger(
    "txn_bounds",
    with_ledger(
        "SELECT strftime(MIN(TxnDateMin), '%Y-%m-%d') AS date_min, strftime(MIN(TxnDateMax), '%Y-%m-%d') AS anchor, strftime(MAX(TxnDateMax), '%Y-%m-%d') AS date_max "
        "FROM accts WHERE TxnDateMin IS NOT NULL"
    ),
    R.txn_bounds,
)
on_ledger(
    "row_counts",
    with_ledger(
        "SELECT 'Txns' AS tbl, COUNT(*) AS n FROM txns UNION ALL SELECT 'Accounts', COUNT(*) FROM accts UNION ALL "
        "SELECT 'Payees', COUNT(DISTINCT Payee) FROM txns UNION ALL SELECT 'Categories', COUNT(*) FROM cats UNION ALL SELECT 'Eras', 3"
    ),
    lambda lg: lg.txns.select(F.lit("Txns").alias("tbl"))
    .unionByName(lg.accounts.select(F.lit("Accounts").alias("tbl")))
    .unionByName(lg.payees.select(F.lit("Payees").alias("tbl")))
    .unionByName(lg.categories.select(F.lit("Categories").alias("tbl")))
    .unionByName(lg.eras.select(F.lit("Eras").alias("tbl")))
    .groupBy("tbl")
    .agg(F.count(F.lit(1)).alias("n")),
)

# ---------------------------------------------------------------------------------------------
# pivots (P1 - P14)

YEARS = list(range(1995, 2002))


def _year_cols(expr_amount: str = "Amount", cond: str = "TRUE") -> str:
    return ", ".join(f"CAST(SUM(CASE WHEN y = {y} AND {cond} THEN {expr_amount} END) AS DOUBLE) AS \"{y}-12-31\"" for y in YEARS)


def _pivot_sql(row_exprs: list[tuple[str, str]], col_cases: list[tuple[str, str]], where: str, join: str = "") -> str:
    """Rows = GROUPING SETS ((rows), ()) with the Total row labels; one SUM(CASE) per column label."""
    inner = ", ".join(f"{e} AS {a}" for e, a in row_exprs)
    labels = [
        f"CASE WHEN GROUPING({row_exprs[0][1]}) = 1 THEN {'\'Total\'' if i == 0 else '\'\''} ELSE {a} END AS {a}" for i, (_, a) in enumerate(row_exprs)
    ]
    cols = [f"CAST(SUM(CASE WHEN {c} THEN Amount END) AS DOUBLE) AS \"{lbl}\"" for lbl, c in col_cases]
    cols.append("CAST(SUM(Amount) AS DOUBLE) AS \"Total\"")
    groups = ", ".join(a for _, a in row_exprs)
    return with_ledger(
        f"""SELECT {', '.join(labels)}, {', '.join(cols)}
            FROM (SELECT {inner}, year(Date) AS y, EraName AS e, TxnType AS tt, TxnClass AS tc, Amount FROM v {join} WHERE {where}) f
            GROUP BY GROUPING SETS (({groups}), ())"""
    )


YEAR_CASES = [(f"{y}-12-31", f"y = {y}") for y in YEARS]

on_ledger(
    "pivot_default",
    _pivot_sql([("COALESCE(Category, '')", "Category"), ("COALESCE(Subcategory, '')", "Subcategory")], YEAR_CASES, "TxnType = 'Expense'"),
    lambda lg: P.pivot(lg, {"select": {"txntype": "Expense"}}),
)
on_ledger(
    "pivot_rows_era",
    _pivot_sql([("COALESCE(EraName, '')", "EraName")], YEAR_CASES, "TRUE"),
    lambda lg: P.pivot(lg, {"options": {"rows": "era"}}),
)
on_ledger(
    "pivot_era_cols",
    _pivot_sql([("COALESCE(Category, '')", "Category")], [("Era C", "e = 'Era C'"), ("Era B", "e = 'Era B'"), ("Era A", "e = 'Era A'")], "TxnType <> 'Transfer'"),
    lambda lg: P.pivot(lg, {"select": {"txntype": "!Transfer"}, "options": {"rows": ["category"], "columns": ["era"]}}),
)
on_ledger(
    "pivot_account_attrs",
    _pivot_sql(
        [("COALESCE(a.AccountClassification, '')", "AccountClassification"), ("COALESCE(a.AccountCategory, '')", "AccountCategory")],
        [("Expense", "tt = 'Expense'"), ("Income", "tt = 'Income'"), ("Transfer", "tt = 'Transfer'")],
        "TRUE",
        join="JOIN accts a USING (Account)",
    ),
    lambda lg: P.pivot(lg, {"options": {"rows": ["account_category", "account_classification"], "columns": "txntype"}}),
)
on_ledger(
    "pivot_cols_multi",
    _pivot_sql(
        [("COALESCE(EraName, '')", "EraName")],
        [("Expense|Discretionary", "tt = 'Expense' AND tc = 'Discretionary'"), ("Expense|Essential", "tt = 'Expense' AND tc = 'Essential'"), ("Income|Income", "tt = 'Income' AND tc = 'Income'")],
        "TxnType <> 'Transfer' AND Account = 'NATION_11'",
    ),
    lambda lg: P.pivot(lg, {"select": {"txntype": "!Transfer", "account": "NATION_11"}, "options": {"rows": "era", "columns": ["txnclass", "txntype", "txnclass"]}}),
)
on_ledger(
    "pivot_cols_multi_all",
    _pivot_sql(
        [("COALESCE(EraName, '')", "EraName")],
        [
            ("Expense|Discretionary", "tt = 'Expense' AND tc = 'Discretionary'"),
            ("Expense|Essential", "tt = 'Expense' AND tc = 'Essential'"),
            ("Income|Income", "tt = 'Income' AND tc = 'Income'"),
            ("Transfer|Transfer", "tt = 'Transfer' AND tc = 'Transfer'"),
        ],
        "TRUE",
    ),
    lambda lg: P.pivot(lg, {"options": {"rows": "era", "columns": ["txnclass", "txntype", "txnclass"]}}),
)
on_ledger(
    "pivot_rows_subcategory",
    _pivot_sql([("COALESCE(Category, '')", "Category"), ("COALESCE(Subcategory, '')", "Subcategory")], [("Essential", "tc = 'Essential'"), ("Income", "tc = 'Income'")], "TxnClass IN ('Essential', 'Income')"),
    lambda lg: P.pivot(lg, {"select": {"txnclass": ["Essential", "Income"]}, "options": {"rows": ["subcategory"], "columns": "txnclass"}}),
)
on_ledger(
    "pivot_category_subcategory",
    _pivot_sql([("COALESCE(CategorySubcategory, '')", "CategorySubcategory"), ("COALESCE(Payee, '')", "Payee")], YEAR_CASES, "TRUE"),
    lambda lg: P.pivot(lg, {"options": {"rows": ["category", "payee", "category_subcategory", "subcategory"]}}),
)


def _total_sql(row_exprs: list[tuple[str, str]], where: str) -> str:
    inner = ", ".join(f"{e} AS {a}" for e, a in row_exprs)
    labels = [f"CASE WHEN GROUPING({row_exprs[0][1]}) = 1 THEN {'\'Total\'' if i == 0 else '\'\''} ELSE {a} END AS {a}" for i, (_, a) in enumerate(row_exprs)]
    groups = ", ".join(a for _, a in row_exprs)
    return with_ledger(
        f"""SELECT {', '.join(labels)}, CAST(SUM(Amount) AS DOUBLE) AS "Total"
            FROM (SELECT {inner}, Amount FROM v WHERE {where}) f GROUP BY GROUPING SETS (({groups}), ())"""
    )


on_ledger(
    "pivot_total",
    _total_sql([("strftime(make_date(year(Date), 12, 31), '%Y-%m-%d')", "DateYYYY"), ("strftime(CAST(date_trunc('month', Date) AS DATE), '%Y-%m-%d')", "DateYYYYMM")], "TxnType = 'Income'"),
    lambda lg: P.pivot(lg, {"select": {"txntype": "Income"}, "options": {"rows": ["yyyymm", "yyyy"], "columns": "total"}}),
)
on_ledger(
    "pivot_total_substituted",
    _total_sql([("COALESCE(Category, '')", "Category"), ("strftime(make_date(year(Date), 12, 31), '%Y-%m-%d')", "DateYYYY")], "TxnClass = 'Essential'"),
    lambda lg: P.pivot(lg, {"select": {"txnclass": "Essential"}, "options": {"rows": ["yyyy", "category"], "columns": ["total"]}}),
)

# ---------------------------------------------------------------------------------------------
# fan-out (K1 - K10)

_FE_COLS = "Num, strftime(Date, '%Y-%m-%d') AS Date, Account, Payee, Category, Subcategory, XferAccount, CAST(Amount AS DOUBLE) AS Amount, TxnType, TxnClass, Memo, Split, C, EraName"


def _foreach_sql(key_expr: str, where: str, cols: str = _FE_COLS, join: str = "") -> str:
    return with_ledger(
        f"""SELECT k AS foreach, ROW_NUMBER() OVER (PARTITION BY k ORDER BY {REPORT_ORDER}) AS N, {cols}
            FROM (SELECT v.*, {key_expr} AS k FROM v {join}) x WHERE k IS NOT NULL AND {where}"""
    )


on_ledger("foreach_txntype", _foreach_sql("TxnType", "TRUE"), lambda lg: K.foreach_txns(lg, {}, "txntype"))
on_ledger("foreach_txnclass", _foreach_sql("TxnClass", "TxnClass IN ('Essential', 'Income')"), lambda lg: K.foreach_txns(lg, {"select": {"txnclass": ["Essential", "Income"]}}, "txnclass"))
on_ledger("foreach_era", _foreach_sql("EraName", "EraName <> 'Era B'"), lambda lg: K.foreach_txns(lg, {"select": {"era": "!Era B"}}, "era"))
on_ledger("foreach_account", _foreach_sql("Account", "TRUE"), lambda lg: K.foreach_txns(lg, {}, "account"))
on_ledger(
    "foreach_account_category",
    _foreach_sql("COALESCE(a.AccountCategory, 'No category')", "TRUE", join="JOIN accts a USING (Account)"),
    lambda lg: K.foreach_txns(lg, {}, "account_category"),
)
on_ledger(
    "foreach_account_classification",
    _foreach_sql("COALESCE(a.AccountClassification, 'No classification')", "TRUE", join="JOIN accts a USING (Account)"),
    lambda lg: K.foreach_txns(lg, {}, "account_classification"),
)
on_ledger(
    "foreach_yyyy",
    _foreach_sql("CAST(year(Date) AS VARCHAR)", "year(Date) >= 1999"),
    lambda lg: K.foreach_txns(lg, {"select": {"date_from": "1999-05"}}, "yyyy"),
)
on_ledger(
    "foreach_10y",
    _foreach_sql("CAST(year(Date) // 10 * 10 AS VARCHAR) || '-' || CAST(year(Date) // 10 * 10 + 9 AS VARCHAR)", "TRUE"),
    lambda lg: K.foreach_txns(lg, {}, "10y"),
)
on_ledger(
    "foreach_accounts_class",
    with_ledger(
        "SELECT COALESCE(AccountClassification, 'No classification') AS foreach, Account, AccountClassification, AccountCategory, Abbreviation, BankName, AccountNumber, "
        "AccountLimit, OpeningBalance, strftime(TxnDateMin, '%Y-%m-%d') AS TxnDateMin, strftime(TxnDateMax, '%Y-%m-%d') AS TxnDateMax, "
        "strftime(OpenedDate, '%Y-%m-%d') AS OpenedDate, strftime(ClosedDate, '%Y-%m-%d') AS ClosedDate FROM accts WHERE XferOnly IS NULL"
    ),
    lambda lg: K.foreach_accounts(lg, {}, "account_classification"),
)


def _foreach_pivot_sql() -> str:
    return with_ledger(
        """SELECT foreach,
             CASE WHEN GROUPING(Category) = 1 THEN 'Total' ELSE Category END AS Category,
             CAST(SUM(CASE WHEN tt = 'Expense' THEN Amount END) AS DOUBLE) AS "Expense",
             CAST(SUM(CASE WHEN tt = 'Income' THEN Amount END) AS DOUBLE) AS "Income",
             CAST(SUM(Amount) AS DOUBLE) AS "Total"
           FROM (SELECT CAST(year(Date) AS VARCHAR) AS foreach, COALESCE(Category, '') AS Category, TxnType AS tt, Amount
                 FROM v WHERE TxnType <> 'Transfer') f
           GROUP BY GROUPING SETS ((foreach, Category), (foreach))"""
    )


on_ledger(
    "foreach_pivot_yyyy",
    _foreach_pivot_sql(),
    lambda lg: K.foreach_pivot(lg, {"select": {"txntype": "!Transfer"}, "options": {"rows": "category", "columns": "txntype"}}, "yyyy"),
)

on_ledger(
    "foreach_account_selected",
    _foreach_sql("Account", "Account NOT IN ('NATION_1', 'NATION_2')"),
    lambda lg: K.foreach_txns(lg, {"select": {"account": ["!", "NATION_1", "NATION_2"]}}, "account"),
)
on_ledger(
    "foreach_class_selected",
    _foreach_sql("a.AccountClassification", "k = 'Assets'", join="JOIN accts a USING (Account)"),
    lambda lg: K.foreach_txns(lg, {"select": {"account_classification": "Assets"}}, "account_classification"),
)
on_ledger(
    "foreach_accounts_category",
    ORACLE["foreach_accounts_class"].replace("COALESCE(AccountClassification, 'No classification') AS foreach", "COALESCE(AccountCategory, 'No category') AS foreach"),
    lambda lg: K.foreach_accounts(lg, {}, "account_category"),
)
on_ledger(
    "foreach_not_class",
    ORACLE["foreach_accounts_class"].replace("WHERE XferOnly IS NULL", "WHERE XferOnly IS NULL AND COALESCE(AccountClassification, '') <> 'Assets'"),
    lambda lg: K.foreach_accounts(lg, {"select": {"account_classification": "!Assets"}}, "account_classification"),
)


def _foreach_consolidated(lg: Ledger) -> DataFrame:
    """One row per report and group: totals of the monthly consolidation by transaction type."""
    return K.foreach_txns(lg, {"consolidate": "yyyymm"}, "txntype").select("foreach", "Date", "Payee", "Category", "Subcategory", "Amount", "TxnClass")


on_ledger(
    "foreach_consolidated",
    with_ledger(
        """SELECT TxnType AS foreach, strftime(CAST(date_trunc('month', Date) AS DATE), '%Y-%m-%d') AS Date, Payee, Category, Subcategory,
             CAST(SUM(Amount) AS DOUBLE) AS Amount, TxnClass FROM v WHERE TxnType IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 7"""
    ),
    _foreach_consolidated,
)

_PIVOT_KEYS = {
    "txntype": ("TxnType", "v"),
    "txnclass": ("TxnClass", "v"),
    "era": ("EraName", "v"),
    "account": ("Account", "v"),
    "account_category": ("COALESCE(a.AccountCategory, 'No category')", "v JOIN accts a USING (Account)"),
    "account_classification": ("COALESCE(a.AccountClassification, 'No classification')", "v JOIN accts a USING (Account)"),
    "10y": ("CAST(year(Date) // 10 * 10 AS VARCHAR) || '-' || CAST(year(Date) // 10 * 10 + 9 AS VARCHAR)", "v"),
}


def _foreach_pivot_by(key: str, expression: str, source: str) -> None:
    years = ", ".join(f"CAST(SUM(CASE WHEN y = {y} THEN Amount END) AS DOUBLE) AS \"{y}-12-31\"" for y in YEARS)
    on_ledger(
        f"foreach_pivot_{key}",
        with_ledger(
            f"""SELECT foreach, CASE WHEN GROUPING(Category) = 1 THEN 'Total' ELSE Category END AS Category, {years},
                  CAST(SUM(Amount) AS DOUBLE) AS "Total"
                FROM (SELECT {expression} AS foreach, COALESCE(Category, '') AS Category, year(Date) AS y, Amount FROM {source}) f
                WHERE foreach IS NOT NULL GROUP BY GROUPING SETS ((foreach, Category), (foreach))"""
        ),
        lambda lg: K.foreach_pivot(lg, {"options": {"rows": "category"}}, key),
    )


for _key, (_expression, _source) in _PIVOT_KEYS.items():
    _foreach_pivot_by(_key, _expression, _source)

on_ledger(
    "pivot_long",
    with_ledger(
        """SELECT CASE WHEN GROUPING(c) = 0 THEN c END AS Category, CASE WHEN GROUPING(s) = 0 THEN s END AS Subcategory,
             CASE WHEN GROUPING(y) = 0 THEN y END AS DateYYYY, CAST(SUM(Amount) AS DOUBLE) AS Amount,
             GROUPING(c) = 1 AS RowTotal, GROUPING(y) = 1 AS ColumnTotal
           FROM (SELECT COALESCE(Category, '') AS c, COALESCE(Subcategory, '') AS s, strftime(make_date(year(Date), 12, 31), '%Y-%m-%d') AS y, Amount FROM v) f
           GROUP BY GROUPING SETS ((c, s, y), (c, s), (y), ())"""
    ),
    lambda lg: P.pivot_long(lg),
)
for _option, _column in (("account", "Account"), ("txntype", "TxnType"), ("txnclass", "TxnClass"), ("payee", "Payee")):
    on_ledger(
        f"pivot_rows_{_option}",
        _pivot_sql([(f"COALESCE({_column}, '')", _column)], YEAR_CASES, "TRUE"),
        lambda lg, option=_option: P.pivot(lg, {"options": {"rows": option}}),
    )

# ---------------------------------------------------------------------------------------------
# checks (C4 - C8)


def _tables(lg: Ledger) -> dict[str, DataFrame]:
    return {"Txns": lg.txns, "Accounts": lg.accounts, "Payees": lg.payees, "Categories": lg.categories, "Eras": lg.eras}


on_ledger(
    "check_orphans",
    with_ledger(
        """SELECT 'Txns' AS "table", 'Account' AS columns, 'Accounts' AS parent, COUNT(*) AS violations FROM txns WHERE Account IS NOT NULL AND Account NOT IN (SELECT Account FROM accts)
           UNION ALL SELECT 'Txns', 'XferAccount', 'Accounts', COUNT(*) FROM txns WHERE XferAccount IS NOT NULL AND XferAccount NOT IN (SELECT Account FROM accts)
           UNION ALL SELECT 'Txns', 'Payee', 'Payees', 0
           UNION ALL SELECT 'Txns', 'Category,Subcategory', 'Categories', COUNT(*) FROM txns t WHERE Subcategory IS NOT NULL
                AND NOT EXISTS (SELECT 1 FROM cats c WHERE c.Category = t.Category AND c.Subcategory = t.Subcategory)
           UNION ALL SELECT 'Txns', 'EraName', 'Eras', COUNT(*) FROM txns WHERE EraName IS NOT NULL AND EraName NOT IN ('Era A', 'Era B', 'Era C')"""
    ),
    lambda lg: C.orphans(_tables(lg)),
)
on_ledger(
    "check_duplicates",
    with_ledger(
        """SELECT 'Txns' AS "table", 'N' AS columns, 0 AS duplicates
           UNION ALL SELECT 'Accounts', 'Account', COUNT(*) FROM (SELECT Account FROM accts GROUP BY Account HAVING COUNT(*) > 1) d
           UNION ALL SELECT 'Payees', 'Payee', 0"""
    ),
    lambda lg: C.duplicates({**_tables(lg), "Txns": lg.txns_numbered()}),
)
on_ledger(
    "check_not_null",
    with_ledger(
        """SELECT 'Txns' AS "table", 'Date' AS "column", COUNT(*) FILTER (WHERE Date IS NULL) AS nulls FROM txns
           UNION ALL SELECT 'Txns', 'Account', COUNT(*) FILTER (WHERE Account IS NULL) FROM txns
           UNION ALL SELECT 'Txns', 'Category', COUNT(*) FILTER (WHERE Category IS NULL) FROM txns
           UNION ALL SELECT 'Txns', 'Amount', COUNT(*) FILTER (WHERE Amount IS NULL) FROM txns
           UNION ALL SELECT 'Accounts', 'Account', COUNT(*) FILTER (WHERE Account IS NULL) FROM accts
           UNION ALL SELECT 'Payees', 'Payee', 0
           UNION ALL SELECT 'Categories', 'Category', COUNT(*) FILTER (WHERE Category IS NULL) FROM cats
           UNION ALL SELECT 'Eras', 'EraName', 0"""
    ),
    lambda lg: C.not_null(_tables(lg)),
)
on_ledger(
    "check_fanout",
    with_ledger("SELECT (SELECT COUNT(*) FROM txns) AS txns, (SELECT COUNT(*) FROM v) AS view, (SELECT COUNT(*) FROM txns) = (SELECT COUNT(*) FROM v) AS ok"),
    lambda lg: C.fanout(lg.txns, lg.view),
)
on_ledger(
    "check_unassigned",
    with_ledger("SELECT COUNT(*) FILTER (WHERE EraName IS NULL) AS unassigned, COUNT(*) AS txns FROM txns"),
    lambda lg: C.unassigned(lg.txns),
)
on_ledger(
    "renumber",
    with_ledger(f"SELECT ROW_NUMBER() OVER (ORDER BY {N_ORDER}) AS N, Num, strftime(Date, '%Y-%m-%d') AS Date, Account, CAST(Amount AS DOUBLE) AS Amount FROM txns"),
    lambda lg: lg.txns_numbered().select("N", "Num", "Date", "Account", "Amount"),
)

# ---------------------------------------------------------------------------------------------
# export ingestion

from datetime import date as _date  # noqa: E402

from ..operators import normalize as N  # noqa: E402
from ..sources import export_binding as EB  # noqa: E402
from ..sources import exports as X  # noqa: E402
from . import ingest as I  # noqa: E402
from ..session import DENSE, cut_lineage  # noqa: E402

_ORDERS_SQL = """
o AS (SELECT o_orderkey, o_orderkey // 1000 AS fk,
        CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN '**VOID**' ELSE CAST(o_orderkey AS VARCHAR) END AS Num,
        CAST(o_orderdate AS DATE) AS Date, c_name AS Payee, n_name AS Account, o_orderpriority AS Memo,
        CAST(-CAST(o_totalprice AS DECIMAL(15,4)) AS DECIMAL(15,4)) AS Amount, o_orderstatus AS C,
        (SELECT COUNT(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS parts
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
flat AS (
  SELECT 'txns_' || CAST(o.fk AS VARCHAR) AS file, o.Num, o.Date, o.Payee, o.Account, p_type AS Category,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS Subcategory,
    CAST((CASE WHEN p_type = 'PROMO' OR l_returnflag = 'R' THEN 1 ELSE -1 END) * CAST(l_extendedprice AS DECIMAL(15,4)) AS DECIMAL(15,4)) AS Amount,
    l_linestatus AS C, COALESCE(CASE WHEN l_linenumber = 1 THEN l_returnflag END, o.Memo) AS Memo, 'Y' AS Split
  FROM lineitem JOIN o ON l_orderkey = o.o_orderkey JOIN part ON l_partkey = p_partkey
  UNION ALL
  SELECT 'txns_' || CAST(fk AS VARCHAR), Num, Date, Payee, Account, 'ORDER', NULL, Amount, C, Memo, NULL FROM o WHERE parts = 0)
"""
_FLAT_COLS = ["Num", "Date", "Payee", "Account", "Category", "Subcategory", "Amount", "C", "Memo", "Split"]
_FLAT_SQL = "Num, strftime(Date, '%Y-%m-%d') AS Date, Payee, Account, Category, Subcategory, CAST(Amount AS DOUBLE) AS Amount, C, Memo, Split"


def _sql(body: str, ctes: str = _ORDERS_SQL) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


_RENDERED: dict[tuple[str, str, str], DataFrame] = {}


def _totals_view(spark: SparkSession, sf: str) -> DataFrame:
    """The enriched view of the transactions' totals by category."""
    from ..sources import binding

    return Ledger(spark, binding.category_totals(spark, sf), binding.LEDGER_CONFIG).view


def _rendered(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """The rendered export files of one kind, materialized once per session (like files on disk)."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _RENDERED:
        make = {
            "txns": lambda: EB.txn_export_lines(spark, sf),
            "balances": lambda: EB.balance_export_lines(spark, sf),
            "spending": lambda: EB.spending_export_lines(_totals_view(spark, sf)),
            "loans": lambda: EB.loan_export_lines(spark, sf),
            "details": lambda: EB.details_export_lines(spark, sf),
            "investments": lambda: EB.investment_export_lines(spark, sf),
            "monthly": lambda: EB.spending_export_lines(_totals_view(spark, sf), monthly=True),
        }[kind]
        _RENDERED[key] = cut_lineage(make(), "rendered", DENSE)
    return _RENDERED[key]


def _txn_import(spark: SparkSession, sf: str) -> I.TxnImport:
    return I.parse_txn_exports(_rendered(spark, sf, "txns"))


def _all_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf, "txns").unionByName(_rendered(spark, sf, "balances")).unionByName(_rendered(spark, sf, "spending"))


register(
    "classify_exports",
    _sql("SELECT DISTINCT 'txns_' || CAST(o_orderkey // 1000 AS VARCHAR) AS file, 'account_txns' AS kind FROM orders "
         "UNION ALL SELECT 'balances', 'account_balances' UNION ALL SELECT 'spending', 'income_spending'", "x AS (SELECT 1)"),
)(lambda spark, sf: X.classify_exports(_all_lines(spark, sf)))

register(
    "read_export",
    _sql(
        """SELECT 'txns_' || CAST(f.k AS VARCHAR) AS file, f.n + COALESCE(g.n, 0) + 1 AS rows, f.n AS dated
           FROM (SELECT o_orderkey // 1000 AS k, COUNT(*) AS n FROM orders GROUP BY 1) f
           LEFT JOIN (SELECT l_orderkey // 1000 AS k, COUNT(*) AS n FROM lineitem GROUP BY 1) g USING (k)""",
        "x AS (SELECT 1)",
    ),
)(lambda spark, sf: X.read_export(_rendered(spark, sf, "txns"), X.KINDS["account_txns"]).groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count("Date").alias("dated")))

register(
    "footer_total",
    _sql("SELECT file, CAST(SUM(Amount) AS DOUBLE) AS Total FROM flat WHERE Num <> '**VOID**' GROUP BY file"),
)(lambda spark, sf: _txn_import(spark, sf).footer)

register(
    "flatten_splits",
    _sql(f"SELECT {_FLAT_SQL} FROM flat"),
)(
    lambda spark, sf: N.flatten_splits(
        N.parse_dates(N.with_split_category(N.normalize_amounts(X.split_footer(X.read_export(_rendered(spark, sf, "txns"), X.KINDS["account_txns"]), "Grand Total", "Num")[0], ["Amount"])[0]))[0]
    ).select(*_FLAT_COLS)
)

register("drop_voids", _sql(f"SELECT {_FLAT_SQL} FROM flat WHERE Num <> '**VOID**'"))(lambda spark, sf: _txn_import(spark, sf).rows.select(*_FLAT_COLS))

register(
    "check_txn_total",
    _sql("SELECT file, CAST(SUM(Amount) AS DOUBLE) AS rows_total, CAST(SUM(Amount) AS DOUBLE) AS footer_total, TRUE AS ok FROM flat WHERE Num <> '**VOID**' GROUP BY file"),
)(lambda spark, sf: _txn_import(spark, sf).check_total())

register(
    "import_window",
    _sql("SELECT Account, COUNT(*) AS n, CAST(SUM(Amount) AS DOUBLE) AS total FROM flat WHERE Num <> '**VOID**' AND Date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY Account"),
)(lambda spark, sf: _txn_import(spark, sf).windowed(_date(1997, 1, 1), _date(1997, 12, 31)).groupBy("Account").agg(F.count(F.lit(1)).alias("n"), F.sum("Amount").alias("total")))

register(
    "union_txns",
    _sql(
        """SELECT ROW_NUMBER() OVER (ORDER BY Date, seq, file, line_key, Amount, Category, Subcategory NULLS FIRST, C, Memo NULLS FIRST) AS N,
             strftime(Date, '%Y-%m-%d') AS Date, Num, CAST(Amount AS DOUBLE) AS Amount, CAST(seq AS BIGINT) AS file_seq
           FROM (SELECT *, 0 AS seq, 0 AS line_key FROM flat WHERE Num <> '**VOID**'
                 UNION ALL SELECT *, 1, 0 FROM flat WHERE Num <> '**VOID**' AND year(Date) = 1999) u"""
    ),
)(
    lambda spark, sf: (
        lambda rows: N.union_txns(
            [rows.withColumn("_lk", F.lit(0)), rows.filter(F.year("Date") == 1999).withColumn("_lk", F.lit(0))],
            order=["Date", "file_seq", "file", "_lk", "Amount", "Category", "Subcategory", "C", "Memo"],
        ).select("N", "Date", "Num", "Amount", F.col("file_seq").cast("long").alias("file_seq"))
    )(_txn_import(spark, sf).rows)
)


def _supplier_amount_text(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier balances written the ways exports write money, plus one unparseable style."""
    s = read_supplier(spark, sf)
    bal = F.col("s_acctbal").cast("decimal(15,2)")
    text = (
        F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("- "), F.format_number(F.abs(bal), 2)))
        .when(bal < 0, F.concat(F.lit("("), F.format_number(-bal, 2), F.lit(")")))
        .when(F.col("s_suppkey") % 3 == 0, F.concat(F.format_number(bal, 2), F.lit("%")))
        .when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit(" $"), F.format_number(bal, 2), F.lit(" ")))
        .otherwise(F.format_number(bal, 2))
    )
    return s.select("s_suppkey", text.alias("raw"))


def read_supplier(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.binding import read_table

    return read_table(spark, sf, "supplier")


_AMOUNT_SQL = """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(CAST(s_acctbal AS DECIMAL(15,2)) AS DOUBLE) END AS Amount FROM supplier
"""
register("normalize_amounts", _sql(_AMOUNT_SQL, "x AS (SELECT 1)"))(
    lambda spark, sf: N.normalize_amounts(_supplier_amount_text(spark, sf).withColumnRenamed("raw", "Amount"), ["Amount"])[0]
)
register(
    "amount_rejects",
    _sql("SELECT 'Amount' AS column, '- ' || format('{:,.2f}', abs(CAST(s_acctbal AS DECIMAL(15,2)))) AS value FROM supplier WHERE s_suppkey % 7 = 0", "x AS (SELECT 1)"),
)(lambda spark, sf: N.normalize_amounts(_supplier_amount_text(spark, sf).withColumnRenamed("raw", "Amount"), ["Amount"])[1].select("column", "value"))


def _category_text(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.binding import read_table

    p = read_table(spark, sf, "part")
    text = (
        F.when(F.col("p_size") % 5 == 0, F.col("p_type"))
        .when(F.col("p_size") % 5 == 1, F.concat(F.col("p_type"), F.lit(" :")))
        .when(F.col("p_size") % 5 == 2, F.concat(F.lit(" "), F.col("p_type"), F.lit("  :  "), F.col("p_brand"), F.lit(" ")))
        .otherwise(F.concat(F.col("p_type"), F.lit(":"), F.col("p_brand"), F.lit(" : x")))
    )
    return p.select("p_partkey", text.alias("Category"))


register(
    "split_category",
    _sql(
        """SELECT p_partkey,
             CASE WHEN p_size % 5 = 2 THEN ' ' || p_type ELSE p_type END AS Category,
             CASE WHEN p_size % 5 IN (0, 1) THEN NULL WHEN p_size % 5 = 2 THEN p_brand || ' ' ELSE p_brand || ' : x' END AS Subcategory
           FROM part""",
        "x AS (SELECT 1)",
    ),
)(lambda spark, sf: N.with_split_category(_category_text(spark, sf)))

_BAL_SQL = """
b AS (SELECT n_name AS Account, CAST(COALESCE(SUM(CAST(s_acctbal AS DECIMAL(15,4))), 0) AS DECIMAL(15,4)) AS Total,
        CASE WHEN r_regionkey <= 2 THEN 'Assets' ELSE 'Liabilities' END AS Type, r_name AS Subtype
      FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey
      GROUP BY n_name, r_regionkey, r_name)
"""
register(
    "label_sections_2level",
    _sql("SELECT Account, CAST(Total AS DOUBLE) AS Total, Type, Subtype FROM b", _BAL_SQL),
)(lambda spark, sf: I.parse_balances(_rendered(spark, sf, "balances"))[0].select("Account", "Total", "Type", "Subtype"))
register(
    "check_net_worth",
    _sql(
        """SELECT 'balances' AS file, CAST(SUM(Total) AS DOUBLE) AS total,
             CAST(SUM(CASE WHEN Type = 'Assets' THEN Total END) AS DOUBLE) AS assets,
             CAST(SUM(CASE WHEN Type = 'Liabilities' THEN Total END) AS DOUBLE) AS liabilities,
             CAST(SUM(CASE WHEN Type = 'Assets' THEN Total ELSE -Total END) AS DOUBLE) AS net_worth, TRUE AS sum_ok, TRUE AS net_worth_ok FROM b""",
        _BAL_SQL,
    ),
)(lambda spark, sf: (lambda r: I.check_net_worth(r[0], r[1]))(I.parse_balances(_rendered(spark, sf, "balances"))))

_SPEND_SQL = """
s AS (SELECT COALESCE(CategorySubcategory, Category || ' (transfers)') AS Category, TxnType,
        SUM(CASE WHEN TxnType = 'Expense' THEN -Amount ELSE Amount END) AS Total
      FROM v GROUP BY 1, 2)
"""
register(
    "label_sections_1level",
    with_ledger("SELECT Category, CAST(Total AS DOUBLE) AS Total, TxnType FROM s", _SPEND_SQL),
)(lambda spark, sf: I.parse_spending(_rendered(spark, sf, "spending"))[0].select("Category", "Total", "TxnType"))
register(
    "check_spending_total",
    with_ledger(
        """SELECT 'spending' AS file, CAST(SUM(CASE WHEN TxnType = 'Income' THEN Total END) AS DOUBLE) AS income,
             CAST(SUM(CASE WHEN TxnType = 'Expense' THEN Total END) AS DOUBLE) AS expenses,
             CAST(SUM(CASE WHEN TxnType = 'Transfer' THEN Total END) AS DOUBLE) AS transfers,
             CAST(SUM(CASE WHEN TxnType = 'Expense' THEN -Total ELSE Total END) AS DOUBLE) AS grand_total, TRUE AS ok FROM s""",
        _SPEND_SQL,
    ),
)(lambda spark, sf: (lambda r: I.check_spending_total(r[0], r[1]))(I.parse_spending(_rendered(spark, sf, "spending"))))

register(
    "export_asof",
    _sql(
        "SELECT DISTINCT 'txns_' || CAST(o_orderkey // 1000 AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS as_of FROM orders "
        "UNION ALL SELECT 'balances', '2001-12-31' UNION ALL SELECT 'spending', NULL",
        "x AS (SELECT 1)",
    ),
)(lambda spark, sf: X.as_of_date(_all_lines(spark, sf)))
register(
    "prune_exports",
    _sql("SELECT 'balances' AS file, (SELECT COUNT(*) FROM nation) + 2 * (SELECT COUNT(*) FROM region) + 9 AS lines", "x AS (SELECT 1)"),
)(
    lambda spark, sf: (
        lambda lines: X.prune_exports(lines, X.as_of_date(lines), _date(2001, 1, 1), _date(2001, 12, 31)).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    )(_rendered(spark, sf, "txns").unionByName(_rendered(spark, sf, "balances")))
)

# ---------------------------------------------------------------------------------------------
# as-of reports, balance facts, overlays, upserts, loans, investments

from ..sources import binding as B  # noqa: E402

_ORDER_AMOUNTS = """
oa AS (SELECT n_name AS Account, n_regionkey, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(15,4)) AS p, o_orderstatus
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
a_long AS (
  SELECT Account, DATE '1995-01-01' AS dt, SUM(CASE WHEN d <= DATE '1995-01-01' THEN p END) AS Balance FROM oa GROUP BY Account
  UNION ALL SELECT Account, DATE '1997-12-31', SUM(CASE WHEN d <= DATE '1997-12-31' THEN p END) FROM oa GROUP BY Account
  UNION ALL SELECT Account, DATE '1998-12-31', SUM(CASE WHEN d <= DATE '1998-12-31' THEN p END) FROM oa GROUP BY Account),
fin AS (SELECT oa.*, r_name FROM oa JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F'),
b_long AS (
  SELECT Account, DATE '1998-12-31' AS dt, SUM(CASE WHEN d <= DATE '1998-12-31' THEN p END) AS Balance FROM fin GROUP BY Account
  UNION ALL SELECT Account, DATE '1999-12-31', SUM(CASE WHEN d <= DATE '1999-12-31' THEN p END) FROM fin GROUP BY Account
  UNION ALL SELECT r_name, DATE '1998-12-31', SUM(CASE WHEN d <= DATE '1998-12-31' THEN p END) FROM fin GROUP BY r_name
  UNION ALL SELECT r_name, DATE '1999-12-31', SUM(CASE WHEN d <= DATE '1999-12-31' THEN p END) FROM fin GROUP BY r_name),
merged AS (
  SELECT Account, dt, Balance FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY Account, dt ORDER BY seq DESC) AS rn FROM (
      SELECT *, 0 AS seq FROM a_long WHERE Balance IS NOT NULL UNION ALL SELECT *, 1 FROM b_long WHERE Balance IS NOT NULL) u) r
  WHERE rn = 1)
"""


def _asof(spark: SparkSession, sf: str):
    return EB.asof_snapshots(spark, sf)


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _asof(spark, sf)
    return N.merge_asof([a, b], "Account")


register(
    "unpivot_asof",
    with_ledger("SELECT Account, strftime(dt, '%Y-%m-%d') AS Date, CAST(Balance AS DOUBLE) AS Balance FROM a_long WHERE Balance IS NOT NULL", _ORDER_AMOUNTS),
)(lambda spark, sf: N.unpivot_asof(_asof(spark, sf)[0], ["Account"]))
register(
    "merge_asof",
    with_ledger("SELECT Account, strftime(dt, '%Y-%m-%d') AS Date, CAST(Balance AS DOUBLE) AS Balance FROM merged", _ORDER_AMOUNTS),
)(_merged)
register(
    "prune_asof_columns",
    with_ledger("SELECT Account, CAST(SUM(CASE WHEN d <= DATE '1997-12-31' THEN p END) AS DOUBLE) AS \"12/31/1997\" FROM oa GROUP BY Account", _ORDER_AMOUNTS),
)(lambda spark, sf: N.prune_asof_columns(_asof(spark, sf)[0], _date(1996, 1, 1), _date(1998, 6, 30)))
register(
    "account_balances",
    with_ledger(
        "SELECT m.Account, strftime(m.dt, '%Y-%m-%d') AS Date, CAST(m.Balance AS DOUBLE) AS Balance FROM merged m LEFT JOIN accts a ON a.Account = m.Account "
        "WHERE a.TxnDateMin IS NULL OR m.dt >= a.TxnDateMin",
        _ORDER_AMOUNTS,
    ),
)(lambda spark, sf: L.account_balances(_merged(spark, sf), ledger_for(spark, sf).accounts)[0])
register(
    "balance_without_txns",
    with_ledger(
        "SELECT m.Account, strftime(m.dt, '%Y-%m-%d') AS Date, CAST(m.Balance AS DOUBLE) AS Balance FROM merged m LEFT JOIN accts a ON a.Account = m.Account "
        "WHERE a.TxnDateMin IS NULL",
        _ORDER_AMOUNTS,
    ),
)(lambda spark, sf: L.account_balances(_merged(spark, sf), ledger_for(spark, sf).accounts)[1])


def _category_balances(spark: SparkSession, sf: str) -> DataFrame:
    r1, r2 = EB.category_snapshots(ledger_for(spark, sf).view)
    ids = ["Category", "Subcategory", "TxnType"]
    long = N.unpivot_asof(r1, ids).withColumn("report_seq", F.lit(0)).unionByName(N.unpivot_asof(r2, ids).withColumn("report_seq", F.lit(1)))
    return L.category_balances(long)


register(
    "category_balances",
    with_ledger(
        "SELECT Category, Subcategory, strftime(make_date(year(Date), 12, 31), '%Y-%m-%d') AS Date, CAST(SUM(Amount) AS DOUBLE) AS Balance "
        "FROM v WHERE TxnType <> 'Transfer' GROUP BY Category, Subcategory, year(Date)"
    ),
)(_category_balances)

_ACCT_REGION = "(SELECT n_name, r_regionkey, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"
register(
    "accounts_typed",
    with_ledger(
        f"""SELECT a.Account, COALESCE(CASE WHEN g.r_regionkey <= 2 THEN 'Assets' WHEN g.r_regionkey IS NOT NULL THEN 'Liabilities' END, a.AccountClassification) AS AccountClassification,
              CASE WHEN g.n_name IS NOT NULL THEN g.r_name ELSE a.AccountCategory END AS AccountCategory
            FROM accts a LEFT JOIN {_ACCT_REGION} g ON g.n_name = a.Account"""
    ),
)(lambda spark, sf: L.account_types_overlay(ledger_for(spark, sf).accounts, I.parse_balances(_rendered(spark, sf, "balances"))[0]).select("Account", "AccountClassification", "AccountCategory"))


def _details(spark: SparkSession, sf: str) -> DataFrame:
    cust = B.read_table(spark, sf, "customer").select("c_nationkey", F.col("c_acctbal").cast("decimal(15,4)").alias("bal"))
    nation = B.read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    g = cust.groupBy("c_nationkey").agg(F.min("bal").alias("OpeningBalance"), F.max("bal").alias("AccountLimit"))
    return nation.join(g, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("Account"),
        F.substring("n_name", 1, 3).alias("Abbreviation"),
        F.concat(F.lit("Bank "), F.col("n_regionkey").cast("string")).alias("BankName"),
        F.col("n_nationkey").cast("string").alias("AccountNumber"),
        "AccountLimit",
        "OpeningBalance",
    )


register(
    "accounts_details",
    with_ledger(
        """SELECT a.Account, substr(n.n_name, 1, 3) AS Abbreviation, 'Bank ' || CAST(n.n_regionkey AS VARCHAR) AS BankName, CAST(n.n_nationkey AS VARCHAR) AS AccountNumber,
              CAST(c.mx AS DOUBLE) AS AccountLimit, CAST(c.mn AS DOUBLE) AS OpeningBalance
           FROM accts a LEFT JOIN nation n ON n.n_name = a.Account
           LEFT JOIN (SELECT c_nationkey, MIN(CAST(c_acctbal AS DECIMAL(15,4))) AS mn, MAX(CAST(c_acctbal AS DECIMAL(15,4))) AS mx FROM customer GROUP BY 1) c ON c.c_nationkey = n.n_nationkey"""
    ),
)(lambda spark, sf: L.account_details_overlay(ledger_for(spark, sf).accounts, _details(spark, sf)).select("Account", "Abbreviation", "BankName", "AccountNumber", "AccountLimit", "OpeningBalance"))


def _dates_cfg(spark: SparkSession, sf: str) -> DataFrame:
    o = EB._order_amounts(spark, sf)
    g = o.groupBy("Account", "n_regionkey").agg(F.min("d").alias("first"))
    return g.select(
        "Account",
        F.date_format("first", "yyyy-MM-dd").alias("opened_date"),
        F.when(F.col("n_regionkey") == 4, F.lit("not a date")).alias("closed_date"),
    )


register(
    "accounts_overlay",
    with_ledger(
        """SELECT a.Account, strftime(o.first, '%Y-%m-%d') AS OpenedDate, CAST(NULL AS VARCHAR) AS ClosedDate
           FROM accts a LEFT JOIN (SELECT n_name, MIN(CAST(o_orderdate AS DATE)) AS first FROM orders JOIN customer ON o_custkey = c_custkey
                                   JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) o ON o.n_name = a.Account"""
    ),
)(lambda spark, sf: L.account_dates_overlay(ledger_for(spark, sf).accounts, _dates_cfg(spark, sf)).select("Account", "OpenedDate", "ClosedDate"))


def _categories_typed(spark: SparkSession, sf: str) -> DataFrame:
    lg = ledger_for(spark, sf)
    items = I.parse_spending(_rendered(spark, sf, "spending"))[0]
    return L.category_types_overlay(lg.categories_raw, [items]).select("Category", "Subcategory", "TxnType")


register(
    "categories_typed",
    with_ledger(
        """SELECT c.Category, c.Subcategory, t.TxnType FROM cats c
           LEFT JOIN (SELECT DISTINCT Category, TxnType FROM v WHERE Subcategory IS NULL AND XferAccount IS NULL) t ON t.Category = c.Category"""
    ),
)(_categories_typed)
register(
    "categories_overlay",
    with_ledger(
        """SELECT Category, Subcategory, CASE WHEN Category = 'PROMO' THEN 'Income' END AS TxnType,
             CASE WHEN Category = 'MEDIUM' AND Subcategory = 'Brand#1' THEN 'Essential' WHEN Category = 'STANDARD' THEN 'Essential' END AS TxnClass FROM cats"""
    ),
)(lambda spark, sf: (lambda lg: L.category_config_overlay(lg.categories_raw, lg.config.get("category_types"), lg.config.get("category_classes")).select("Category", "Subcategory", "TxnType", "TxnClass"))(ledger_for(spark, sf)))
on_ledger(
    "categories_defaulted",
    with_ledger("SELECT Category, Subcategory, TxnType, TxnClass FROM cats"),
    lambda lg: lg.categories.select("Category", "Subcategory", "TxnType", "TxnClass"),
)


def _payee_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = B.read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    li = B.read_table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    s = B.read_table(spark, sf, "supplier").select("s_suppkey", "s_name")
    c = B.read_table(spark, sf, "customer").select("c_custkey", "c_name")
    by_supp = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey).groupBy(F.col("s_name").alias("Payee")).agg(
        F.min("d").alias("TxnDateMin"), F.max("d").alias("TxnDateMax")
    )
    by_cust = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_name").alias("Payee")).agg(F.min("d").alias("TxnDateMin"))
    return by_supp.unionByName(by_cust, allowMissingColumns=True)


_UPSERT_SQL = """
p0 AS (SELECT Payee, MIN(Date) AS TxnDateMin, MAX(Date) AS TxnDateMax FROM txns WHERE Payee IS NOT NULL GROUP BY Payee),
r AS (SELECT s_name AS Payee, MIN(CAST(o_orderdate AS DATE)) AS TxnDateMin, MAX(CAST(o_orderdate AS DATE)) AS TxnDateMax
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name
      UNION ALL SELECT c_name, MIN(CAST(o_orderdate AS DATE)), NULL FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name)
"""
register(
    "upsert_update",
    with_ledger(
        """SELECT COALESCE(r.Payee, p0.Payee) AS Payee,
             strftime(CASE WHEN r.Payee IS NOT NULL THEN r.TxnDateMin ELSE p0.TxnDateMin END, '%Y-%m-%d') AS TxnDateMin,
             strftime(CASE WHEN r.Payee IS NOT NULL THEN r.TxnDateMax ELSE p0.TxnDateMax END, '%Y-%m-%d') AS TxnDateMax
           FROM p0 FULL JOIN r ON p0.Payee = r.Payee""",
        _UPSERT_SQL,
    ),
)(lambda spark, sf: L.upsert(ledger_for(spark, sf).payees, _payee_rows(spark, sf), ["Payee"]))
register(
    "upsert_ignore",
    with_ledger(
        """SELECT COALESCE(p0.Payee, r.Payee) AS Payee,
             strftime(CASE WHEN p0.Payee IS NOT NULL THEN p0.TxnDateMin ELSE r.TxnDateMin END, '%Y-%m-%d') AS TxnDateMin,
             strftime(CASE WHEN p0.Payee IS NOT NULL THEN p0.TxnDateMax ELSE r.TxnDateMax END, '%Y-%m-%d') AS TxnDateMax
           FROM p0 FULL JOIN r ON p0.Payee = r.Payee""",
        _UPSERT_SQL,
    ),
)(lambda spark, sf: L.upsert(ledger_for(spark, sf).payees, _payee_rows(spark, sf), ["Payee"], do_nothing=True))

_INV_SQL = """
inv AS (SELECT ROW_NUMBER() OVER (ORDER BY CAST(ts AS DATE), event_id) AS N, CAST(ts AS DATE) AS Date, 'USER_' || CAST(user_id AS VARCHAR) AS Account,
          event_type AS Investment, CASE WHEN value > 250 THEN 'Sell' ELSE 'Buy' END AS Activity, CAST(NULL AS VARCHAR) AS C,
          CAST(1 AS DOUBLE) AS Quantity, CAST(CAST(value AS DECIMAL(15,2)) AS DOUBLE) AS Price, CAST(0 AS DOUBLE) AS Commission, CAST(CAST(value AS DECIMAL(15,2)) AS DOUBLE) AS Total,
          CASE WHEN event_type = 'purchase' THEN 'NATION_0' END AS XferAccount, 'Investment' AS Category, event_type AS Subcategory, CAST(NULL AS VARCHAR) AS Memo
        FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-20')
"""


def _txns_inv(spark: SparkSession, sf: str) -> DataFrame:
    return I.investment_txns(EB.investment_rows(spark, sf), _date(2024, 1, 1), _date(2024, 1, 20))


register(
    "txns_inv",
    with_ledger("SELECT N, strftime(Date, '%Y-%m-%d') AS Date, Account, Investment, Activity, C, Quantity, Price, Commission, Total, XferAccount, Category, Subcategory, Memo FROM inv", _INV_SQL),
)(_txns_inv)

_INV_ALL_SQL = """
inv AS (SELECT ROW_NUMBER() OVER (ORDER BY CAST(ts AS DATE), event_id) AS N, CAST(ts AS DATE) AS Date, 'USER_' || CAST(user_id AS VARCHAR) AS Account,
          event_type AS Investment, CASE WHEN value > 250 THEN 'Sell' ELSE 'Buy' END AS Activity, CAST(NULL AS VARCHAR) AS C,
          CAST(1 AS DOUBLE) AS Quantity, CAST(CAST(value AS DECIMAL(15,2)) AS DOUBLE) AS Price, CAST(0 AS DOUBLE) AS Commission, CAST(CAST(value AS DECIMAL(15,2)) AS DOUBLE) AS Total,
          CASE WHEN event_type = 'purchase' THEN 'NATION_0' END AS XferAccount, 'Investment' AS Category, event_type AS Subcategory, CAST(NULL AS VARCHAR) AS Memo
        FROM events)
"""
register(
    "txns_inv_all",
    with_ledger("SELECT N, strftime(Date, '%Y-%m-%d') AS Date, Account, Investment, Activity, C, Quantity, Price, Commission, Total, XferAccount, Category, Subcategory, Memo FROM inv", _INV_ALL_SQL),
)(lambda spark, sf: I.investment_txns(EB.investment_rows(spark, sf)))

_LOAN_SQL = """
seg AS (SELECT c_mktsegment AS Loan, SUM(ABS(CAST(c_acctbal AS DECIMAL(15,4)))) AS amt, COUNT(*) AS n FROM customer GROUP BY 1)
"""


def _loans(spark: SparkSession, sf: str):
    return I.parse_loans(_rendered(spark, sf, "loans"))


register(
    "loans",
    with_ledger(
        """SELECT Loan, substr(Loan, 1, 3) AS Abbreviation, CAST(n AS VARCHAR) AS AccountNumber, CAST(amt AS DOUBLE) AS LoanAmount, CAST(5.25 AS DOUBLE) AS InterestRate,
             CAST(n AS VARCHAR) || ' months' AS Length, 'Monthly' AS Frequency, CAST(amt AS DOUBLE) AS PrincipalInterest, CAST(NULL AS DOUBLE) AS BalloonAmount,
             CAST(n * 100 AS DOUBLE) AS Payment, CAST(10 AS DOUBLE) AS Fees, 'Fixed' AS Type, 'Compound' AS InterestWhen FROM seg""",
        _LOAN_SQL,
    ),
)(lambda spark, sf: _loans(spark, sf)[0])
register(
    "loan_payee_categories",
    with_ledger(
        """SELECT Loan, 'Bank of ' || Loan AS Payee, 'Loan' AS Category, 'Interest' AS Subcategory FROM seg
           UNION ALL SELECT DISTINCT c_mktsegment, n_name, 'Loan', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
        _LOAN_SQL,
    ),
)(lambda spark, sf: _loans(spark, sf)[1])
register(
    "accounts_all_sources",
    with_ledger(
        """SELECT Account, AccountClassification, AccountCategory, strftime(TxnDateMin, '%Y-%m-%d') AS TxnDateMin, strftime(TxnDateMax, '%Y-%m-%d') AS TxnDateMax, CAST(XferOnly AS BIGINT) AS XferOnly FROM (
             SELECT Account, 'Assets' AS AccountClassification, 'Investment Accounts' AS AccountCategory, MIN(Date) AS TxnDateMin, MAX(Date) AS TxnDateMax, NULL AS XferOnly FROM inv GROUP BY Account
             UNION ALL SELECT Loan, 'Liabilities', 'Loans', NULL, NULL, NULL FROM seg
             UNION ALL SELECT Account, NULL, NULL, TxnDateMin, TxnDateMax, XferOnly FROM accts0) u""",
        _INV_SQL + "," + _LOAN_SQL,
    ),
)(lambda spark, sf: L.accounts(ledger_for(spark, sf).txns, txns_inv=_txns_inv(spark, sf), loans=_loans(spark, sf)[0]).select("Account", "AccountClassification", "AccountCategory", "TxnDateMin", "TxnDateMax", "XferOnly"))


def _order_ledger(spark: SparkSession, sf: str) -> Ledger:
    return Ledger(spark, B.order_txns(spark, sf), B.LEDGER_CONFIG)


register(
    "single_payee",
    _sql(
        """SELECT n_name || ' ' || c_mktsegment || ' : ' || CAST(floor(c_acctbal / 1000) AS BIGINT) AS CategorySubcategory, MIN(c_name) AS Payee
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           GROUP BY 1 HAVING COUNT(DISTINCT c_name) < 2""",
        "x AS (SELECT 1)",
    ),
)(lambda spark, sf: R.single_payee_categories(_order_ledger(spark, sf), {"select": {"txntype": "Expense"}}))
register(
    "export_problems",
    _sql("SELECT 'balances' AS file, 'header row not found' AS problem UNION ALL SELECT 'spending', 'header row not found'", "x AS (SELECT 1)"),
)(lambda spark, sf: X.export_problems(_all_lines(spark, sf), X.KINDS["account_txns"]))

register(
    "rewrite_payee",
    with_ledger("SELECT CAST(0 AS BIGINT) AS rule, COUNT(*) AS modified FROM txns WHERE Account = 'NATION_1' AND Payee = 'Supplier#000000001'"),
)(
    lambda spark, sf: _ledger_with({"rewrites": [{"payee": "Preferred Supplier", "select": {"account": "NATION_1", "payee": "Supplier#000000001"}}]})(spark, sf)
    .rewrite_counts()
    .select(F.col("rule").cast("long"), F.col("modified").cast("long"))
)
on_ledger(
    "accounts_classified",
    with_ledger("SELECT Account, AccountClassification, AccountCategory FROM accts"),
    lambda lg: lg.accounts.select("Account", "AccountClassification", "AccountCategory"),
)
on_ledger(
    "categories_filtered",
    with_ledger("SELECT Category, Subcategory, TxnType, TxnClass, strftime(TxnDateMin, '%Y-%m-%d') AS TxnDateMin, strftime(TxnDateMax, '%Y-%m-%d') AS TxnDateMax FROM cats WHERE TxnType = 'Income'"),
    lambda lg: R.categories_report(lg, {"select": {"txntype": "Income"}}),
)
on_ledger(
    "pivot_rows_yyyymm",
    _pivot_sql(
        [("strftime(CAST(date_trunc('month', Date) AS DATE), '%Y-%m-%d')", "DateYYYYMM")],
        [("Expense", "tt = 'Expense'"), ("Income", "tt = 'Income'"), ("Transfer", "tt = 'Transfer'")],
        "TRUE",
    ),
    lambda lg: P.pivot(lg, {"options": {"rows": "yyyymm", "columns": "txntype"}}),
)
on_ledger(
    "interval_overlaps",
    with_ledger(
        """SELECT first, second FROM (
             SELECT Account AS first, LEAD(Account) OVER w AS second, TxnDateMax AS e, LEAD(TxnDateMin) OVER w AS ns
             FROM accts WINDOW w AS (ORDER BY TxnDateMin, TxnDateMax, Account)) x WHERE ns < e"""
    ),
    lambda lg: L.interval_overlaps(lg.accounts, "Account", "TxnDateMin", "TxnDateMax"),
)

_ERA_YEARS = [("Era C", 1995), ("Era C", 1996), ("Era B", 1997), ("Era B", 1998), ("Era A", 1999), ("Era A", 2000), ("Era A", 2001)]
on_ledger(
    "pivot_cols_era_yyyy",
    _pivot_sql([("COALESCE(Category, '')", "Category")], [(f"{e}|{y}-12-31", f"e = '{e}' AND y = {y}") for e, y in _ERA_YEARS], "TxnType <> 'Transfer'"),
    lambda lg: P.pivot(lg, {"select": {"txntype": "!Transfer"}, "options": {"rows": "category", "columns": ["yyyy", "era"]}}),
)
_CLASS_CATS = [("", ""), ("Assets", "AFRICA"), ("Assets", "AMERICA"), ("Assets", "ASIA"), ("Liabilities", "EUROPE")]
on_ledger(
    "pivot_cols_account_attrs",
    _pivot_sql(
        [("COALESCE(Category, '')", "Category")],
        [(f"{c}|{k}", f"COALESCE(AccountClassification, '') = '{c}' AND COALESCE(AccountCategory, '') = '{k}'") for c, k in _CLASS_CATS],
        "TRUE",
        join="JOIN accts a USING (Account)",
    ).replace("TxnClass AS tc, Amount FROM v JOIN accts", "TxnClass AS tc, Amount, a.AccountClassification, a.AccountCategory FROM v JOIN accts"),
    lambda lg: P.pivot(lg, {"options": {"rows": "category", "columns": ["account_category", "account_classification"]}}),
)

register(
    "label_sections_monthly",
    with_ledger("SELECT Category, CAST(Total AS DOUBLE) AS Total, TxnType FROM s", _SPEND_SQL),
)(lambda spark, sf: I.parse_spending(_rendered(spark, sf, "monthly"), monthly=True)[0].select("Category", "Total", "TxnType"))
register(
    "check_monthly_total",
    with_ledger(
        """SELECT 'monthly' AS file, CAST(SUM(CASE WHEN TxnType = 'Income' THEN Total END) AS DOUBLE) AS income,
             CAST(SUM(CASE WHEN TxnType = 'Expense' THEN Total END) AS DOUBLE) AS expenses,
             CAST(SUM(CASE WHEN TxnType = 'Transfer' THEN Total END) AS DOUBLE) AS transfers,
             CAST(SUM(CASE WHEN TxnType = 'Expense' THEN -Total ELSE Total END) AS DOUBLE) AS grand_total, TRUE AS ok FROM s""",
        _SPEND_SQL,
    ),
)(lambda spark, sf: (lambda r: I.check_spending_total(r[0], r[1]))(I.parse_spending(_rendered(spark, sf, "monthly"), monthly=True)))

from . import catalog_imports  # noqa: E402, F401  (registers its queries)
