"""List reports: transactions (plain / consolidated by month), accounts, categories and the
category diagnostics. Each returns a DataFrame; writing is ``sources.store.write_reports``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.dates import month_start
from ..ledger import Ledger
from ..operators.filters import ACCOUNTS_DIRECTIVES, CATEGORIES_DIRECTIVES, SpecError, apply_select, require, values_and_cond
from ..operators.numbering import number_rows

# --- fixed values: display names of report columns -------------------------------------------
DISPLAY_NAMES = {
    "N": "N",
    "Num": "Num",
    "Date": "Date",
    "DateYYYYMM": "Date",
    "Account": "Account",
    "AccountClassification": "Account Classification",
    "AccountCategory": "Account Category",
    "Payee": "Payee",
    "Category": "Category",
    "Subcategory": "Subcategory",
    "CategorySubcategory": "Category : Subcategory",
    "XferAccount": "Transfer Account",
    "Amount": "Amount",
    "TxnType": "Txn Type",
    "TxnClass": "Txn Class",
    "Memo": "Memo",
    "Split": "Split",
    "C": "C",
    "EraName": "Era",
}
# Directives whose column is redundant with a report's name when it holds a single value.
REDUNDANT_WITH_NAME = {
    "account": "Account",
    "account_category": "AccountCategory",
    "account_classification": "AccountClassification",
    "era": "EraName",
    "txnclass": "TxnClass",
    "txntype": "TxnType",
}
# ---------------------------------------------------------------------------------------------

def constant_columns(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """Columns of ``candidates`` holding one value (NULL counts as a value) or no rows at all.

    One aggregate job of min / max / NULL counts (partial aggregation, no distinct shuffle);
    only the per-column flags reach the driver.
    """
    cands = [c for c in candidates if c in df.columns]
    if not cands:
        return []
    aggs = []
    for c in cands:
        aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count_if(F.col(c).isNull()).alias(f"n_{c}")]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs).first()
    out = []
    for c in cands:
        lo, hi, nulls, rows = row[f"lo_{c}"], row[f"hi_{c}"], row[f"n_{c}"], row["_rows"]
        if rows == 0 or nulls == rows or (nulls == 0 and lo == hi):
            out.append(c)
    return out


def select_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Include / exclude by display or column name; a leading ``!`` list excludes."""
    if not columns:
        return df
    values, cond = values_and_cond(columns)
    by_display = {}
    for c in df.columns:
        by_display[c] = c
        by_display.setdefault(DISPLAY_NAMES.get(c, c), c)
    picked = []
    for v in values:
        if v not in by_display:
            raise SpecError(f"columns: '{v}': unknown column")
        picked.append(by_display[v])
    if cond == "=":
        return df.select(*[c for c in df.columns if c in picked or c == "N"])
    return df.drop(*picked)


def display(df: DataFrame) -> DataFrame:
    """Rename to display names (``DateYYYYMM`` shows as ``Date``)."""
    return df.withColumnsRenamed({c: DISPLAY_NAMES[c] for c in df.columns if c in DISPLAY_NAMES and DISPLAY_NAMES[c] != c})


# Columns that a report leaves out because its own directives already say what they would show.
HIDDEN_COLUMNS = {
    "Subcategory": lambda select: select.get("txntype") == S.TXNTYPE_TRANSFER,
    "XferAccount": lambda select: select.get("txntype", S.TXNTYPE_TRANSFER) != S.TXNTYPE_TRANSFER,
}
# Monthly consolidation: what makes a group; other columns are those of the group's first transaction.
CONSOLIDATED_BY = ("DateYYYYMM", "Payee", "Category", "Subcategory", "TxnType", "TxnClass")
CONSOLIDATED_FIRST = ("Account", "XferAccount", "EraName")
SORTED_BY = ("Category", "Subcategory", "Payee", "Account")


def layout(ledger: Ledger, view: DataFrame, spec: Mapping, by: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """(rows with everything the report shows or sorts by, sort columns, shown columns) of a transactions report.

    ``by`` are columns that keep reports apart (fan-out).
    """
    select = spec.get("select") or {}
    hidden = {c for c, hides in HIDDEN_COLUMNS.items() if hides(select)}
    match spec.get("consolidate"):
        case None:
            date_col, skipped, sequence = "Date", {"N", "DateYYYYMM"}, list(ledger.order_key)
            rows = view
        case "yyyymm":
            date_col, skipped = "DateYYYYMM", {"N", "Date", "Num", "C", "Memo", "Split"}
            # one struct, the group's least: its place and what is shown of it. What is equal in a group is no part of it.
            place = [c for c in ledger.order_key if c not in CONSOLIDATED_BY]
            first = F.min(F.struct(*place, *(c for c in CONSOLIDATED_FIRST if c not in place)))
            rows = view.withColumn("DateYYYYMM", month_start(F.col("Date"))).groupBy(*by, *CONSOLIDATED_BY)
            rows = rows.agg(F.sum("Amount").alias("Amount"), first.alias("_first"))
            rows = rows.withColumns({c if c in CONSOLIDATED_FIRST else f"_first_{c}": F.col("_first")[c] for c in dict.fromkeys([*place, *CONSOLIDATED_FIRST])})
            sequence = [c if c in CONSOLIDATED_FIRST else f"_first_{c}" for c in place]
        case other:
            raise SpecError(f"consolidate: '{other}': unrecognized option")
    shown = [c for c in S.TXNS_REPORT_COLUMNS if c in rows.columns and c not in hidden | skipped]
    order = list(dict.fromkeys([date_col, *SORTED_BY, *sequence]))
    return rows.select(*dict.fromkeys([*by, *shown, *order])), order, shown


def txns_report(ledger: Ledger, spec: Mapping | None = None, renumber: bool = True, drop_constant: bool = True) -> DataFrame:
    """Transactions report (R1), or monthly consolidation with ``consolidate: yyyymm`` (R2)."""
    spec = spec or {}
    select = spec.get("select") or {}
    rows, order, shown = layout(ledger, apply_select(ledger.view, select, ledger.ctx()), spec)
    numbered = number_rows(rows, order, "N") if renumber else rows.withColumn("N", F.lit(None).cast("long"))
    report = select_columns(numbered.select("N", *shown), spec.get("columns"))
    if drop_constant:
        single = [column for directive, column in REDUNDANT_WITH_NAME.items() if directive in select]
        report = report.drop(*constant_columns(report, single + ([] if ledger.config.get("eras") else ["EraName"])))
    return report.withColumnRenamed("DateYYYYMM", "Date")


def accounts_report(ledger: Ledger, spec: Mapping | None = None) -> DataFrame:
    """Accounts other than transfer-only ones (R7); account attribute negation keeps NULLs (F8)."""
    spec = spec or {}
    sel = spec.get("select", {}) or {}
    require(sel, ACCOUNTS_DIRECTIVES, "accounts report")
    a = ledger.accounts.filter(F.col("XferOnly").isNull() | (F.col("XferOnly") == 0))
    a = filter_accounts(a, sel)
    drop = ["XferOnly"] + [col for key, col in REDUNDANT_WITH_NAME.items() if key in sel and key in ("account", "account_category", "account_classification")]
    return a.drop(*drop)


def filter_accounts(accts: DataFrame, sel: Mapping) -> DataFrame:
    """Accounts-report filter: NOT IN on the complement, so accounts with NULL attributes stay."""
    values, cond = values_and_cond(sel.get("account"))
    if values:
        accts = accts.filter(F.col("Account").isin(values) if cond == "=" else ~F.col("Account").isin(values))
    for key, col in (("account_classification", "AccountClassification"), ("account_category", "AccountCategory")):
        values, cond = values_and_cond(sel.get(key))
        if not values:
            continue
        hit = accts.filter(F.col(col).isin(values)).select("Account")
        accts = accts.join(hit, "Account", "left_semi" if cond == "=" else "left_anti")
    return accts


def categories_report(ledger: Ledger, spec: Mapping | None = None) -> DataFrame:
    """Categories with their type and class (R8), filterable on txntype / txnclass."""
    sel = (spec or {}).get("select", {}) or {}
    require(sel, CATEGORIES_DIRECTIVES, "categories report")
    c = ledger.categories
    for key, col in (("txntype", "TxnType"), ("txnclass", "TxnClass")):
        values, cond = values_and_cond(sel.get(key))
        if values:
            c = c.filter(F.col(col).isin(values) if cond == "=" else ~F.col(col).isin(values))
    return c.select("Category", "Subcategory", "TxnType", "TxnClass", "TxnDateMin", "TxnDateMax")


def naked_categories(ledger: Ledger) -> DataFrame:
    """Categories that have subcategories but also transactions without one."""
    with_sub = ledger.categories.filter(F.col("Subcategory").isNotNull()).select("Category")
    return ledger.view.filter(F.col("Subcategory").isNull()).join(with_sub, "Category", "left_semi").select("Category").distinct()


def single_payee_categories(ledger: Ledger, spec: Mapping | None = None) -> DataFrame:
    """Category labels referenced by a single payee, with that payee."""
    sel = (spec or {}).get("select", {}) or {}
    require(sel, CATEGORIES_DIRECTIVES, "single-payee report")
    v = ledger.view.filter(F.col("Payee").isNotNull())
    for key, col in (("txntype", "TxnType"), ("txnclass", "TxnClass")):
        values, cond = values_and_cond(sel.get(key))
        if values:
            v = v.filter(F.col(col).isin(values) if cond == "=" else ~F.col(col).isin(values))
    # "fewer than two distinct payees" is min == max: a partial aggregate, no per-group payee
    # sets (a hot category never gathers its payees in one place); the single payee is the min
    g = v.groupBy("CategorySubcategory").agg(F.min("Payee").alias("Payee"), F.max("Payee").alias("_hi"))
    return g.filter(F.col("Payee") == F.col("_hi")).drop("_hi")


def unclassified_accounts(ledger: Ledger) -> DataFrame:
    """Accounts lacking a classification with their date range."""
    return ledger.accounts.filter(F.col("AccountClassification").isNull()).select("Account", "TxnDateMin", "TxnDateMax")


def distinct_values(ledger: Ledger, column: str) -> DataFrame:
    """Distinct values of a view column."""
    return ledger.view.select(column).distinct()


def distinct_years(ledger: Ledger) -> DataFrame:
    return ledger.view.select(F.year("Date").alias("yyyy")).distinct()


def import_profile(txns: DataFrame) -> DataFrame:
    """Accounts, rows and date bounds of an import."""
    return txns.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("Account").alias("accounts"),
        F.min("Date").alias("date_min"),
        F.max("Date").alias("date_max"),
    )


def txn_bounds(ledger: Ledger) -> DataFrame:
    """Global bounds and the relative-date anchor (A10): min of per-account first/last dates."""
    per = ledger.accounts.filter(F.col("TxnDateMin").isNotNull())
    return per.agg(
        F.min("TxnDateMin").alias("date_min"),
        F.min("TxnDateMax").alias("anchor"),
        F.max("TxnDateMax").alias("date_max"),
    )
