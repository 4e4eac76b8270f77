"""Pivot report: sum of Amount by row dimensions x column dimensions, with Total margins.

Plan: filter the enriched transactions -> one partial-aggregated ``GROUPING SETS`` aggregate
((rows, cols), (rows), (cols), ()). ``pivot_long`` is that aggregate: labels, amount and two flags that tell margins
from data, with any number of labels. ``pivot`` is the wide view of it: the column labels become column names,
so they (and only they) are collected. Margins come from the base rows, not from summing pivoted cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.dates import month_start, year_end
from ..ledger import Ledger
from ..operators.filters import SpecError, apply_select
from ..session import cut_lineage


@dataclass(frozen=True)
class Dim:
    """A pivot dimension: option name, view column, and what it does to others on its side.

    ``implies`` are added when it is asked for; ``absorbs`` are left out, since it shows them.
    """

    option: str
    column: str
    across: bool = True  # may stand on columns as well as on rows
    dated: bool = False
    implies: frozenset[str] = frozenset()
    absorbs: frozenset[str] = frozenset()


# --- fixed values: dimensions in hierarchy order, defaults ---------------------------------------
DIMENSIONS = (
    Dim("era", "EraName"),
    Dim("account_classification", "AccountClassification"),
    Dim("account_category", "AccountCategory"),
    Dim("account", "Account", across=False),
    Dim("txntype", "TxnType"),
    Dim("txnclass", "TxnClass"),
    Dim("category", "Category"),
    Dim("category_subcategory", "CategorySubcategory", across=False, absorbs=frozenset({"category", "subcategory"})),
    Dim("subcategory", "Subcategory", across=False, implies=frozenset({"category"})),
    Dim("payee", "Payee", across=False),
    Dim("yyyy", "DateYYYY", dated=True),
    Dim("yyyymm", "DateYYYYMM", dated=True),
)
OPT_TOTAL = "total"
DEFAULT_ROWS = ("category", "subcategory")
DEFAULT_COLUMNS = ("yyyy",)
LABEL_SEP = "|"
# ----------------------------------------------------------------------------------------------
_BY_OPTION = {d.option: d for d in DIMENSIONS}
DATED = frozenset(d.column for d in DIMENSIONS if d.dated)


def _chosen(asked: str | Sequence[str], side: str) -> list[Dim]:
    """Dimensions of one side in hierarchy order."""
    names = {asked} if isinstance(asked, str) else set(asked)
    unknown = sorted(n for n in names if n not in _BY_OPTION or side == "columns" and not _BY_OPTION[n].across)
    if unknown:
        raise SpecError(f"options.{side}: no such dimension: {unknown}")
    names = names.union(*(_BY_OPTION[n].implies for n in names))
    names = names.difference(*(_BY_OPTION[n].absorbs for n in names))
    return [d for d in DIMENSIONS if d.option in names]


def resolve_dims(options: Mapping | None) -> tuple[list[str], list[str], bool]:
    """Options -> (row columns, pivot columns, totals only). A report of totals has no pivot columns."""
    options = options or {}
    rows = _chosen(options.get("rows") or DEFAULT_ROWS, "rows")
    across = options.get("columns") or DEFAULT_COLUMNS
    across = [across] if isinstance(across, str) else list(across)
    columns = _chosen([a for a in across if a != OPT_TOTAL], "columns")
    if OPT_TOTAL in across:
        return [d.column for d in rows], [], True
    both = [d.option for d in rows if d in columns]
    if both:
        raise SpecError(f"options: {both} cannot stand on rows and on columns")
    return [d.column for d in rows], [d.column for d in columns], False


def _dim_expr(name: str) -> Column:
    if name == "DateYYYY":
        return year_end(F.col("Date"))
    if name == "DateYYYYMM":
        return month_start(F.col("Date"))
    return F.coalesce(F.col(name), F.lit(""))


def _label(name: str) -> Column:
    # labels are text: dates as ISO dates, NULL as ''
    return F.date_format(name, "yyyy-MM-dd") if name in DATED else F.col(name)


def pivot_base(ledger: Ledger, spec: Mapping | None, rows: Sequence[str], cols: Sequence[str], foreach: str | None = None) -> DataFrame:
    """Filtered view with the dimension columns the pivot needs (accounts joined when used)."""
    keep = []
    if foreach:
        from .fanout import keyed_view

        view = keyed_view(ledger, spec, foreach)
        keep = ["foreach"]
    else:
        view = apply_select(ledger.view, (spec or {}).get("select", {}), ledger.ctx())
    dims = [*rows, *cols]
    if {"AccountClassification", "AccountCategory"} & set(dims):
        # inner join on the accounts dimension (one row per account); AQE broadcasts it
        accts = ledger.accounts.select("Account", "AccountClassification", "AccountCategory")
        view = view.join(accts, "Account")
    return view.select(*keep, *[_dim_expr(d).alias(d) for d in dims], "Amount")


def pivot_long(ledger: Ledger, spec: Mapping | None = None, foreach: str | None = None) -> DataFrame:
    """One row per cell and margin: [foreach,] a text label per dimension, Amount, RowTotal, ColumnTotal.

    A margin's own labels are NULL and its flag is true; data labels are never NULL. Any number of labels.
    """
    spec = spec or {}
    rows, cols, _ = resolve_dims(spec.get("options"))
    by = ["foreach"] if foreach else []
    dims = [*rows, *cols]
    base = pivot_base(ledger, spec, rows, cols, foreach)
    pre = base.groupBy(*by, *dims).agg(F.sum("Amount").alias("Amount"))
    sets = [[*by, *dims], by] + ([[*by, *rows], [*by, *cols]] if cols else [])
    grouped = pre.groupingSets(sets, *by, *dims).agg(
        F.sum("Amount").alias("Amount"),
        F.grouping(rows[0]).cast("boolean").alias("RowTotal"),
        (F.grouping(cols[0]).cast("boolean") if cols else F.lit(True)).alias("ColumnTotal"),
    )
    return grouped.select(*by, *[_label(d).alias(d) for d in dims], "Amount", "RowTotal", "ColumnTotal")


def column_label(cols: Sequence[str]) -> Column:
    """Name of a data column: its labels joined by ``|``.

    A ``|`` inside a label of several gets a backslash, and so does a label that reads like the margin, so different
    columns have different names.
    """
    parts = [F.col(c) if len(cols) == 1 else F.replace(F.col(c), F.lit(LABEL_SEP), F.lit("\\" + LABEL_SEP)) for c in cols]
    joined = F.concat_ws(LABEL_SEP, *parts)
    return F.when(joined == S.TOTAL_LABEL, F.concat(F.lit("\\"), joined)).otherwise(joined)


def pivot(ledger: Ledger, spec: Mapping | None = None, foreach: str | None = None) -> DataFrame:
    """Pivot report. ``spec`` = {"select": {...}, "options": {"rows": [...], "columns": [...]}}.

    Output: one text column per row dimension, one column per column label (multi-level labels
    joined with ``|``) and ``Total``; plus a ``Total`` row (first row label ``Total``, the others
    ``''``). Cells without data are NULL.
    """
    rows, cols, totals_only = resolve_dims((spec or {}).get("options"))
    by = ["foreach"] if foreach else []
    cells = pivot_long(ledger, spec, foreach)
    shown = [
        F.when(F.col("RowTotal"), F.lit("" if i else S.TOTAL_LABEL)).otherwise(F.col(r)).alias(r) for i, r in enumerate(rows)
    ]
    if totals_only:
        out = cells.select(*by, *shown, F.col("Amount").alias(S.TOTAL_LABEL), "RowTotal")
        return out.orderBy(*by, "RowTotal", *rows).drop("RowTotal")
    # Both the names and the cells are read from the aggregate: write it once instead of aggregating twice.
    cells = cut_lineage(cells, "pivot")
    names = cells.filter("NOT ColumnTotal").select(*cols, column_label(cols).alias("name")).distinct()
    place = F.lit(0)
    if "EraName" in cols:
        eras = ledger.eras.select("EraName", "era_no")
        names = names.join(F.broadcast(eras), "EraName", "left")
        place = F.coalesce("era_no", F.lit(1 << 30))
    order = [place if c == "EraName" else F.col(c) for c in cols]
    domain = [r.name for r in names.orderBy(*order, "name").select("name").collect()]
    named = cells.select(*by, *shown, "RowTotal", F.when(F.col("ColumnTotal"), F.lit(S.TOTAL_LABEL)).otherwise(column_label(cols)).alias("name"), "Amount")
    out = named.groupBy(*by, *rows, "RowTotal").pivot("name", [*domain, S.TOTAL_LABEL]).agg(F.first("Amount"))
    return out.orderBy(*by, "RowTotal", *rows).drop("RowTotal")
