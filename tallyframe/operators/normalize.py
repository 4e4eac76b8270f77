"""Normalization of parsed export rows: typing, splits, voids, windows, as-of reshaping, sections.

The original tool cleaned each export with row-at-a-time Python loops over a pandas frame. The
order-dependent ones (split transactions, section headers, loan child rows) become window
functions partitioned by file and ordered by the true line number, so every file is cleaned
independently and in parallel; nothing needs a global order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.category import split_category
from ..functions.money import amount_rejected, parse_amount
from ..session import DENSE, cut_lineage
from .fill import filled
from .numbering import number_rows
from .scan import running
from .sections import FAULT, ITEM, OPEN, open_sections

HAS_DATE = "_has_date"  # the row had a date text, right or wrong

# ---------------------------------------------------------------------------------------------
# N1 - N3 typing


def normalize_amounts(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Money text -> DECIMAL(15,4). Returns (typed rows, rejects (file, line_no, column, value))."""
    rejects = None
    for c in columns:
        r = df.filter(amount_rejected(F.col(f"`{c}`"))).select(
            *[x for x in ("file", "line_no") if x in df.columns], F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")
        )
        rejects = r if rejects is None else rejects.unionByName(r)
    typed = df.withColumns({c: parse_amount(F.col(f"`{c}`")) for c in columns})
    if rejects is None:
        rejects = df.sparkSession.createDataFrame([], "file string, line_no long, column string, value string")
    return typed, rejects


def with_split_category(df: DataFrame, column: str = "Category") -> DataFrame:
    """``Category : Subcategory`` text -> Category, Subcategory."""
    cat, sub = split_category(F.col(column))
    return df.withColumn("Subcategory", sub).withColumn("Category", cat)


def parse_dates(df: DataFrame, column: str = "Date", fmt: str = "yyyy-MM-dd") -> tuple[DataFrame, DataFrame]:
    """Strict date text -> DATE; (rows, rejects) where rejects hold unparseable non-blank values."""
    d = F.try_to_date(F.col(column), fmt)
    bad = df.filter(F.col(column).isNotNull() & d.isNull())
    # a row whose date text is wrong is still a dated row: it is no part of the transaction above it
    return df.withColumn(HAS_DATE, F.col(column).isNotNull()).withColumn(column, d), bad


# ---------------------------------------------------------------------------------------------
# N4 / N5 splits and voids


def flatten_splits(rows: DataFrame, order: str = "line_no", stored: bool = False) -> DataFrame:
    """Split transactions: a dated row followed by undated rows is a parent (removed); the undated
    rows are its parts ('Y') and take Num, Date, Payee, Account (and Memo when theirs is NULL).

    Each row's parent = the last dated row at or before it in its file; a dated row is a parent iff the row that follows it is
    undated. Lines that lie in order are filled down where they lie (``operators.fill``); others are dealt out by file and
    chunk for a forward fill that also tells what follows (``operators.scan``), once. Rows with a wrong date text count as
    dated (see ``parse_dates``); their parts keep a NULL date like them. ``stored``: the rows will be read several times.
    """
    dated = F.col(HAS_DATE) if HAS_DATE in rows.columns else F.col("Date").isNotNull()
    inherit = ["Num", "Date", "Payee", "Account", "Memo"]
    found = filled(rows, "file", order, dated, inherit)
    if found:
        x, above, has, below = found
    else:
        x = running(rows, "file", order, last={"_p": F.when(dated, F.struct(*inherit))}, next_is={"_below": ~dated})
        above, has, below = {c: F.col("_p").getField(c) for c in inherit}, F.col("_p").isNotNull(), F.col("_below")
    # rows without a file or a place are nobody's parent
    is_parent = dated & below & F.col("file").isNotNull() & F.col(order).isNotNull()
    x = x.filter(~F.coalesce(is_parent, F.lit(False)))
    is_part = ~dated & has
    x = x.withColumns(
        {
            **{c: F.when(is_part & (F.col(c).isNull() if c == "Memo" else F.lit(True)), above[c]).otherwise(F.col(c)) for c in inherit},
            "Split": F.when(is_part, F.lit(S.SPLIT_CHILD)),
        }
    )
    flat = x.select(*(c for c in rows.columns if c not in ("Split", HAS_DATE)), "Split")
    return flat if found or not stored else cut_lineage(flat, "flat", DENSE)


def orphan_parts(rows: DataFrame, order: str = "line_no") -> DataFrame:
    """Undated rows before any dated row of their file (the original raised on these)."""
    dated = F.col(HAS_DATE) if HAS_DATE in rows.columns else F.col("Date").isNotNull()
    x = running(rows, "file", order, last={"_p": F.when(dated, F.col(order))})
    return x.filter(~dated & F.col("_p").isNull()).drop("_p")


def drop_voids(rows: DataFrame) -> DataFrame:
    """Remove voided transactions (after flattening, so parts of a void go too)."""
    return rows.filter(~F.coalesce(F.col("Num") == S.VOID_NUM, F.lit(False)))


def import_window(rows: DataFrame, date_from: date | None = None, date_to: date | None = None, column: str = "Date") -> DataFrame:
    """Inclusive import window."""
    if date_from is not None:
        rows = rows.filter(F.col(column) >= F.lit(date_from))
    if date_to is not None:
        rows = rows.filter(F.col(column) <= F.lit(date_to))
    return rows


# ---------------------------------------------------------------------------------------------
# N8 union and numbering


def union_txns(frames: Sequence[DataFrame], order: Sequence[str] = ("Date", "file_seq", "file", "line_no")) -> DataFrame:
    """Concatenate exports of one type (duplicates kept), then number 1..n by (Date, file, line).

    Each frame gets its position (``file_seq``) so that ties keep the import order; numbering is
    the distributed dense rank of ``operators.numbering``.
    """
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("file_seq", F.lit(i)) if "file_seq" not in f.columns else f
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return number_rows(out, [c for c in order if c != "file" or c in out.columns], "N")


# ---------------------------------------------------------------------------------------------
# N7 / N9 / N10 as-of columns


def asof_columns(columns: Sequence[str]) -> dict[str, date]:
    """Column names that are ``MM/DD/YYYY`` dates."""
    out = {}
    for c in columns:
        try:
            out[c] = datetime.strptime(c, "%m/%d/%Y").date()
        except ValueError:
            continue
    return out


def prune_asof_columns(df: DataFrame, date_from: date | None, date_to: date | None) -> DataFrame:
    """Drop date-named columns outside the window (N7); the column list is schema, not data."""
    drop = [c for c, d in asof_columns(df.columns).items() if (date_from and d < date_from) or (date_to and d > date_to)]
    return df.drop(*drop)


def unpivot_asof(df: DataFrame, id_cols: Sequence[str], value_name: str = "Balance") -> DataFrame:
    """Wide as-of columns -> rows (ids..., Date, value); NULL values dropped."""
    dates = asof_columns(df.columns)
    if not dates:
        return df.sparkSession.createDataFrame([], f"{', '.join(f'`{c}` string' for c in id_cols)}, Date date, {value_name} decimal(15,4)")
    long = df.unpivot(list(id_cols), list(dates), "_col", value_name)
    return long.filter(F.col(value_name).isNotNull()).withColumn("Date", F.to_date("_col", "MM/dd/yyyy")).select(*id_cols, "Date", value_name)


def merge_asof(frames: Sequence[DataFrame], key: str, id_cols: Sequence[str] = ()) -> DataFrame:
    """Merge as-of reports on ``key``: per (key, column) the later report's non-NULL value wins.

    Long form: every report is unpivoted (non-NULL values only), tagged with its position, and
    ``max_by(value, seq)`` picks the latest per (key, date). Scales to any number of reports.
    ``id_cols`` (attributes of the key) are merged by the same rule, over all reports that have the key.
    """
    long = attributes = None
    for seq, f in enumerate(frames):
        part = unpivot_asof(f, [key]).withColumn("_seq", F.lit(seq))
        long = part if long is None else long.unionByName(part)
        have = f.select(key, *(c for c in id_cols if c in f.columns)).withColumn("_seq", F.lit(seq))
        attributes = have if attributes is None else attributes.unionByName(have, allowMissingColumns=True)
    merged = long.groupBy(key, "Date").agg(F.max_by("Balance", "_seq").alias("Balance"))
    if not id_cols:
        return merged
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in id_cols]
    return merged.join(attributes.groupBy(key).agg(*latest), key, "left").select(key, *id_cols, "Date", "Balance")


# ---------------------------------------------------------------------------------------------
# N11 / N12 sectioned reports


BLANK = "_blank"  # the row has no total text at all: only such a row opens a section


def mark_blank(rows: DataFrame, total: str = "Total") -> DataFrame:
    """Keep which totals are blank before they are typed: a total that does not parse is no header."""
    return rows.withColumn(BLANK, F.col(f"`{total}`").isNull())


def _sections(rows: DataFrame, name: str, total: str) -> tuple[DataFrame, list[str]]:
    opens = F.col(BLANK) if BLANK in rows.columns else F.col(f"`{total}`").isNull()
    shown = [c for c in rows.columns if c != BLANK]
    x = open_sections(rows.withColumn("_opens", opens), name, F.col("_opens"))
    # an item without a usable total is a reject of its amounts, no row
    return x.withColumn("_item", (F.col("_role") == ITEM) & F.col(f"`{total}`").isNotNull()), shown


def label_sections_2level(rows: DataFrame, name: str = "Account", total: str = "Total") -> tuple[DataFrame, DataFrame]:
    """Two-level sections: (Type, Subtype) per item row; header and total rows removed.

    Rows without a total text open a section (the first level is the type, the next the subtype); ``Total X``
    closes the innermost open section, which must be ``X`` (see ``operators.sections``); any other ``Total ...`` is an
    item. A row whose total does not parse is neither header nor item.
    Returns (items with Type / Subtype, problems (file, line_no, name, problem)).
    """
    x, shown = _sections(rows, name, total)
    depth = F.size("_stack")
    problem = (
        F.when((F.col("_role") == OPEN) & (depth > 2), F.lit("third section level"))
        .when(F.col("_role") == FAULT, F.lit("total does not close the open section"))
        .when(F.col("_item") & (depth < 1), F.lit("row outside any section"))
    )
    x = x.withColumn("_problem", problem)
    problems = x.filter(F.col("_problem").isNotNull()).select("file", "line_no", F.col(name).alias(name), F.col("_problem").alias("problem"))
    items = x.filter(F.col("_item") & F.col("_problem").isNull()).select(
        *shown, F.get("_stack", F.lit(0)).alias("Type"), F.when(depth == 2, F.get("_stack", F.lit(1))).alias("Subtype")
    )
    return items, problems


def label_sections_1level(rows: DataFrame, header_map: Mapping[str, str], name: str = "Category", total: str = "Total") -> DataFrame:
    """One-level sections: each item takes the innermost open header; header text -> TxnType."""
    x, shown = _sections(rows, name, total)
    m = F.create_map(*[F.lit(v) for kv in header_map.items() for v in kv])
    items = x.filter(F.col("_item") & (F.size("_stack") > 0)).withColumn("Section", F.element_at("_stack", -1))
    return items.withColumn("TxnType", F.element_at(m, F.col("Section"))).select(*shown, "Section", "TxnType")


def section_problems_1level(rows: DataFrame, header_map: Mapping[str, str], name: str = "Category", total: str = "Total") -> DataFrame:
    """(file, line_no, name, problem): rows outside a section, headers that the report kind doesn't know or that stand
    inside another section, totals that don't close the innermost one."""
    x, _ = _sections(rows, name, total)
    is_open = F.col("_role") == OPEN
    problem = (
        F.when(F.col("_item") & (F.size("_stack") < 1), F.lit("row outside any section"))
        .when(is_open & ~F.col(name).isin(list(header_map)), F.lit("unknown section"))
        .when(is_open & (F.size("_stack") > 1), F.lit("section inside another"))
        .when(F.col("_role") == FAULT, F.lit("total does not close the open section"))
    )
    return x.select("file", "line_no", F.col(name).alias(name), problem.alias("problem")).filter("problem IS NOT NULL")


# ---------------------------------------------------------------------------------------------
# N14 / N15 loans


def loan_payee_categories(rows: DataFrame) -> DataFrame:
    """Rows without a loan name belong to the loan above: (Loan, Payee, Category, Subcategory)."""
    x = running(rows, "file", "line_no", last={"_loan": F.col("Loan")})
    x = x.filter(F.col("category").isNotNull() | F.col("Payee").isNotNull())
    cat, sub = split_category(F.col("category"))
    return x.select(F.col("_loan").alias("Loan"), "Payee", cat.alias("Category"), sub.alias("Subcategory")).distinct()


LOAN_RENAMES = {
    "Number": "AccountNumber",
    "Amount": "LoanAmount",
    "Rate": "InterestRate",
    "Interest": "PrincipalInterest",
    "Amount.1": "BalloonAmount",
    "category": "Category",
    "Interest.1": "InterestWhen",
}


def rename_loans(rows: DataFrame) -> DataFrame:
    """Loan-terms export columns -> Loans table columns, one row per loan."""
    x = rows.filter(F.col("Loan").isNotNull()).withColumnsRenamed({k: v for k, v in LOAN_RENAMES.items() if k in rows.columns})
    keep = [f.name for f in S.LOANS.fields]
    return x.select(*[(F.col(c) if c in x.columns else F.lit(None)).cast(f.dataType).alias(c) for c, f in zip(keep, S.LOANS.fields)])

