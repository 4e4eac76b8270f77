"""Export ingestion: line tables -> cleaned, typed frames per export type (E1 of the lifecycle)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_amount
from ..operators import normalize as N
from ..operators.checks import control_total
from ..session import DENSE, cut_lineage
from ..sources.exports import KINDS, read_export, split_footer

SPENDING_SECTIONS = {"Income Categories": "Income", "Expense Categories": "Expense", "Transfers": "Transfer"}
MONTHLY_SECTIONS = {"Income": "Income", "Expenses": "Expense", "Transfers": "Transfer"}


@dataclass
class TxnImport:
    rows: DataFrame  # flattened, voids removed, typed (before the import window)
    footer: DataFrame  # (file, Total) control totals
    amount_rejects: DataFrame  # amounts that don't parse, and rows without one
    date_rejects: DataFrame  # wrong dates, and parts that no dated row stands above

    def check_total(self) -> DataFrame:
        """Per file, sum of the rows vs the Grand Total row."""
        return control_total(self.rows, self.footer)

    def windowed(self, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
        return N.import_window(self.rows, date_from, date_to)


def parse_txn_exports(lines: DataFrame, stored: bool = False) -> TxnImport:
    """Account-transaction exports: header, footer, amounts, categories, dates, splits, voids. ``stored``: for a caller that asks
    for rows, totals and rejects, each of which would flatten the rows again."""
    kind = KINDS["account_txns"]
    # the parsed rows feed several branches (rows, footer, rejects, the split scan): parse once
    rows = cut_lineage(read_export(lines, kind), "parsed", DENSE)
    data, footer = split_footer(rows, kind.footer_label, "Num")
    typed, amount_rejects = N.normalize_amounts(data, list(kind.money))
    typed = N.with_split_category(typed)
    typed, date_rejects = N.parse_dates(typed)
    flat = N.drop_voids(N.flatten_splits(typed, stored=stored))
    # Date and Amount are NOT NULL in the ledger: rows without them are rejects, never rows
    undated = flat.filter("Date IS NULL").join(date_rejects.select("file", "line_no"), ["file", "line_no"], "left_anti")
    date_rejects = date_rejects.select("file", "line_no", F.col("Date").alias("value")).unionByName(
        undated.select("file", "line_no", F.lit(None).cast("string").alias("value"))
    )
    blank = flat.filter("Amount IS NULL").join(amount_rejects.select("file", "line_no"), ["file", "line_no"], "left_anti")
    amount_rejects = amount_rejects.unionByName(
        blank.select("file", "line_no", F.lit("Amount").alias("column"), F.lit(None).cast("string").alias("value"))
    )
    foot = footer.select("file", parse_amount(F.col("Amount")).alias("Total"))
    return TxnImport(flat.filter("Date IS NOT NULL AND Amount IS NOT NULL"), foot, amount_rejects, date_rejects)


def amount_problems(lines: DataFrame, kind_name: str, header_rows: int = 1) -> DataFrame:
    """(file, line_no, column, value) of the amounts of an export kind that don't parse."""
    kind = KINDS[kind_name]
    return N.normalize_amounts(read_export(lines, kind, header_rows), list(kind.money))[1]


def parse_balances(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Account-balances export -> (accounts with Type/Subtype and Total, Net Worth footer, problems)."""
    kind = KINDS["account_balances"]
    rows = cut_lineage(read_export(lines, kind))
    data, footer = split_footer(rows, kind.footer_label, "Account")
    typed, _ = N.normalize_amounts(N.mark_blank(data), ["Total"])
    items, problems = N.label_sections_2level(typed)
    foot = footer.select("file", parse_amount(F.col("Total")).alias("Total"))
    return items, foot, problems


def check_net_worth(items: DataFrame, footer: DataFrame) -> DataFrame:
    """Sum of accounts = assets + liabilities, and Net Worth = assets - liabilities."""
    g = items.groupBy("file").agg(
        F.sum("Total").alias("total"),
        F.sum(F.when(F.col("Type") == "Assets", F.col("Total"))).alias("assets"),
        F.sum(F.when(F.col("Type") == "Liabilities", F.col("Total"))).alias("liabilities"),
    )
    j = g.join(footer.withColumnRenamed("Total", "net_worth"), "file", "full")
    a, li = F.coalesce(F.col("assets"), F.lit(0)), F.coalesce(F.col("liabilities"), F.lit(0))
    return j.select(
        "file",
        "total",
        "assets",
        "liabilities",
        "net_worth",
        F.coalesce(F.col("total") == a + li, F.lit(False)).alias("sum_ok"),
        F.coalesce(F.col("net_worth") == a - li, F.lit(False)).alias("net_worth_ok"),
    )


def parse_spending(lines: DataFrame, monthly: bool = False) -> tuple[DataFrame, DataFrame]:
    """Income-and-spending (or monthly) export -> (categories with TxnType and Total, footer)."""
    kind = KINDS["monthly_income_expenses" if monthly else "income_spending"]
    rows = cut_lineage(read_export(lines, kind))
    data, footer = split_footer(rows, kind.footer_label, "Category")
    typed, _ = N.normalize_amounts(N.mark_blank(data), ["Total"])
    items = N.label_sections_1level(typed, MONTHLY_SECTIONS if monthly else SPENDING_SECTIONS)
    foot = footer.select("file", parse_amount(F.col("Total")).alias("Total"))
    return items, foot


def spending_problems(lines: DataFrame, monthly: bool = False) -> DataFrame:
    """(file, line_no, problem, value) of the sections of an income-and-spending (or monthly) export."""
    kind = KINDS["monthly_income_expenses" if monthly else "income_spending"]
    data, _ = split_footer(cut_lineage(read_export(lines, kind)), kind.footer_label, "Category")
    typed, _ = N.normalize_amounts(N.mark_blank(data), ["Total"])
    found = N.section_problems_1level(typed, MONTHLY_SECTIONS if monthly else SPENDING_SECTIONS)
    return found.select("file", "line_no", "problem", F.col("Category").alias("value"))


def check_spending_total(items: DataFrame, footer: DataFrame) -> DataFrame:
    """Grand Total = (income - expenses) + transfers."""
    g = items.groupBy("file").agg(
        F.sum(F.when(F.col("TxnType") == "Income", F.col("Total"))).alias("income"),
        F.sum(F.when(F.col("TxnType") == "Expense", F.col("Total"))).alias("expenses"),
        F.sum(F.when(F.col("TxnType") == "Transfer", F.col("Total"))).alias("transfers"),
    )
    j = g.join(footer.withColumnRenamed("Total", "grand_total"), "file", "full")
    calc = F.coalesce(F.col("income"), F.lit(0)) - F.coalesce(F.col("expenses"), F.lit(0)) + F.coalesce(F.col("transfers"), F.lit(0))
    return j.select("file", "income", "expenses", "transfers", "grand_total", F.coalesce(F.col("grand_total") == calc, F.lit(False)).alias("ok"))


def parse_loans(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loan-terms export (two header rows) -> (Loans table rows, loan payee/category map)."""
    rows = read_export(lines, KINDS["loan_terms"], header_rows=2)
    return N.rename_loans(N.normalize_amounts(rows, ["Amount", "Amount.1", "Interest", "Payment", "Fees", "Balance"])[0].withColumn("Rate", parse_amount(F.col("Rate")))), N.loan_payee_categories(rows)


@dataclass
class InvImport:
    rows: DataFrame  # TxnsInv
    amount_rejects: DataFrame  # (file, line_no, column, value)
    date_rejects: DataFrame  # (file, line_no, value): wrong dates, and rows without one


def import_investments(rows: DataFrame, date_from: date | None = None, date_to: date | None = None) -> InvImport:
    """Investment export rows -> TxnsInv (typed, renamed, windowed, numbered by (Date, position)).

    Date is NOT NULL in the ledger: a row without one, or with a wrong one, is a reject. A wrong amount leaves its column
    empty and is listed.
    """
    kind = KINDS["investment_txns"]
    typed, amounts = N.normalize_amounts(rows, list(kind.money))
    typed = N.with_split_category(typed.withColumnRenamed("Transfer Account", "XferAccount"))
    dated, wrong = N.parse_dates(typed)
    blank = typed.filter("Date IS NULL")
    rejects = wrong.select("file", "line_no", F.col("Date").alias("value")).unionByName(blank.select("file", "line_no", F.lit(None).cast("string").alias("value")))
    numbered = N.union_txns([N.import_window(dated.filter("Date IS NOT NULL"), date_from, date_to)], order=("Date", "file_seq", "file", "line_no"))
    cols = ["N", "Date", "Account", "Investment", "Activity", "C", "Quantity", "Price", "Commission", "Total", "XferAccount", "Category", "Subcategory", "Memo"]
    return InvImport(numbered.select(*cols), amounts, rejects)


def investment_txns(rows: DataFrame, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """TxnsInv of investment export rows (see ``import_investments``)."""
    return import_investments(rows, date_from, date_to).rows
