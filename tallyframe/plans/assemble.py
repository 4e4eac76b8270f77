"""Export files -> ledger in one call: classify the files, parse every kind, assemble facts and dimensions.

``ledger_from_lines`` takes a line table with files of all kinds. Nothing is collected but the names of the
kinds that occur; each kind's parser runs over its own files. What a parser could not use is in ``problems``.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.category import split_category
from ..functions.money import parse_amount
from ..ledger import Ledger
from ..operators import ledger as L
from ..operators import normalize as N
from ..session import DENSE, cut_lineage, shared_path
from ..sources import exports as X
from . import ingest as I

IMPORT_ORDER = ("SrcDate", "SrcOrder", "SrcLine")
BULK_LINES = 1 << 20
HEADER_ROWS = {"loan_terms": 2}
DETAIL_NAMES = {"Balance": "OpeningBalance", "Bank Name": "BankName", "Account Number": "AccountNumber", "Limit": "AccountLimit"}


def parse_details(lines: DataFrame) -> DataFrame:
    """Account-details exports: attributes per account, and the balance as of the report's date (else the file's)."""
    kind = X.KINDS["account_balances_details"]
    typed, _ = N.normalize_amounts(X.read_export(lines, kind), list(kind.money))
    dated = typed.join(X.as_of_date(lines), "file", "left").withColumnsRenamed({"Balance.1": "AsOfBalance"})
    return dated.withColumnsRenamed({k: v for k, v in DETAIL_NAMES.items() if k in dated.columns})


class ImportedLedger(Ledger):
    """A ledger whose sources are the exports of a line table (``stored``: written already, so that reading it again is cheap)."""

    def __init__(self, spark: SparkSession, lines: DataFrame, config: Mapping | None = None, account_config: DataFrame | None = None, stored: bool = False) -> None:
        self.lines = lines if stored else cut_lineage(lines, "lines", DENSE)
        self.kinds = cut_lineage(X.classify_exports(self.lines), "kinds")
        self.present = {r.kind for r in self.kinds.select("kind").distinct().collect() if r.kind}
        super().__init__(spark, None, config, account_config=account_config, order_key=IMPORT_ORDER)

    #: The transactions are stored rows: what is made of them need not be written again to be read twice.
    facts_stored = True

    def of_kind(self, kind: str) -> DataFrame:
        """The lines of the files of a kind."""
        if kind not in self.present:
            return self.lines.filter("false")
        if kind == self._bulk:
            return self.lines.join(self.kinds.filter(F.col("kind") == kind).select("file"), "file", "left_semi").select(*self.lines.columns)
        return self._dealt.filter(F.col("kind") == kind).drop("kind")

    @cached_property
    def _bulk(self) -> str | None:
        """The kind of more than half of all lines, if these are many: its parser reads them where they are, as writing them
        anew would take more than reading past the others'."""
        counts = self.lines.select("file").join(self.kinds, "file", "left").groupBy("kind").count().collect()  # a row per kind
        of, most = max(((r.kind, r["count"]) for r in counts), key=lambda c: c[1], default=(None, 0))
        return of if most > BULK_LINES and 2 * most > sum(r["count"] for r in counts) else None

    @cached_property
    def _dealt(self) -> DataFrame:
        """The other lines in a folder per kind: the parsers of a small kind don't read the lines of the large ones."""
        path = shared_path(self.spark, f"lines-by-kind-{uuid.uuid4().hex}")
        known = self.kinds.filter(F.col("kind").isNotNull() & (F.col("kind") != F.lit(self._bulk or "")))
        self.lines.join(known, "file").select(*self.lines.columns, "kind").write.partitionBy("kind").parquet(path, compression=DENSE)
        return self.spark.read.parquet(path)

    @cached_property
    def txn_import(self) -> I.TxnImport:
        return I.parse_txn_exports(self.of_kind("account_txns"), stored=True)

    @cached_property
    def tagged(self) -> DataFrame:
        rows = self.txn_import.rows.withColumnsRenamed({"file": "SrcOrder", "line_no": "SrcLine"}).withColumn("SrcDate", F.col("Date"))
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("C", "Memo") if c not in rows.columns})
        return L.tag_transfers(rows)

    @cached_property
    def inv_import(self) -> I.InvImport | None:
        if "investment_txns" not in self.present:
            return None
        return I.import_investments(cut_lineage(X.read_export(self.of_kind("investment_txns"), X.KINDS["investment_txns"])))

    @cached_property
    def txns_inv_rows(self) -> DataFrame | None:
        return self.inv_import.rows if self.inv_import else None

    @cached_property
    def loan_rows(self) -> DataFrame | None:
        return I.parse_loans(self.of_kind("loan_terms"))[0] if "loan_terms" in self.present else None

    @cached_property
    def balances(self) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        return I.parse_balances(self.of_kind("account_balances")) if "account_balances" in self.present else None

    @cached_property
    def details(self) -> DataFrame | None:
        return parse_details(self.of_kind("account_balances_details")) if "account_balances_details" in self.present else None

    def _spending(self, kind: str) -> tuple[DataFrame, DataFrame]:
        return I.parse_spending(self.of_kind(kind), monthly=kind == "monthly_income_expenses")

    @cached_property
    def spending_kinds(self) -> list[str]:
        return [k for k in ("income_spending", "monthly_income_expenses") if k in self.present]

    @cached_property
    def categories(self) -> DataFrame:
        typed = [self._spending(k)[0].select(split_category(F.col("Category"))[0].alias("Category"), "TxnType").distinct() for k in self.spending_kinds]
        c = L.category_types_overlay(self.categories_raw, typed)
        c = L.category_config_overlay(c, self.config.get("category_types"), self.config.get("category_classes"))
        return L.category_defaults(c, self.config.get("category_type_default", "Expense"), self.config.get("category_class_default", "Discretionary"))

    @cached_property
    def accounts_base(self) -> DataFrame:
        items = self.balances[0] if self.balances else None
        base = L.accounts(self.txns, self.txns_inv_rows, self.loan_rows, items, self.details)
        if items is not None:
            base = L.account_types_overlay(base, items)
        return base if self.details is None else L.account_details_overlay(base, self.details)

    @cached_property
    def account_balances(self) -> DataFrame:
        """(Account, Date, Balance): as-of balances of both balance reports, the details' one first."""
        parts = []
        if self.balances:
            dates = X.as_of_date(self.of_kind("account_balances"), fallback_mtime=False)
            parts.append(self.balances[0].join(dates, "file").select("Account", F.col("as_of").alias("Date"), F.col("Total").alias("Balance"), F.lit(1).alias("_seq")))
        if self.details is not None:
            parts.append(self.details.select("Account", F.col("as_of").alias("Date"), F.col("AsOfBalance").alias("Balance"), F.lit(0).alias("_seq")))
        if not parts:
            return self.spark.createDataFrame([], S.ACCOUNT_BALANCES)
        rows = reduce(DataFrame.unionByName, parts).filter("Date IS NOT NULL AND Balance IS NOT NULL")
        merged = rows.groupBy("Account", "Date").agg(F.max_by("Balance", F.struct("_seq", "Balance")).alias("Balance"))
        return L.conform(L.account_balances(merged, self.accounts)[0], S.ACCOUNT_BALANCES)

    @cached_property
    def category_balances(self) -> DataFrame:
        """(Category, Subcategory, Date, Balance) of the dated columns of the spending reports; the first report wins."""
        parts = []
        for seq, kind in enumerate(self.spending_kinds):
            cells = X.read_asof_columns(self.of_kind(kind), X.KINDS[kind])
            items = self._spending(kind)[0].select("file", "line_no", "TxnType")
            category, subcategory = split_category(F.col("name"))
            parts.append(
                cells.join(items, ["file", "line_no"]).select(
                    category.alias("Category"), subcategory.alias("Subcategory"), "Date", parse_amount(F.col("value")).alias("Balance"), "TxnType", F.lit(seq).alias("report_seq")
                )
            )
        if not parts:
            return self.spark.createDataFrame([], S.CATEGORY_BALANCES)
        return L.conform(L.category_balances(reduce(DataFrame.unionByName, parts)), S.CATEGORY_BALANCES)

    def other_tables(self) -> dict[str, DataFrame]:
        return {
            "TxnsInv": self.spark.createDataFrame([], S.TXNS_INV) if self.txns_inv_rows is None else L.conform(self.txns_inv_rows, S.TXNS_INV),
            "Loans": self.spark.createDataFrame([], S.LOANS) if self.loan_rows is None else L.conform(self.loan_rows, S.LOANS),
            "AccountBalances": self.account_balances,
            "CategoryBalances": self.category_balances,
        }

    def tables(self) -> dict[str, DataFrame]:
        """All nine ledger tables (those without exports are empty)."""
        return {
            "Txns": L.conform(self.txns_numbered(), S.TXNS),
            "Accounts": L.conform(self.accounts, S.ACCOUNTS),
            "Payees": L.conform(self.payees, S.PAYEES),
            "Categories": L.conform(self.categories, S.CATEGORIES),
            "Eras": self.eras,
            **self.other_tables(),
        }

    def problems(self) -> DataFrame:
        """(file, line_no, problem, value): files of no kind or without a column they need, rejected dates and amounts
        (rows without one included), rows outside sections. What the import leaves out is here, and only that."""
        none = F.lit(None).cast("string")
        parts = [self.kinds.filter("kind IS NULL").select("file", F.lit(None).cast("long").alias("line_no"), F.lit("unknown kind").alias("problem"), none.alias("value"))]
        for kind in sorted(self.present):
            faults = X.export_problems(self.of_kind(kind), X.KINDS[kind], HEADER_ROWS.get(kind, 1))
            parts.append(faults.select("file", F.lit(None).cast("long").alias("line_no"), "problem", none.alias("value")))
            if kind not in ("account_txns", "investment_txns"):
                bad = I.amount_problems(self.of_kind(kind), kind, HEADER_ROWS.get(kind, 1))
                parts.append(bad.select("file", "line_no", F.col("column").alias("problem"), "value"))
        for found in (self.txn_import if "account_txns" in self.present else None, self.inv_import):
            if found:
                parts.append(found.date_rejects.select("file", "line_no", F.lit("Date").alias("problem"), "value"))
                parts.append(found.amount_rejects.select("file", "line_no", F.col("column").alias("problem"), "value"))
        if self.balances:
            parts.append(self.balances[2].select("file", "line_no", "problem", F.col("Account").alias("value")))
        for kind in self.spending_kinds:
            parts.append(I.spending_problems(self.of_kind(kind), monthly=kind == "monthly_income_expenses"))
        return reduce(DataFrame.unionByName, parts)

    def control_totals(self) -> DataFrame:
        """(file, kind, ok): the control total of each file against its rows (C1 - C3); a file without one is not ok."""
        parts = []
        if "account_txns" in self.present:
            parts.append(self.txn_import.check_total().select("file", F.lit("account_txns").alias("kind"), "ok"))
        if self.balances:
            worth = I.check_net_worth(self.balances[0], self.balances[1])
            parts.append(worth.select("file", F.lit("account_balances").alias("kind"), (F.col("sum_ok") & F.col("net_worth_ok")).alias("ok")))
        for kind in self.spending_kinds:
            parts.append(I.check_spending_total(*self._spending(kind)).select("file", F.lit(kind).alias("kind"), "ok"))
        if not parts:
            return self.spark.createDataFrame([], "file string, kind string, ok boolean")
        return reduce(DataFrame.unionByName, parts)


def ledger_from_lines(spark: SparkSession, lines: DataFrame, config: Mapping | None = None, account_config: DataFrame | None = None, stored: bool = False) -> ImportedLedger:
    """The ledger of all exports of a line table (``sources.exports.read_lines``)."""
    return ImportedLedger(spark, lines, config, account_config, stored)
