"""The ledger: facts + dimensions assembled lazily from a transactions source and a config.

A ``Ledger`` holds DataFrames (plans), not data. Build it from the test binding
(``Ledger.from_testdata``) or from stored Parquet tables (``sources.store.read_ledger``).
"""

from __future__ import annotations

import copy
from collections.abc import Mapping, Sequence
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .operators import ledger as L
from .operators.filters import FilterContext
from .operators.numbering import number_rows
from .session import cut_lineage

# Order in which transactions were numbered (N) when imported: the source position.
SOURCE_ORDER = ("SrcDate", "SrcOrder", "SrcLine", "Account", "Payee", "Category", "Subcategory", "XferAccount", "Amount", "Memo", "C")


# What is derived from the transactions.
DERIVED = ("txns", "tagged", "_rewritten", "payees", "categories_raw", "categories", "accounts_base", "_classified", "accounts", "view", "account_balances", "category_balances")


class Ledger:
    #: Whether the transactions are stored rows that cost little to read twice.
    facts_stored = False

    def __init__(
        self,
        spark: SparkSession,
        raw_txns: DataFrame,
        config: Mapping | None = None,
        account_config: DataFrame | None = None,
        txns_inv: DataFrame | None = None,
        loans: DataFrame | None = None,
        order_key: Sequence[str] = SOURCE_ORDER,
        anchor_mode: str = "min_of_max",
    ) -> None:
        self.spark = spark
        self.raw_txns = raw_txns
        self.config = dict(config or {})
        self.account_config = account_config
        self.txns_inv = txns_inv
        self.loans = loans
        self.order_key = list(order_key)
        self.anchor_mode = anchor_mode

    # -- construction ---------------------------------------------------------------------

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, config: Mapping | None = None) -> Ledger:
        from .sources import binding

        raw = binding.raw_txns(spark, sf_dir).withColumn("SrcDate", F.col("Date"))
        cfg = binding.LEDGER_CONFIG if config is None else config
        return cls(spark, raw, cfg, account_config=binding.account_config(spark, sf_dir))

    # -- facts ----------------------------------------------------------------------------

    @cached_property
    def tagged(self) -> DataFrame:
        """L1: transfers tagged (before rewrites)."""
        return L.tag_transfers(self.raw_txns)

    @cached_property
    def _rewritten(self) -> tuple[DataFrame, list[str]]:
        rules = self.config.get("rewrites") or []
        if not rules:
            return self.tagged, []
        ctx = FilterContext(anchor=lambda: self._bounds_from(self.tagged)[1])
        return L.apply_rewrites(self.tagged, rules, ctx)

    @cached_property
    def eras(self) -> DataFrame:
        return L.build_intervals(self.spark, self.config.get("eras") or {})

    @cached_property
    def txns(self) -> DataFrame:
        """Txns after transfers, rewrites and era assignment (hidden ``Src*`` order columns kept)."""
        df, flags = self._rewritten
        df = df.drop(*flags)
        return L.assign_interval(df, self.eras)

    def txns_numbered(self, materialize_input: bool = False) -> DataFrame:
        """Txns with N = 1..n in import order.

        Range partitioning samples its input in a separate pass; facts that are no stored table yet are
        materialized first (``materialize_input``), so that what makes them runs once, not twice.
        """
        if "N" in self.txns.columns:
            return self.txns
        src = cut_lineage(self.txns) if materialize_input else self.txns
        return number_rows(src, list(self.order_key), "N")

    def rewrite_counts(self) -> DataFrame:
        df, flags = self._rewritten
        return L.rewrite_counts(df, flags)

    # -- dimensions -----------------------------------------------------------------------

    @cached_property
    def payees(self) -> DataFrame:
        return L.payees(self.txns)

    @cached_property
    def categories_raw(self) -> DataFrame:
        return L.categories(self.txns)

    @cached_property
    def categories(self) -> DataFrame:
        c = L.category_config_overlay(self.categories_raw, self.config.get("category_types"), self.config.get("category_classes"))
        return L.category_defaults(c, self.config.get("category_type_default", "Expense"), self.config.get("category_class_default", "Discretionary"))

    @cached_property
    def accounts_base(self) -> DataFrame:
        return L.accounts(self.txns, txns_inv=self.txns_inv, loans=self.loans)

    @cached_property
    def _classified(self) -> tuple[DataFrame, DataFrame]:
        if self.account_config is None:
            empty = self.spark.createDataFrame([], "Account string, category string, problem string")
            return self.accounts_base, empty
        return L.account_classify(self.accounts_base, self.account_config, self.config.get("account_categories"))

    @cached_property
    def accounts(self) -> DataFrame:
        accts = self._classified[0]
        if self.account_config is not None and {"opened_date", "closed_date"} <= set(self.account_config.columns):
            accts = L.account_dates_overlay(accts, self.account_config)
        # an aggregate of all facts that many plans use: stored, it is made once and its size is known to the planner
        return cut_lineage(accts, "accounts")

    def unknown_account_categories(self) -> DataFrame:
        return self._classified[1]

    def over(self, facts: DataFrame, order_key: Sequence[str]) -> Ledger:
        """The same ledger over other facts: its dimensions are derived anew from them."""
        new = copy.copy(self)
        new.__dict__ = {k: v for k, v in self.__dict__.items() if k not in DERIVED}
        new.__dict__["txns"], new.order_key = facts, list(order_key)
        return new

    def other_tables(self) -> dict[str, DataFrame]:
        """The tables beside the transactions and their dimensions (empty without a source)."""

        def given(rows: DataFrame | None, schema) -> DataFrame:
            return self.spark.createDataFrame([], schema) if rows is None else L.conform(rows, schema)

        return {
            "TxnsInv": given(self.txns_inv, S.TXNS_INV),
            "Loans": given(self.loans, S.LOANS),
            "AccountBalances": given(None, S.ACCOUNT_BALANCES),
            "CategoryBalances": given(None, S.CATEGORY_BALANCES),
        }

    # -- views ----------------------------------------------------------------------------

    @cached_property
    def view(self) -> DataFrame:
        """Enriched transactions (TxnType, TxnClass, CategorySubcategory). The categories are stored first: a planner that
        knows their size does not shuffle the transactions to meet a few of them."""
        return L.enrich(self.txns, cut_lineage(self.categories, "categories"))

    def bounds(self) -> tuple[date | None, date | None]:
        """(min of TxnDateMin, anchor) over accounts that have transactions.

        The anchor of relative dates is, as in the original, the minimum of the accounts'
        last transaction dates (``anchor_mode='max'`` takes the maximum instead).
        """
        a = self.accounts.filter(F.col("TxnDateMin").isNotNull())
        agg = F.min("TxnDateMax") if self.anchor_mode == "min_of_max" else F.max("TxnDateMax")
        row = a.agg(F.min("TxnDateMin").alias("lo"), agg.alias("hi")).first()
        return (row.lo, row.hi) if row else (None, None)

    @staticmethod
    def _bounds_from(txns: DataFrame) -> tuple[date | None, date | None]:
        per_acct = txns.groupBy("Account").agg(F.min("Date").alias("lo"), F.max("Date").alias("hi"))
        row = per_acct.agg(F.min("lo").alias("lo"), F.min("hi").alias("hi")).first()
        return (row.lo, row.hi) if row else (None, None)

    def anchor(self) -> Column:
        """The anchor of relative dates as a scalar subquery: it is part of the plan that uses it."""
        a = self.accounts.filter(F.col("TxnDateMin").isNotNull())
        return a.agg((F.min if self.anchor_mode == "min_of_max" else F.max)("TxnDateMax").alias("anchor")).scalar()

    def ctx(self) -> FilterContext:
        return FilterContext(accounts=self.accounts, anchor=self.anchor)
