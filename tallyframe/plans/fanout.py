"""Fan-out (``foreach``): one report per key value, computed in one pass.

Instead of one query per key, every row gets a ``foreach`` column naming the report it belongs
to; a report is then the group of rows with that key (write with ``partitionBy('foreach')``).
Numbering restarts per report without funnelling a hot key into one task (see
``operators.numbering``). The ordered list of report keys (the domain) is a small separate frame; the
key's own directive chooses among them, all other directives filter the rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.dates import decade_label
from ..ledger import Ledger
from ..operators.filters import SpecError, allow_only, apply_select, without
from ..operators.numbering import number_rows
from . import reports as R

_PERIOD = frozenset({"yyyy", "date_from", "date_to"})


@dataclass(frozen=True)
class Key:
    """A fan-out key: the directives that choose its values, and where a row's value comes from.

    ``column``: of the view. ``of_account``: of the accounts dimension, ``missing`` naming NULL.
    """

    own: frozenset[str]
    column: str | None = None
    of_account: str | None = None
    missing: str | None = None

    def of_row(self) -> Column:
        return F.col(self.column)

    def of_accounts(self) -> Column:
        value = F.col(self.of_account)
        return value if self.missing is None else F.coalesce(value, F.lit(self.missing))


class _Year(Key):
    def of_row(self) -> Column:
        return F.year(self.column).cast("string")


class _Decade(Key):
    def of_row(self) -> Column:
        return decade_label(F.col(self.column))


KEYS: dict[str, Key] = {
    "txntype": Key(frozenset({"txntype"}), "TxnType"),
    "txnclass": Key(frozenset({"txnclass"}), "TxnClass"),
    "era": Key(frozenset({"era"}), "EraName"),
    "account": Key(frozenset({"account"}), "Account", of_account="Account"),
    "account_category": Key(frozenset({"account_category"}), of_account="AccountCategory", missing=S.NO_CATEGORY),
    "account_classification": Key(frozenset({"account_classification"}), of_account="AccountClassification", missing=S.NO_CLASSIFICATION),
    "yyyy": _Year(_PERIOD, "Date"),
    "10y": _Decade(_PERIOD, "Date"),
}
FOREACH_KEYS = tuple(KEYS)


def _key(name: str) -> Key:
    if name not in KEYS:
        raise SpecError(f"foreach: '{name}': unsupported key")
    return KEYS[name]


def _select(spec: Mapping | None) -> dict:
    return dict((spec or {}).get("select") or {})


def with_foreach(ledger: Ledger, view: DataFrame, key: str) -> DataFrame:
    """Add the report key of each row; rows that belong to no report are dropped."""
    k = _key(key)
    if k.column:
        keyed = view.withColumn("foreach", k.of_row())
    else:
        # one row per account: broadcast, as a shuffle by account would put an account's transactions into one task
        keyed = view.join(F.broadcast(ledger.accounts.select("Account", k.of_accounts().alias("foreach"))), "Account")
    return keyed.filter(F.col("foreach").isNotNull())


def domain(ledger: Ledger, spec: Mapping | None, key: str) -> DataFrame:
    """Ordered report keys: (foreach, ord). Eras in interval order, accounts all (also transfer-only).

    Only the key's own directive applies (a NULL attribute matches no condition, as in the rows).
    """
    k = _key(key)
    own = allow_only(_select(spec), k.own)
    if key == "era":
        return apply_select(ledger.eras, own).select(F.col("EraName").alias("foreach"), F.col("era_no").alias("ord"))
    if k.of_account:
        values = apply_select(ledger.accounts, own, ledger.ctx()).select(k.of_accounts().alias("foreach"))
    else:
        values = with_foreach(ledger, apply_select(ledger.view, own, ledger.ctx()), key).select("foreach")
    return values.distinct().withColumn("ord", F.lit(0))


def keyed_view(ledger: Ledger, spec: Mapping | None, key: str) -> DataFrame:
    """Rows of every report of the fan-out, tagged with their report key.

    Each report applies the spec with the key's own directive replaced by the key value, and
    the keys are the domain; so the union is: the spec without the key directive, restricted to
    rows whose key is in the domain.
    """
    k = _key(key)
    rows = with_foreach(ledger, apply_select(ledger.view, without(_select(spec), k.own), ledger.ctx()), key)
    if key != "era" and not k.of_account and not allow_only(_select(spec), k.own):
        return rows  # the domain is every value that a row has
    # one row per report: broadcast, as a shuffle by the key would put a report into one task
    return rows.join(F.broadcast(domain(ledger, spec, key).select("foreach")), "foreach", "left_semi")


def foreach_txns(ledger: Ledger, spec: Mapping | None, key: str) -> DataFrame:
    """Transactions report per key, plain or consolidated: ``foreach``, N restarting per report, the columns."""
    shared = {**(spec or {}), "select": without(_select(spec), _key(key).own)}
    rows, order, columns = R.layout(ledger, keyed_view(ledger, spec, key), shared, by=("foreach",))
    numbered = number_rows(rows, order, "N", partition_by=["foreach"]).select("foreach", "N", *columns)
    shown = R.select_columns(numbered.drop("foreach"), shared.get("columns")).columns
    return numbered.select("foreach", *shown).withColumnRenamed("DateYYYYMM", "Date")


def foreach_accounts(ledger: Ledger, spec: Mapping | None, key: str) -> DataFrame:
    """Accounts report per account category / classification (complement negation kept)."""
    k = _key(key)
    if not k.missing:
        raise SpecError(f"accounts foreach: '{key}': unsupported key")
    chosen = R.filter_accounts(ledger.accounts, allow_only(_select(spec), k.own))
    report = R.accounts_report(ledger, {**(spec or {}), "select": without(_select(spec), k.own)})
    keyed = chosen.select("Account", k.of_accounts().alias("foreach"))
    return report.join(keyed, "Account").select("foreach", *report.columns)


def foreach_pivot(ledger: Ledger, spec: Mapping | None, key: str) -> DataFrame:
    from .pivot import pivot

    return pivot(ledger, spec, foreach=key)
