"""Ledger storage: generations of Parquet tables, committed by one rename, read back for reporting.

A store is a folder. Each import writes its tables under a name of its own (``gen-...``), which nothing reads yet; the
commit is the rename of a manifest to the next number, which lists the folders of every table. A reader takes the manifest
of the highest number, so it sees a whole generation or the one before, whatever fails or runs beside it; two writers that
start from the same manifest cannot both commit. An append writes the new facts only, as a further folder of ``Txns``, and
derives the dimensions anew from all stored facts.

``Txns`` is written in import (N) order: the numbering step range-partitions by date, so each file covers a narrow date range
and date filters skip row groups by their min/max statistics.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..ledger import Ledger
from ..operators.ledger import conform
from ..operators.numbering import attach_numbers, offsets_of, tag_positions
from ..session import DENSE, cut_lineage, hadoop_path, write_counted

STORED_TABLES = ("Txns", "TxnsOffsets", "TxnsInv", "Accounts", "Payees", "Categories", "Eras", "Loans", "AccountBalances", "CategoryBalances")
TXN_COLUMNS = [f.name for f in S.TXNS.fields if f.name != "N"]
IMPORT_ORDER = ("__nr_pid", "__nr_pos")
#: Range partitions of a generation lie between this and the next multiple, so rows of later generations come later.
PARTITIONS = 1 << 20
MANIFEST = "manifest-"


class CommitError(RuntimeError):
    """Another writer has committed since this one started."""


def _join(path: str, *names: str) -> str:
    return "/".join([path.rstrip("/"), *names]) if "://" in path else os.path.join(path, *names)


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, list[str]]]:
    """(number, table -> folders) of the last committed generation; (0, {}) where nothing has been committed."""
    fs, folder = hadoop_path(spark, path)
    if not fs.exists(folder):
        return 0, {}
    numbers = [int(n.removeprefix(MANIFEST).removesuffix(".json")) for n in (f.getPath().getName() for f in fs.listStatus(folder)) if n.startswith(MANIFEST)]
    if not numbers:
        return 0, {}
    text = spark.read.text(_join(path, f"{MANIFEST}{max(numbers):08d}.json"), wholetext=True).first().value
    return max(numbers), json.loads(text)


def commit(spark: SparkSession, path: str, number: int, tables: Mapping[str, list[str]]) -> None:
    """Make ``tables`` the generation ``number``: a manifest under a temporary name, renamed once it is whole."""
    fs, temporary = hadoop_path(spark, _join(path, f".{uuid.uuid4().hex}.tmp"))
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(tables, indent=1).encode()))
    out.close()
    _, final = hadoop_path(spark, _join(path, f"{MANIFEST}{number:08d}.json"))
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise CommitError(f"generation {number} of '{path}' has been committed by another writer")


def write_ledger(ledger: Ledger, path: str) -> dict[str, str]:
    """Write a ledger's tables as a new generation that takes the place of the last. Returns table -> location."""
    number, _ = manifest(ledger.spark, path)
    return {k: v[-1] for k, v in _write(ledger, path, number + 1, []).items()}


def append_ledger(ledger: Ledger, path: str) -> dict[str, list[str]]:
    """Add a ledger's transactions to the stored ones as a further generation: they are numbered after those, and the
    dimensions are derived from all. The other tables are the new ledger's. Returns table -> locations."""
    number, tables = manifest(ledger.spark, path)
    return _write(ledger, path, number + 1, tables.get("Txns", []))


def _write(ledger: Ledger, path: str, number: int, earlier: list[str]) -> dict[str, list[str]]:
    """The fact table is written once, in import order: range-partitioned on the import order with each row's
    (partition, position); a tiny ``TxnsOffsets`` table turns those into N on read (see ``operators.numbering``), so
    facts are never rewritten just to add N. The dimensions are then aggregated from the *written* facts."""
    spark = ledger.spark
    folder = _join(path, f"gen-{number:08d}-{uuid.uuid4().hex[:8]}")
    out = {"Txns": [*earlier, _join(folder, "Txns")]}
    # facts from the source joins are materialized once (the range sampling pass and the shuffle
    # pass would otherwise both run the joins); stored facts (with N) are re-ordered by N
    stored = set(IMPORT_ORDER) <= set(ledger.txns.columns)
    if stored:
        src = ledger.txns.withColumnsRenamed({c: f"_{c}" for c in IMPORT_ORDER})
    else:
        src = conform_keep(ledger.txns, ledger.order_key)
        src = src if ledger.facts_stored else cut_lineage(src, "facts", DENSE)
    order = [f"_{c}" for c in IMPORT_ORDER] if stored else list(ledger.order_key)
    tag_positions(src, order, path=out["Txns"][-1], keep=TXN_COLUMNS, first_partition=number * PARTITIONS)
    facts = spark.read.parquet(*out["Txns"])
    derived = ledger.over(facts, IMPORT_ORDER)
    tables: Mapping[str, DataFrame] = {
        "TxnsOffsets": offsets_of(facts),
        "Accounts": conform(derived.accounts, S.ACCOUNTS),
        "Payees": conform(derived.payees, S.PAYEES),
        "Categories": conform(derived.categories, S.CATEGORIES),
        "Eras": derived.eras,
        **derived.other_tables(),
    }
    for name, df in tables.items():
        out[name] = [_join(folder, name)]
        df.write.mode("errorifexists").parquet(out[name][0])
    commit(spark, path, number, out)
    return out


def drop_unlisted(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders that the last manifest does not list (earlier generations, failed writes); their names."""
    _, tables = manifest(spark, path)
    listed = {folder.rstrip("/").rsplit("/", 2)[-2] for folders in tables.values() for folder in folders}
    fs, top = hadoop_path(spark, path)
    gone = [f.getPath() for f in fs.listStatus(top) if f.getPath().getName().startswith("gen-") and f.getPath().getName() not in listed]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)


class StoredLedger(Ledger):
    """The last committed generation of a store (S9); reports run on it exactly as on a built ledger."""

    def __init__(self, spark: SparkSession, path: str, config: Mapping | None = None) -> None:
        self.path = path
        self.generation, folders = manifest(spark, path)
        missing = [t for t in STORED_TABLES if not folders.get(t)]
        if missing:
            raise FileNotFoundError(f"ledger at '{path}' lacks tables: {missing}")
        self.stored = {t: spark.read.parquet(*folders[t]) for t in STORED_TABLES}
        # (partition, position) of the stored facts is the import order: reports sort on it and
        # N is attached (a broadcast of the per-partition offsets) only where it is shown
        super().__init__(spark, self.stored["Txns"], config, order_key=IMPORT_ORDER, txns_inv=self.stored["TxnsInv"], loans=self.stored["Loans"])
        self.__dict__["txns"] = self.stored["Txns"]
        self.__dict__["accounts"] = self.stored["Accounts"]
        self.__dict__["payees"] = self.stored["Payees"]
        self.__dict__["categories"] = self.stored["Categories"]
        self.__dict__["eras"] = self.stored["Eras"]

    def txns_numbered(self, materialize_input: bool = False) -> DataFrame:
        return conform(attach_numbers(self.stored["Txns"], self.stored["TxnsOffsets"], "N"), S.TXNS)

    def other_tables(self) -> dict[str, DataFrame]:
        return {t: self.stored[t] for t in ("TxnsInv", "Loans", "AccountBalances", "CategoryBalances")}

    def tables(self) -> dict[str, DataFrame]:
        """All nine tables as stored, the transactions with N."""
        return {"Txns": self.txns_numbered(), **{t: self.stored[t] for t in STORED_TABLES if not t.startswith("Txns") or t == "TxnsInv"}}


def conform_keep(df: DataFrame, order_key) -> DataFrame:
    """Ledger fact columns (typed as the schema) plus the columns the import order needs."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.TXNS.fields if f.name != "N"]
    extra = [c for c in order_key if c not in TXN_COLUMNS and c in have]
    return df.select(*cols, *extra)


def read_ledger(spark: SparkSession, path: str, config: Mapping | None = None) -> StoredLedger:
    return StoredLedger(spark, path, config)


def write_reports(reports: Mapping[str, DataFrame], path: str, skip_empty: bool = True, fmt: str = "parquet") -> dict[str, str]:
    """One dataset per report, under its display names; empty ones are skipped.

    A fan-out report (with a ``foreach`` column) is written partitioned by that column: its rows are dealt
    out by key and by a range of its numbers, so a key's files do not multiply with the tasks and a
    large key still has several writers.
    """
    from ..plans.reports import display

    written = {}
    for name, df in reports.items():
        loc, shown = _join(path, name), display(df)
        by = ["foreach"] if "foreach" in shown.columns else []
        if by:
            shown = shown.repartitionByRange("foreach", *(c for c in ("N",) if c in shown.columns))

        def save(rows: DataFrame, loc: str = loc, by: list[str] = by) -> None:
            rows.write.mode("overwrite").partitionBy(*by).format(fmt).option("header", True).save(loc)

        # counted as it is written: a report's plan runs once, and an empty one leaves nothing
        if write_counted(shown, loc, save, keep_empty=not skip_empty) or not skip_empty:
            written[name] = loc
    return written
