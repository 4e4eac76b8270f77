"""Bind the star-schema test tables to the ledger model.

The driver's test data is a TPC-H-like star schema. It is mapped onto the ledger like this
(the same mapping is written as SQL in ``tallyframe.plans.oracle`` for the DuckDB check):

* one transaction per line item, dated by its ship date, booked to the customer's nation;
* payee = supplier, category = part type, subcategory = part brand (none when size % 5 = 0);
* line number 7 is a transfer to the supplier's nation (category ``Transfer To``);
* amount = +price for PROMO parts and returned lines, else -price (an expense);
* memo = part name when the line has a discount, C = line status.

Accounts are configured from nation/region: region 0-2 are Assets, 3 Liabilities, 4 has no
classification. Eras and category types/classes are a fixed config (see ``LEDGER_CONFIG``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MONEY
from ..session import DENSE, cut_lineage

# --- fixed values of the test binding --------------------------------------------------------
TRANSFER_LINE = 7
LEDGER_CONFIG = {
    # declared out of date order on purpose: eras are sorted by their dates, not by name
    "eras": {
        "Era C": {"date_to": "1996"},
        "Era B": {"date_to": "1998"},
        "Era A": {"date_to": "..."},
    },
    "category_types": {"Income": ["PROMO"]},
    "category_classes": {"Essential": ["STANDARD", "MEDIUM:Brand#1"]},
    "account_categories": {
        "Assets": ["AFRICA", "AMERICA", "ASIA"],
        "Liabilities": ["EUROPE"],
    },
}
# ---------------------------------------------------------------------------------------------

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def money(c: Column) -> Column:
    return c.cast(MONEY)


def bound_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items joined to every dimension the ledger needs, projected to the used columns.

    Orders, customers and parts grow with the line items: those joins are sort-merge joins at every size, so no plan rests on a
    broadcast that larger tables outgrow. Customers join the orders first, and only numbers travel through the shuffles of the
    lines: names are looked up last.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_linestatus",
        money(F.col("l_extendedprice")).alias("price"),
        F.to_date("l_shipdate").alias("shipped"),
        (F.col("l_discount") == 0).alias("full_price"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )
    # nation holds 25 rows by the schema's definition: a safe broadcast
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders = orders.join(cust.hint("merge"), orders.o_custkey == cust.c_custkey).select("o_orderkey", "c_nationkey")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return (
        li.join(orders.hint("merge"), li.l_orderkey == orders.o_orderkey)
        .join(part.hint("merge"), li.l_partkey == part.p_partkey)
        .join(supp, li.l_suppkey == supp.s_suppkey)
        .join(nation.withColumnsRenamed({"n_nationkey": "c_nation_no", "n_name": "c_nation"}), F.col("c_nationkey") == F.col("c_nation_no"))
        .join(nation.withColumnsRenamed({"n_nationkey": "s_nation_no", "n_name": "s_nation"}), F.col("s_nationkey") == F.col("s_nation_no"))
    )


def raw_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as an account export would deliver them (transfers not yet tagged).

    ``SrcOrder``/``SrcLine`` keep the source position; they break ties when numbering. The joined lines are stored once per
    session: every dimension of a ledger is an aggregate of them, and would join the tables again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        _FACTS[key] = cut_lineage(_facts(spark, sf_dir), "facts", DENSE)
    return _FACTS[key].select(
        F.col("SrcOrder").cast("string").alias("Num"),
        "Date",
        "Account",
        "Payee",
        "Category",
        "Subcategory",
        "Amount",
        "C",
        F.lit(None).cast("string").alias("Split"),
        "Memo",
        "SrcOrder",
        "SrcLine",
    )


_FACTS: dict[tuple[str, str], DataFrame] = {}
_TOTALS: dict[tuple[str, str], DataFrame] = {}


def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions' amounts added up by category, as transactions: what reports by category show of them. Where the facts
    are not stored yet they need not be for it, and the joins carry only what the totals ask."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TOTALS:
        facts = _FACTS[key] if key in _FACTS else _facts(spark, sf_dir)
        _TOTALS[key] = cut_lineage(facts.groupBy("Category", "Subcategory").agg(F.sum("Amount").alias("Amount")), "totals")
    none = {c: F.lit(None).cast(t) for c, t in {"Num": "string", "Date": "date", "Account": "string", "Payee": "string", "C": "string", "Split": "string", "Memo": "string"}.items()}
    return _TOTALS[key].withColumns(none)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bound_lines(spark, sf_dir)
    xfer = F.col("l_linenumber") == TRANSFER_LINE
    sign = F.when((F.col("p_type") == "PROMO") | F.col("returned"), F.lit(1)).otherwise(F.lit(-1))
    return b.select(
        F.col("shipped").alias("Date"),
        F.col("c_nation").alias("Account"),
        F.when(xfer, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("Payee"),
        F.when(xfer, F.lit("Transfer To")).otherwise(F.col("p_type")).alias("Category"),
        F.when(xfer, F.col("s_nation"))
        .when(F.col("p_size") % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("p_brand"))
        .alias("Subcategory"),
        money(sign * F.col("price")).alias("Amount"),
        F.col("l_linestatus").alias("C"),
        F.when(F.col("full_price"), F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("Memo"),
        F.col("l_orderkey").alias("SrcOrder"),
        F.col("l_linenumber").alias("SrcLine"),
    )


def account_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-account configured category (region name), derived from nation x region."""
    nation = read_table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return F.broadcast(nation).join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("Account"), F.col("r_name").alias("category")
    )


def order_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second transactions source: one transaction per order, payee = customer, category =
    customer nation + segment, subcategory = the customer's balance band (thousands)."""
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("Num"),
        F.to_date("o_orderdate").alias("Date"),
        F.col("n_name").alias("Account"),
        F.col("c_name").alias("Payee"),
        F.concat(F.col("n_name"), F.lit(" "), F.col("c_mktsegment")).alias("Category"),
        F.floor(F.col("c_acctbal") / 1000).cast("string").alias("Subcategory"),
        money(-F.col("o_totalprice")).alias("Amount"),
        F.col("o_orderstatus").alias("C"),
        F.lit(None).cast("string").alias("Split"),
        F.lit(None).cast("string").alias("Memo"),
        F.col("o_orderkey").alias("SrcOrder"),
        F.lit(0).alias("SrcLine"),
        F.to_date("o_orderdate").alias("SrcDate"),
    )
