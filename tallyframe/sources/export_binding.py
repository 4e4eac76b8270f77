"""Export *files* derived from the star-schema test tables, as line tables.

The ingestion operators need messy delimited exports. These are rendered from the test tables
by Spark (so their size grows with the data) into the same (file, line_no, line) shape that
``sources.exports.read_lines`` produces from real files:

* account transactions: one file per 1000 order keys; every order is a dated row (payee =
  customer, account = customer nation, memo = priority) followed by its line items as undated
  split rows (category ``type : brand``, signed price); ``P``/``1-URGENT`` orders are voided;
  amounts are written as ``$1,234.56`` / ``(1,234.56)``; a preamble, a blank line, an extra
  column and a ``Grand Total`` footer are included.
* account balances: region sections (Assets: regions 0-2, Liabilities: 3-4) holding one row per
  nation with the sum of its suppliers' balances, ``Total`` rows and a ``Net Worth`` footer.
* income and spending: ``Income Categories`` / ``Expense Categories`` / ``Transfers`` sections
  over the ledger's categories with their totals, and a ``Grand Total`` footer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import MONEY
from .binding import read_table

# --- fixed values of the rendered exports ----------------------------------------------------
TXN_PREAMBLE = ("Account transactions", "All accounts", "Converted to base currency: US dollar", "1/1/1995 through 12/31/2001", "")
TXN_HEADER = "Num,Date,Payee,Account,Memo,Category,Amount,C,Running Balance"
ORDERS_PER_FILE = 1000
BAL_PREAMBLE = ("Account balances", "Converted to base currency: US dollar", "As of 12/31/2001")
BAL_HEADER = "Account,Total"
SPEND_PREAMBLE = ("Income and spending", "Converted to base currency: US dollar", "1/1/1995 through 12/31/2001")
SPEND_HEADER = "Category,Total"
SPEND_SECTIONS = (("Income", "Income Categories"), ("Expense", "Expense Categories"), ("Transfer", "Transfers"))
MONTHLY_PREAMBLE = ("Monthly income and expenses", "Converted to base currency: US dollar", "1/1/1995 through 12/31/2001")
MONTHLY_SECTIONS = (("Income", "Income"), ("Expense", "Expenses"), ("Transfer", "Transfers"))
MONTHLY_FOOTER = "Income less Expenses"
# ---------------------------------------------------------------------------------------------


def q(c: Column) -> Column:
    """CSV field: quoted (quotes doubled) only when it holds a comma or a quote; NULL -> empty."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    return F.coalesce(F.when(c.rlike('[",]'), quoted).otherwise(c), F.lit(""))


def money_text(x: Column) -> Column:
    """``$1,234.56`` for positive, ``(1,234.56)`` for negative amounts."""
    return F.when(x < 0, F.concat(F.lit("("), F.format_number(-x, 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(x, 2)))


def csv_line(*fields: Column) -> Column:
    return F.concat_ws(",", *[q(f) for f in fields])


def _preamble(files: DataFrame, lines: tuple[str, ...], header: str) -> DataFrame:
    arr = F.array(*[F.lit(s) for s in (*lines, header)])
    return files.select("file", F.posexplode(arr).alias("pos", "line")).select("file", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def txn_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of the transactions export before rendering (key, kind, fields...): what the rendering can derive from
    them (the file, the shown number and date) does not travel with them."""
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    # customers and parts grow with the orders and their lines: sort-merge joins at every size
    cust, orders = cust.hint("merge"), orders.hint("merge")
    void = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    parents = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        F.col("o_orderkey").alias("okey"),
        F.lit(0).alias("kind"),
        F.lit(0).alias("lnum"),
        F.lit(0).cast("long").alias("t1"),
        F.lit(0).cast("long").alias("t2"),
        F.to_date("o_orderdate").alias("Date"),
        F.col("c_name").alias("Payee"),
        F.col("n_name").alias("Account"),
        F.col("o_orderpriority").alias("Memo"),
        F.lit("ORDER").alias("Category"),
        (-F.col("o_totalprice")).cast(MONEY).alias("amt"),
        F.col("o_orderstatus").alias("C"),
        void.alias("void"),
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus"
    )
    sign = F.when((F.col("p_type") == "PROMO") | (F.col("l_returnflag") == "R"), F.lit(1)).otherwise(F.lit(-1))
    children = li.join(part.hint("merge"), li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("okey"),
        F.lit(1).alias("kind"),
        F.col("l_linenumber").alias("lnum"),
        F.col("l_partkey").alias("t1"),
        F.col("l_suppkey").alias("t2"),
        F.lit(None).cast("date").alias("Date"),
        F.lit(None).cast("string").alias("Payee"),
        F.lit(None).cast("string").alias("Account"),
        F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).alias("Memo"),
        F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(F.concat(F.col("p_type"), F.lit(" : "), F.col("p_brand"))).alias("Category"),
        (sign * F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("amt"),
        F.col("l_linestatus").alias("C"),
        F.lit(None).cast("boolean").alias("void"),
    )
    return parents.unionByName(children)


def txn_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered account-transactions exports: (file, line_no, line, modified). The lines of a file lie in one partition."""
    u = txn_export_rows(spark, sf_dir).withColumn("_file", F.floor(F.col("okey") / ORDERS_PER_FILE))
    w = Window.partitionBy("_file").orderBy("okey", "kind", "lnum", "t1", "t2", "amt", "Memo", "C", "Category")
    ordw, filew = Window.partitionBy("_file", "okey"), Window.partitionBy("_file")
    u = (
        u.withColumn("_at", F.row_number().over(w).cast("long"))
        .withColumn("_parts", F.count_if(F.col("kind") == 1).over(ordw))
        .withColumn("_void", F.max(F.coalesce(F.col("void"), F.lit(False))).over(ordw))
    )
    counted = ~F.col("_void") & ((F.col("kind") == 1) | (F.col("_parts") == 0))
    u = u.withColumn("_t", F.sum(F.when(counted, F.col("amt"))).over(filew)).withColumn("_last", F.max("_at").over(filew))
    # a file's first row brings the lines above it, its last one the footer: the rows are made and gathered by file once
    above = (*TXN_PREAMBLE, TXN_HEADER)
    num = F.when(F.col("kind") == 0, F.when(F.col("void"), F.lit("**VOID**")).otherwise(F.col("okey").cast("string")))
    body = csv_line(num, F.date_format("Date", "yyyy-MM-dd"), F.col("Payee"), F.col("Account"), F.col("Memo"), F.col("Category"), money_text(F.col("amt")), F.col("C"), F.lit(None))
    footer = F.concat_ws(",", F.lit("Grand Total"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(""), q(money_text(F.coalesce(F.col("_t"), F.lit(0).cast(MONEY)))), F.lit(""), F.lit(""))
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.when(F.col("_at") == 1, F.array(*[F.lit(s) for s in above])).otherwise(none),
        F.array(body),
        F.when(F.col("_at") == F.col("_last"), F.array(footer)).otherwise(none),
    )
    first = F.when(F.col("_at") == 1, F.lit(1)).otherwise(F.col("_at") + len(above)).cast("long")
    file = F.concat(F.lit("txns_"), F.col("_file").cast("string")).alias("file")
    rows = u.select(file, first.alias("_first"), F.posexplode(lines).alias("pos", "line"))
    return rows.select("file", (F.col("_first") + F.col("pos")).alias("line_no"), "line", F.lit(None).cast("timestamp").alias("modified"))


def balance_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered account-balances export (one file): region sections under Assets / Liabilities."""
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    supp = read_table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sum(F.col("s_acctbal").cast(MONEY)).alias("bal"))
    rows = (
        F.broadcast(nation)
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(supp, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .select(
            F.when(F.col("r_regionkey") <= 2, F.lit("Assets")).otherwise(F.lit("Liabilities")).alias("typ"),
            F.when(F.col("r_regionkey") <= 2, F.lit(0)).otherwise(F.lit(1)).alias("t_ord"),
            "r_regionkey",
            F.col("r_name").alias("sub"),
            F.col("n_name").alias("name"),
            F.col("n_nationkey").alias("n_ord"),
            F.coalesce(F.col("bal"), F.lit(0).cast(MONEY)).alias("bal"),
        )
    )
    # a section's lines: header (0), items (1), its total (2); a type's total sorts after its subtypes
    sub_tot = rows.groupBy("typ", "t_ord", "r_regionkey", "sub").agg(F.sum("bal").alias("bal"))
    typ_tot = rows.groupBy("typ", "t_ord").agg(F.sum("bal").alias("bal"))
    net = rows.agg(F.sum(F.when(F.col("typ") == "Assets", F.col("bal")).otherwise(-F.col("bal"))).alias("bal"))
    parts = [
        typ_tot.select(F.col("typ").alias("name"), F.lit(None).cast(MONEY).alias("bal"), F.array(F.col("t_ord"), F.lit(-1), F.lit(0), F.lit(0)).alias("k")),
        sub_tot.select(F.col("sub").alias("name"), F.lit(None).cast(MONEY).alias("bal"), F.array(F.col("t_ord"), F.col("r_regionkey"), F.lit(0), F.lit(0)).alias("k")),
        rows.select("name", "bal", F.array(F.col("t_ord"), F.col("r_regionkey"), F.lit(1), F.col("n_ord")).alias("k")),
        sub_tot.select(F.concat(F.lit("Total "), F.col("sub")).alias("name"), "bal", F.array(F.col("t_ord"), F.col("r_regionkey"), F.lit(2), F.lit(0)).alias("k")),
        typ_tot.select(F.concat(F.lit("Total "), F.col("typ")).alias("name"), "bal", F.array(F.col("t_ord"), F.lit(99), F.lit(0), F.lit(0)).alias("k")),
        net.select(F.lit("Net Worth").alias("name"), "bal", F.array(F.lit(9), F.lit(0), F.lit(0), F.lit(0)).alias("k")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.withColumn("file", F.lit("balances"))
    pre = len(BAL_PREAMBLE) + 1
    w = Window.partitionBy("file").orderBy("k")
    body = u.select("file", (F.row_number().over(w) + pre).cast("long").alias("line_no"), csv_line(F.col("name"), F.when(F.col("bal").isNotNull(), F.format_number(F.col("bal"), 2))).alias("line"))
    head = _preamble(u.select("file").distinct(), BAL_PREAMBLE, BAL_HEADER)
    return head.unionByName(body).withColumn("modified", F.lit(None).cast("timestamp"))


def spending_export_lines(view: DataFrame, monthly: bool = False) -> DataFrame:
    """Rendered income-and-spending export over an enriched ledger view (one file).

    Expenses are shown positive (as the export tool does); Grand Total = income - expenses +
    transfers.
    """
    cats = view.groupBy("TxnType", "CategorySubcategory", "Category").agg(F.sum("Amount").alias("amt"))
    sec_ord = F.when(F.col("TxnType") == "Income", F.lit(0)).when(F.col("TxnType") == "Expense", F.lit(1)).otherwise(F.lit(2))
    sections = MONTHLY_SECTIONS if monthly else SPEND_SECTIONS
    sec_name = F.when(F.col("TxnType") == "Income", F.lit(sections[0][1])).when(F.col("TxnType") == "Expense", F.lit(sections[1][1])).otherwise(F.lit(sections[2][1]))
    shown = F.when(F.col("TxnType") == "Expense", -F.col("amt")).otherwise(F.col("amt")).cast("decimal(25,4)")
    items = cats.select(
        F.coalesce(F.col("CategorySubcategory"), F.concat(F.col("Category"), F.lit(" (transfers)"))).alias("name"),
        shown.alias("val"),
        sec_ord.alias("s"),
        sec_name.alias("sec"),
    )
    items = items.groupBy("name", "s", "sec").agg(F.sum("val").alias("val"))
    secs = items.groupBy("s", "sec").agg(F.sum("val").alias("val"))
    grand = items.agg(F.sum(F.when(F.col("s") == 1, -F.col("val")).otherwise(F.col("val"))).alias("val"))
    parts = [
        secs.select(F.col("sec").alias("name"), F.lit(None).cast("decimal(25,4)").alias("val"), F.array(F.col("s"), F.lit(0)).alias("k"), F.lit("").alias("nk")),
        items.select("name", "val", F.array(F.col("s"), F.lit(1)).alias("k"), F.col("name").alias("nk")),
        secs.select(F.concat(F.lit("Total "), F.col("sec")).alias("name"), "val", F.array(F.col("s"), F.lit(2)).alias("k"), F.lit("").alias("nk")),
        grand.select(F.lit(MONTHLY_FOOTER if monthly else "Grand Total").alias("name"), "val", F.array(F.lit(9), F.lit(0)).alias("k"), F.lit("").alias("nk")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.withColumn("file", F.lit("monthly" if monthly else "spending"))
    preamble = MONTHLY_PREAMBLE if monthly else SPEND_PREAMBLE
    pre = len(preamble) + 1
    w = Window.partitionBy("file").orderBy("k", "nk")
    body = u.select("file", (F.row_number().over(w) + pre).cast("long").alias("line_no"), csv_line(F.col("name"), F.when(F.col("val").isNotNull(), F.format_number(F.col("val"), 2))).alias("line"))
    head = _preamble(u.select("file").distinct(), preamble, SPEND_HEADER)
    return head.unionByName(body).withColumn("modified", F.lit(None).cast("timestamp"))


# --- as-of snapshots, loans, investment transactions -----------------------------------------
ASOF_A = (("01/01/1995", "1995-01-01"), ("12/31/1997", "1997-12-31"), ("12/31/1998", "1998-12-31"))
ASOF_B = (("12/31/1998", "1998-12-31"), ("12/31/1999", "1999-12-31"))
LOAN_HEADER_1 = ",,,,,,Balloon,,,,,,,,,"
LOAN_HEADER_2 = "Loan,Amount,Rate,Length,Interest,Frequency,Amount,category,Payee,Payment,Fees,Type,Interest,Balance,Abbreviation,Number"


def _order_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        F.col("n_name").alias("Account"), "n_regionkey", F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").cast(MONEY).alias("p"), "o_orderstatus"
    )


def asof_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two wide as-of balance reports (one column per ``MM/DD/YYYY``), as parsed exports would be.

    A: per nation, total order value up to each date. B (later): the same over finished orders
    only, plus one row per region - accounts that have no transactions.
    """
    o = _order_amounts(spark, sf_dir)

    def upto(dates):
        return [F.sum(F.when(F.col("d") <= F.lit(iso).cast("date"), F.col("p"))).alias(name) for name, iso in dates]

    a = o.groupBy("Account").agg(*upto(ASOF_A))
    fin = o.filter(F.col("o_orderstatus") == "F")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    b_nation = fin.groupBy("Account").agg(*upto(ASOF_B))
    b_region = fin.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("Account")).agg(*upto(ASOF_B))
    return a, b_nation.unionByName(b_region)


def category_snapshots(view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two wide yearly category reports (1995-1998 and 1998-2001) over the ledger view."""

    def report(years):
        return view.groupBy("Category", "Subcategory", "TxnType").agg(
            *[F.sum(F.when(F.year("Date") == y, F.col("Amount"))).alias(f"12/31/{y}") for y in years]
        )

    return report(range(1995, 1999)), report(range(1998, 2002))


def loan_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan-terms export (two header rows): one loan per market segment with its terms, then one
    child row per nation (payee) of the segment's customers carrying a category."""
    cust = read_table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", F.col("c_acctbal").cast(MONEY).alias("bal"))
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    loans = cust.groupBy("c_mktsegment").agg(F.sum(F.abs("bal")).alias("amt"), F.count(F.lit(1)).alias("n"))
    loan_lines = loans.select(
        F.col("c_mktsegment").alias("seg"),
        F.lit("").alias("nk"),
        csv_line(
            F.col("c_mktsegment"), F.format_number("amt", 2), F.lit("5.25%"), F.concat(F.col("n").cast("string"), F.lit(" months")), F.format_number(F.col("amt"), 2),
            F.lit("Monthly"), F.lit(""), F.lit("Loan : Interest"), F.concat(F.lit("Bank of "), F.col("c_mktsegment")), F.format_number(F.col("n") * 100, 2),
            F.lit("10.00"), F.lit("Fixed"), F.lit("Compound"), F.format_number("amt", 2), F.substring("c_mktsegment", 1, 3), F.col("n").cast("string"),
        ).alias("line"),
    )
    kids = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"))
    kid_lines = kids.select(
        F.col("c_mktsegment").alias("seg"),
        F.col("n_name").alias("nk"),
        csv_line(*[F.lit(None)] * 7, F.concat(F.lit("Loan : "), F.col("n_name")), F.col("n_name"), *[F.lit(None)] * 7).alias("line"),
    )
    u = loan_lines.unionByName(kid_lines).withColumn("file", F.lit("loans"))
    w = Window.partitionBy("file").orderBy("seg", "nk")
    body = u.select("file", (F.row_number().over(w) + 5).cast("long").alias("line_no"), "line")
    head = _preamble(u.select("file").distinct(), ("Loan terms", "As of 06/30/2001"), LOAN_HEADER_1)
    head = head.unionByName(u.select("file").distinct().select("file", F.lit(4).cast("long").alias("line_no"), F.lit(LOAN_HEADER_2).alias("line")))
    return head.unionByName(body).withColumn("modified", F.lit(None).cast("timestamp"))


def investment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investment-transaction export rows (as text) from the event stream table."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.lit("investments").alias("file"),
        F.col("event_id").alias("line_no"),
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.concat(F.lit("USER_"), F.col("user_id").cast("string")).alias("Account"),
        F.col("event_type").alias("Investment"),
        F.when(F.col("value") > 250, F.lit("Sell")).otherwise(F.lit("Buy")).alias("Activity"),
        F.lit("1").alias("Quantity"),
        F.format_number("value", 2).alias("Price"),
        F.lit("0.00").alias("Commission"),
        F.format_number("value", 2).alias("Total"),
        F.when(F.col("event_type") == "purchase", F.lit("NATION_0")).alias("Transfer Account"),
        F.concat(F.lit("Investment : "), F.col("event_type")).alias("Category"),
        F.lit(None).cast("string").alias("C"),
        F.lit(None).cast("string").alias("Memo"),
    )


INV_HEADER = "Date,Account,Investment,Activity,Quantity,Price,Commission,Total,Transfer Account,Category,C,Memo"
DETAILS_PREAMBLE = ("Account details", "All accounts", "As of 06/30/2001")
DETAILS_HEADER = "Account,Abbreviation,Balance,Bank Name,Account Number,Limit,Balance"


def investment_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investment-transactions exports, one file per 10,000 events."""
    rows = investment_rows(spark, sf_dir).withColumn("file", F.concat(F.lit("investments_"), F.floor(F.col("line_no") / 10_000).cast("string")))
    w = Window.partitionBy("file").orderBy("line_no")
    fields = [F.col(f"`{c}`") for c in INV_HEADER.split(",")]
    body = rows.select("file", (F.row_number().over(w) + 2).cast("long").alias("line_no"), csv_line(*fields).alias("line"))
    head = _preamble(rows.select("file").distinct(), ("Investment transactions",), INV_HEADER)
    return head.unionByName(body).withColumn("modified", F.lit(None).cast("timestamp"))


def details_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-details export: one row per nation with its customers' balances as limit, opening and as-of balance."""
    region = F.broadcast(read_table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    cust = read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast(MONEY)).alias("bal"), F.count(F.lit(1)).alias("n"))
    rows = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("file", F.lit("details"))
    line = csv_line(
        F.col("n_name"), F.substring("n_name", 1, 3), money_text(F.col("n").cast(MONEY)), F.concat(F.lit("Bank of "), F.col("r_name")),
        F.col("n_nationkey").cast("string"), F.lit(None).cast("string"), money_text(F.col("bal")),
    )
    w = Window.partitionBy("file").orderBy("n_nationkey")
    body = rows.select("file", (F.row_number().over(w) + len(DETAILS_PREAMBLE) + 1).cast("long").alias("line_no"), line.alias("line"))
    head = _preamble(rows.select("file").distinct(), DETAILS_PREAMBLE, DETAILS_HEADER)
    return head.unionByName(body).withColumn("modified", F.lit(None).cast("timestamp"))


ASOF_YEARS = tuple(range(1995, 2002))


def yearly_balance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balances export per year end (order value of each nation up to then), under preambles of growing length; one
    that names no day, and a letter."""
    o = _order_amounts(spark, sf_dir)
    per = [o.filter(F.col("d") <= F.lit(f"{y}-12-31").cast("date")).groupBy("Account").agg(F.sum("p").alias("bal")).withColumn("y", F.lit(y)) for y in ASOF_YEARS]
    items = per[0]
    for p in per[1:]:
        items = items.unionByName(p)
    items = items.withColumn("file", F.concat(F.lit("balances_"), F.col("y").cast("string")))
    items = items.unionByName(items.filter(F.col("y") == ASOF_YEARS[-1]).withColumn("file", F.lit("balances_undated")))
    files = items.groupBy("file", "y").agg(F.sum("bal").alias("bal"))

    def part(frame: DataFrame, name: Column, total: Column, rank: int) -> DataFrame:
        return frame.select("file", F.lit(rank).alias("r"), name.alias("name"), csv_line(name, total).alias("line"))

    none = F.lit(None).cast("string")
    body = part(files, F.lit("Assets"), none, 1).unionByName(part(files, F.lit("Nations"), none, 2))
    body = body.unionByName(part(items, F.col("Account"), F.format_number("bal", 2), 3))
    for rank, name in ((4, "Total Nations"), (5, "Total Assets"), (6, "Net Worth")):
        body = body.unionByName(part(files, F.lit(name), F.format_number("bal", 2), rank))
    above = F.concat(
        F.array(F.lit("Account balances")),
        F.array_repeat(F.lit("Converted to base currency: US dollar"), (F.col("y") - 1990).cast("int")),
        F.when(F.col("file") == "balances_undated", F.array(F.lit("Undated"))).otherwise(F.array(F.concat(F.lit("As of 12/31/"), F.col("y").cast("string")))),
        F.array(F.lit(BAL_HEADER)),
    )
    head = files.select("file", F.posexplode(above).alias("p", "line")).select("file", F.lit(0).alias("r"), F.format_string("%04d", "p").alias("name"), "line")
    letter = files.filter(F.col("file") == "balances_undated").select(F.lit("letter").alias("file"), F.lit(0).alias("r"), F.lit("").alias("name"), F.lit("Dear customer").alias("line"))
    w = Window.partitionBy("file").orderBy("r", "name")
    rows = head.unionByName(body).unionByName(letter)
    return rows.select("file", F.row_number().over(w).cast("long").alias("line_no"), "line").withColumn("modified", F.lit(None).cast("timestamp"))


def write_files(lines: DataFrame, path: str, gathered: bool = False, mode: str = "overwrite") -> str:
    """A line table as text files, one per export (in folders ``file=<name>``); returns the pattern that finds them.
    ``gathered``: the lines of a file lie in one partition already and are not shuffled again."""
    rows = (lines if gathered else lines.repartition("file")).sortWithinPartitions("file", "line_no").select("file", "line")
    rows.write.mode(mode).partitionBy("file").text(path)
    return f"{path.rstrip('/')}/*/*"


def file_label(path: Column) -> Column:
    """The export's name in the path of a file written by ``write_files``."""
    return F.regexp_extract(path, "file=([^/]+)/", 1)
