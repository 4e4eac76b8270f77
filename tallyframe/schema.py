"""Ledger schema: table layouts and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 4)

# --- fixed values (must equal the original tool's vocabulary) -------------------------------
# Categories the export tool assigns to account transfers.
TRANSFER_CATEGORIES = (
    "Buy Investment/CD",
    "Credit Card Payment",
    "Principal Transfer",
    "Transfer From",
    "Transfer To",
)
# Transaction types and classes.
TXNTYPE_INCOME, TXNTYPE_EXPENSE, TXNTYPE_TRANSFER, TXNTYPE_INVESTMENT = "Income", "Expense", "Transfer", "Investment"
TXNCLASS_INCOME, TXNCLASS_TRANSFER, TXNCLASS_DISCRETIONARY, TXNCLASS_ESSENTIAL = (
    "Income",
    "Transfer",
    "Discretionary",
    "Essential",
)
# Account classifications and categories.
CLASS_ASSETS, CLASS_LIABILITIES = "Assets", "Liabilities"
ACCOUNT_CATEGORIES = (
    "Bank and Cash Accounts",
    "Credit Cards",
    "Investment Accounts",
    "Loans",
    "Other Assets",
    "Other Liabilities",
)
ACCOUNT_CATEGORY_INVESTMENT = "Investment Accounts"
ACCOUNT_CATEGORY_LOAN = "Loans"
VOID_NUM = "**VOID**"
SPLIT_PARENT, SPLIT_CHILD = "X", "Y"
# Labels used by fan-out when the key is NULL.
NO_CATEGORY = "No category"
NO_CLASSIFICATION = "No classification"
TOTAL_LABEL = "Total"
# ---------------------------------------------------------------------------------------------

# Column order of the transactions report.
TXNS_REPORT_COLUMNS = (
    "N",
    "Num",
    "Date",
    "DateYYYYMM",
    "Account",
    "Payee",
    "Category",
    "Subcategory",
    "XferAccount",
    "Amount",
    "TxnType",
    "TxnClass",
    "Memo",
    "Split",
    "C",
    "EraName",
)

TXNS = T.StructType(
    [
        T.StructField("N", T.LongType()),
        T.StructField("Num", T.StringType()),
        T.StructField("Date", T.DateType(), False),
        T.StructField("Account", T.StringType(), False),
        T.StructField("Payee", T.StringType()),
        T.StructField("Category", T.StringType(), False),
        T.StructField("Subcategory", T.StringType()),
        T.StructField("XferAccount", T.StringType()),
        T.StructField("Amount", MONEY, False),
        T.StructField("C", T.StringType()),
        T.StructField("Split", T.StringType()),
        T.StructField("Memo", T.StringType()),
        T.StructField("EraName", T.StringType()),
    ]
)

TXNS_INV = T.StructType(
    [
        T.StructField("N", T.LongType()),
        T.StructField("Date", T.DateType()),
        T.StructField("Account", T.StringType(), False),
        T.StructField("Investment", T.StringType(), False),
        T.StructField("Activity", T.StringType(), False),
        T.StructField("C", T.StringType()),
        T.StructField("Quantity", MONEY),
        T.StructField("Price", MONEY),
        T.StructField("Commission", MONEY),
        T.StructField("Total", MONEY),
        T.StructField("XferAccount", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("Subcategory", T.StringType()),
        T.StructField("Memo", T.StringType()),
    ]
)

ACCOUNTS = T.StructType(
    [
        T.StructField("Account", T.StringType(), False),
        T.StructField("AccountClassification", T.StringType()),
        T.StructField("AccountCategory", T.StringType()),
        T.StructField("Abbreviation", T.StringType()),
        T.StructField("BankName", T.StringType()),
        T.StructField("AccountNumber", T.StringType()),
        T.StructField("AccountLimit", MONEY),
        T.StructField("OpeningBalance", MONEY),
        T.StructField("TxnDateMin", T.DateType()),
        T.StructField("TxnDateMax", T.DateType()),
        T.StructField("XferOnly", T.IntegerType()),
        T.StructField("OpenedDate", T.DateType()),
        T.StructField("ClosedDate", T.DateType()),
    ]
)

PAYEES = T.StructType(
    [
        T.StructField("Payee", T.StringType(), False),
        T.StructField("TxnDateMin", T.DateType()),
        T.StructField("TxnDateMax", T.DateType()),
    ]
)

CATEGORIES = T.StructType(
    [
        T.StructField("Category", T.StringType(), False),
        T.StructField("Subcategory", T.StringType()),
        T.StructField("TxnType", T.StringType()),
        T.StructField("TxnClass", T.StringType()),
        T.StructField("TxnDateMin", T.DateType()),
        T.StructField("TxnDateMax", T.DateType()),
    ]
)

ERAS = T.StructType(
    [
        T.StructField("EraName", T.StringType(), False),
        T.StructField("EraDateFrom", T.DateType()),
        T.StructField("EraDateTo", T.DateType()),
    ]
)

LOANS = T.StructType(
    [
        T.StructField("Loan", T.StringType(), False),
        T.StructField("Abbreviation", T.StringType()),
        T.StructField("AccountNumber", T.StringType()),
        T.StructField("LoanAmount", MONEY),
        T.StructField("InterestRate", MONEY),
        T.StructField("Length", T.StringType()),
        T.StructField("Frequency", T.StringType()),
        T.StructField("PrincipalInterest", MONEY),
        T.StructField("BalloonAmount", MONEY),
        T.StructField("Payment", MONEY),
        T.StructField("Fees", MONEY),
        T.StructField("Type", T.StringType()),
        T.StructField("InterestWhen", T.StringType()),
    ]
)

ACCOUNT_BALANCES = T.StructType(
    [
        T.StructField("Account", T.StringType(), False),
        T.StructField("Date", T.DateType(), False),
        T.StructField("Balance", MONEY, False),
    ]
)

CATEGORY_BALANCES = T.StructType(
    [
        T.StructField("Category", T.StringType(), False),
        T.StructField("Subcategory", T.StringType()),
        T.StructField("Date", T.DateType(), False),
        T.StructField("Balance", MONEY, False),
    ]
)

LEDGER_TABLES = {
    "Txns": TXNS,
    "TxnsInv": TXNS_INV,
    "Accounts": ACCOUNTS,
    "Payees": PAYEES,
    "Categories": CATEGORIES,
    "Eras": ERAS,
    "Loans": LOANS,
    "AccountBalances": ACCOUNT_BALANCES,
    "CategoryBalances": CATEGORY_BALANCES,
}

# Foreign keys checked by the integrity job: (table, columns, parent table, parent columns).
FOREIGN_KEYS = (
    ("Txns", ("Account",), "Accounts", ("Account",)),
    ("Txns", ("XferAccount",), "Accounts", ("Account",)),
    ("Txns", ("Payee",), "Payees", ("Payee",)),
    ("Txns", ("Category", "Subcategory"), "Categories", ("Category", "Subcategory")),
    ("Txns", ("EraName",), "Eras", ("EraName",)),
    ("TxnsInv", ("Account",), "Accounts", ("Account",)),
    ("TxnsInv", ("XferAccount",), "Accounts", ("Account",)),
    ("Loans", ("Loan",), "Accounts", ("Account",)),
    ("AccountBalances", ("Account",), "Accounts", ("Account",)),
)

# Unique keys checked by the integrity job.
UNIQUE_KEYS = (
    ("Txns", ("N",)),
    ("Accounts", ("Account",)),
    ("Payees", ("Payee",)),
    ("AccountBalances", ("Account", "Date")),
    ("CategoryBalances", ("Category", "Subcategory", "Date")),
)
