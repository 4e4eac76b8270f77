"""Ledger build: transfers, rewrites, dimensions, overlays, intervals and balance facts.

Every step is a DataFrame transformation. Dimension tables are aggregates over the facts; the
overlays that the original tool ran as ordered UPDATE statements become priority columns and
``min_by``/``max_by`` or ``coalesce`` over joins, so "first insert wins" / "last update wins"
hold without any row-at-a-time loop. Small config inputs (rules, eras, category maps) become
small DataFrames; joins against them are broadcast because their size is that of the config.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.category import category_label, split_pair
from ..functions.dates import parse_flex_date
from .filters import REWRITE_DIRECTIVES, FilterContext, as_list
from .rules import HITS, fold_rules, rules_literal


class ConfigError(ValueError):
    """Invalid ledger configuration."""


# ---------------------------------------------------------------------------------------------
# L1 transfers


def tag_transfers(txns: DataFrame) -> DataFrame:
    """Transfer categories carry the other account in Subcategory: move it to XferAccount."""
    is_xfer = F.col("Category").isin(list(S.TRANSFER_CATEGORIES))
    cols = txns.columns
    xfer_src = F.col("XferAccount") if "XferAccount" in cols else F.lit(None).cast("string")
    out = txns.withColumn("XferAccount", F.when(is_xfer, F.col("Subcategory")).otherwise(xfer_src))
    return out.withColumn("Subcategory", F.when(F.col("XferAccount").isNotNull(), F.lit(None).cast("string")).otherwise(F.col("Subcategory")))


# ---------------------------------------------------------------------------------------------
# L2 rewrites


def validate_rewrites(rules: Sequence[Mapping]) -> None:
    for i, rule in enumerate(rules):
        sel = rule.get("select")
        if not sel:
            raise ConfigError(f"rewrites[{i}]: 'select' is required")
        if len([k for k in rule if k != "select"]) == 0:
            raise ConfigError(f"rewrites[{i}]: at least one modify value field is required")
        unknown = set(sel) - REWRITE_DIRECTIVES
        if unknown:
            raise ConfigError(f"rewrites[{i}]: unsupported select directives {sorted(unknown)}")
        for k in sel:
            if not as_list(sel[k]):
                raise ConfigError(f"rewrites[{i}].{k}: at least one value is required")
        for k in ("date_from", "date_to"):
            v = sel.get(k)
            if v and parse_flex_date(str(v), k == "date_from") is None:
                raise ConfigError(f"rewrites[{i}].{k}: '{v}': invalid date spec")
        if rule.get("txndate") and parse_flex_date(str(rule["txndate"]), False) is None:
            raise ConfigError(f"rewrites[{i}].txndate: '{rule['txndate']}': invalid date spec")


def _rule_assignments(rule: Mapping) -> dict[str, object]:
    """Column -> value that a rule sets (None empties it)."""
    out: dict[str, object] = {}
    for key in rule:
        if key == "category" and rule["category"]:
            out["Category"], out["Subcategory"] = split_pair(str(rule["category"]))
        elif key == "memo":
            out["Memo"] = rule["memo"]
        elif key == "payee" and rule["payee"]:
            out["Payee"] = rule["payee"]
        elif key == "txndate":
            out["Date"] = parse_flex_date(str(rule["txndate"]), False)
        elif key not in ("select", "category", "payee"):
            raise ConfigError(f"'{key}': unrecognized rewrite directive")
    return out


def apply_rewrites(txns: DataFrame, rules: Sequence[Mapping], ctx: FilterContext | None = None) -> tuple[DataFrame, list[str]]:
    """Apply ordered rules; each sees the result of the previous ones (see ``operators.rules``).

    Returns the rewritten frame, with the numbers of the rules that applied to each row in one column, and for each rule the
    column that tells (that one for all). One projection, whatever the number of rules.
    """
    validate_rewrites(rules)
    assignments = [_rule_assignments(rule) for rule in rules]
    if not rules:
        return txns, []
    return fold_rules(txns, *rules_literal(rules, assignments, ctx or FilterContext())), [HITS] * len(rules)


def rewrite_counts(rewritten: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows modified per rule, one row per rule (``flags``: as ``apply_rewrites`` returns them)."""
    spark = rewritten.sparkSession
    if not flags:
        return spark.createDataFrame([], "rule long, modified long")
    hits = rewritten.select(F.explode(HITS).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("modified"))
    every = spark.range(len(flags)).select(F.col("id").alias("rule"))
    return every.join(hits, "rule", "left").select("rule", F.coalesce("modified", F.lit(0)).alias("modified"))


# ---------------------------------------------------------------------------------------------
# L3 / L4 dimensions from the facts


def payees(txns: DataFrame) -> DataFrame:
    return (
        txns.filter(F.col("Payee").isNotNull())
        .groupBy("Payee")
        .agg(F.min("Date").alias("TxnDateMin"), F.max("Date").alias("TxnDateMax"))
    )


def categories(txns: DataFrame) -> DataFrame:
    """Distinct (Category, Subcategory) of non-transfer categories with their date range."""
    return (
        txns.filter(~F.col("Category").isin(list(S.TRANSFER_CATEGORIES)))
        .groupBy("Category", "Subcategory")
        .agg(F.min("Date").alias("TxnDateMin"), F.max("Date").alias("TxnDateMax"))
        .select("Category", "Subcategory", F.lit(None).cast("string").alias("TxnType"), F.lit(None).cast("string").alias("TxnClass"), "TxnDateMin", "TxnDateMax")
    )


# ---------------------------------------------------------------------------------------------
# L5 accounts


def _account_source(df: DataFrame, prio: int, classification: str | None = None, category: str | None = None) -> DataFrame:
    cols = df.columns
    return df.select(
        "Account",
        F.lit(classification).cast("string").alias("AccountClassification"),
        F.lit(category).cast("string").alias("AccountCategory"),
        (F.col("TxnDateMin") if "TxnDateMin" in cols else F.lit(None).cast("date")).alias("TxnDateMin"),
        (F.col("TxnDateMax") if "TxnDateMax" in cols else F.lit(None).cast("date")).alias("TxnDateMax"),
        F.lit(prio).alias("_prio"),
    )


def _dated(df: DataFrame, key: str = "Account") -> DataFrame:
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("Account"))
        .agg(F.min("Date").alias("TxnDateMin"), F.max("Date").alias("TxnDateMax"))
    )


def accounts(
    txns: DataFrame,
    txns_inv: DataFrame | None = None,
    loans: DataFrame | None = None,
    balance_names: DataFrame | None = None,
    detail_names: DataFrame | None = None,
) -> DataFrame:
    """Accounts from all sources, first source wins; then transfer targets are upserted.

    Source order: investment txns (Assets / Investment Accounts), loans (Liabilities / Loans),
    txns, balance report names, balance detail names. A transfer target that is new, or known
    only without transactions, gets XferOnly = 1 and the transfer date range.
    """
    sources = []
    if txns_inv is not None:
        sources.append(_account_source(_dated(txns_inv), 0, S.CLASS_ASSETS, S.ACCOUNT_CATEGORY_INVESTMENT))
    if loans is not None:
        sources.append(_account_source(loans.select(F.col("Loan").alias("Account")).filter(F.col("Account").isNotNull()), 1, S.CLASS_LIABILITIES, S.ACCOUNT_CATEGORY_LOAN))
    sources.append(_account_source(_dated(txns), 2))
    for prio, names in ((3, balance_names), (4, detail_names)):
        if names is not None:
            sources.append(_account_source(names.select("Account").filter(F.col("Account").isNotNull()), prio))
    base = sources[0]
    for s in sources[1:]:
        base = base.unionByName(s)
    attrs = ["AccountClassification", "AccountCategory", "TxnDateMin", "TxnDateMax"]
    first = base.groupBy("Account").agg(F.min_by(F.struct(*attrs), F.col("_prio")).alias("_a")).select("Account", "_a.*")

    xfer = _dated(txns, "XferAccount").select(
        F.col("Account").alias("_xa"), F.col("TxnDateMin").alias("_xmin"), F.col("TxnDateMax").alias("_xmax")
    )
    j = first.join(xfer, first.Account == xfer._xa, "full")
    upsert = F.col("Account").isNull() | (F.col("TxnDateMin").isNull() & F.col("_xa").isNotNull())
    out = j.select(
        F.coalesce(F.col("Account"), F.col("_xa")).alias("Account"),
        "AccountClassification",
        "AccountCategory",
        F.when(upsert, F.col("_xmin")).otherwise(F.col("TxnDateMin")).alias("TxnDateMin"),
        F.when(upsert, F.col("_xmax")).otherwise(F.col("TxnDateMax")).alias("TxnDateMax"),
        F.when(upsert, F.lit(1)).alias("XferOnly"),
    )
    return conform(out, S.ACCOUNTS)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a ledger schema: missing columns are NULL, types are cast."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


# ---------------------------------------------------------------------------------------------
# L6 - L9 account overlays


def overlay(base: DataFrame, updates: DataFrame, key: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """UPDATE base SET columns = updates.columns WHERE key matches (updates' NULLs are written too)."""
    keys = [key] if isinstance(key, str) else list(key)
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in columns]).withColumn("_hit", F.lit(True))
    j = base.join(u, keys, "left")
    return j.select(
        *[F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    )


def account_types_overlay(accts: DataFrame, typed: DataFrame) -> DataFrame:
    """Classification / category from a sectioned balances report (Account, Type, Subtype)."""
    u = _latest(typed.withColumnsRenamed({"Type": "AccountClassification", "Subtype": "AccountCategory"}), ["AccountClassification", "AccountCategory"])
    return overlay(accts, u, "Account", ["AccountClassification", "AccountCategory"])


def _latest(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per Account: that of the last report and line (of the largest values where neither is known)."""
    values = [(F.col(c) if c in rows.columns else F.lit(None)).alias(c) for c in cols]
    place = [F.col(c) for c in ("report_seq", "file", "line_no") if c in rows.columns]
    best = rows.groupBy("Account").agg(F.max_by(F.struct(*values), F.struct(*place, *values)).alias("_v"))
    return best.select("Account", *[F.col(f"_v.{c}").alias(c) for c in cols])


def account_details_overlay(accts: DataFrame, details: DataFrame) -> DataFrame:
    """OpeningBalance, Abbreviation, BankName, AccountNumber, AccountLimit per account."""
    cols = ["OpeningBalance", "Abbreviation", "BankName", "AccountNumber", "AccountLimit"]
    return overlay(accts, _latest(details, cols), "Account", cols)


def account_dates_overlay(accts: DataFrame, cfg: DataFrame) -> DataFrame:
    """OpenedDate / ClosedDate from config rows (Account, opened_date, closed_date text)."""
    u = cfg.select(
        "Account",
        F.try_to_date("opened_date").alias("OpenedDate"),
        F.try_to_date("closed_date").alias("ClosedDate"),
    ).filter(F.col("OpenedDate").isNotNull() | F.col("ClosedDate").isNotNull())
    return overlay(accts, u, "Account", ["OpenedDate", "ClosedDate"])


def category_classification_map(accts: DataFrame, config_map: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """Account category -> classification, from accounts already classified plus the config.

    When a category appears under several classifications the last one (config order, after the
    classifications found on accounts, which come in name order) wins.
    """
    spark = accts.sparkSession
    found = (
        accts.filter(F.col("AccountClassification").isNotNull())
        .select(F.col("AccountClassification").alias("cls"), F.col("AccountCategory").alias("cat"))
        .distinct()
        .filter(F.col("cat").isNotNull())
    )
    # order of classifications: the ones found (sorted), then new ones from the config
    rows = [(cls, cat) for cls, cats in (config_map or {}).items() for cat in cats]
    cfg = spark.createDataFrame(rows, "cls string, cat string")
    cfg_first = {cls: i for i, cls in enumerate((config_map or {}).keys())}
    order_expr = F.lit(None).cast("int")
    for cls, i in cfg_first.items():
        order_expr = F.when(F.col("cls") == cls, F.lit(i)).otherwise(order_expr)
    both = found.union(cfg).distinct()
    # classifications seen on accounts sort first by name; config-only ones follow in config order
    ranked = both.join(found.select("cls").distinct().withColumn("_known", F.lit(True)), "cls", "left").withColumn(
        "_ord", F.when(F.col("_known"), F.lit(-1)).otherwise(order_expr)
    )
    return ranked.groupBy("cat").agg(F.max_by("cls", F.struct("_ord", "cls")).alias("cls"))


def account_classify(accts: DataFrame, account_cfg: DataFrame, config_map: Mapping[str, Sequence[str]] | None) -> tuple[DataFrame, DataFrame]:
    """Set (classification, category) from per-account config ``category`` text.

    ``Class: Category`` names both; a bare category looks its class up in the map. Entries whose
    class is unknown are returned as the second frame (the original only warned) and change
    nothing.
    """
    cmap = category_classification_map(accts, config_map)
    known = cmap.select(F.col("cls").alias("_known_cls")).distinct()
    cfg = account_cfg.filter(F.col("category").isNotNull()).select(
        "Account",
        "category",
        F.when(F.col("category").contains(":"), F.rtrim(F.split(F.col("category"), ":", 2).getItem(0))).alias("_cls_given"),
        F.when(F.col("category").contains(":"), F.ltrim(F.split(F.col("category"), ":", 2).getItem(1))).otherwise(F.col("category")).alias("_cat"),
    )
    looked = cfg.join(cmap, cfg._cat == cmap.cat, "left").select(
        "Account", "category", F.col("_cat").alias("AccountCategory"), F.coalesce("_cls_given", "cls").alias("AccountClassification")
    )
    # classifications are few, but derived from data: the planner (AQE) decides on a broadcast
    checked = looked.join(known, looked.AccountClassification == known._known_cls, "left")
    good = checked.filter(F.col("_known_cls").isNotNull()).select("Account", "AccountClassification", "AccountCategory")
    bad = checked.filter(F.col("_known_cls").isNull()).select(
        "Account", "category", F.when(F.col("AccountClassification").isNull(), F.lit("no classification")).otherwise(F.lit("unknown classification")).alias("problem")
    )
    return overlay(accts, good, "Account", ["AccountClassification", "AccountCategory"]), bad


# ---------------------------------------------------------------------------------------------
# L10 - L12 category overlays and defaults


def category_types_overlay(cats: DataFrame, typed: Sequence[DataFrame]) -> DataFrame:
    """TxnType by category from spending reports (Category, TxnType); later reports win."""
    if not typed:
        return cats
    rows = None
    for seq, df in enumerate(typed):
        part = df.select("Category", "TxnType").withColumn("_seq", F.lit(seq))
        rows = part if rows is None else rows.unionByName(part)
    u = rows.groupBy("Category").agg(F.max_by("TxnType", "_seq").alias("TxnType"))
    return overlay(cats, u, "Category", ["TxnType"])


def _category_rules(spark: SparkSession, field_map: Mapping[str, Sequence[str]] | None) -> DataFrame:
    rows = []
    seq = 0
    for value, pairs in (field_map or {}).items():
        for pair in pairs:
            cat, sub = split_pair(pair)
            rows.append((cat, sub, value, seq))
            seq += 1
    return spark.createDataFrame(rows, "Category string, Subcategory string, value string, seq int")


def category_config_overlay(cats: DataFrame, category_types: Mapping | None, category_classes: Mapping | None) -> DataFrame:
    """TxnType / TxnClass from config: by category, then by (category, subcategory), which wins."""
    spark = cats.sparkSession
    out = cats
    for column, fmap in (("TxnType", category_types), ("TxnClass", category_classes)):
        rules = _category_rules(spark, fmap)
        by_cat = rules.filter(F.col("Subcategory").isNull()).groupBy("Category").agg(F.max_by("value", "seq").alias("_c"))
        by_sub = rules.filter(F.col("Subcategory").isNotNull()).groupBy("Category", "Subcategory").agg(F.max_by("value", "seq").alias("_s"))
        # config-sized: broadcast
        j = out.join(F.broadcast(by_cat), "Category", "left").join(
            F.broadcast(by_sub.withColumnRenamed("Category", "_sc").withColumnRenamed("Subcategory", "_ss")),
            (F.col("Category") == F.col("_sc")) & (F.col("Subcategory") == F.col("_ss")),
            "left",
        )
        out = j.withColumn(column, F.coalesce("_s", "_c", column)).drop("_c", "_s", "_sc", "_ss")
    return out


def category_defaults(cats: DataFrame, type_default: str = S.TXNTYPE_EXPENSE, class_default: str = S.TXNCLASS_DISCRETIONARY) -> DataFrame:
    """TxnType defaults to Expense; TxnClass = TxnType unless Expense, else Discretionary."""
    t = F.coalesce(F.col("TxnType"), F.lit(type_default))
    c = F.coalesce(F.col("TxnClass"), F.when(t != S.TXNTYPE_EXPENSE, t), F.lit(class_default))
    return cats.withColumn("TxnType", t).withColumn("TxnClass", c)


# ---------------------------------------------------------------------------------------------
# L13 / L14 intervals (eras)


def build_intervals(spark: SparkSession, eras: Mapping[str, Mapping]) -> DataFrame:
    """Era specs -> (EraName, EraDateFrom, EraDateTo, era_no) in date order.

    A missing ``date_from`` continues the last ``date_to`` declared before; ``...`` is an open end; a reversed
    range is swapped. An era without any bound and two eras that share more than a boundary day are errors.
    """
    bad = [n for n, e in eras.items() for k in ("date_from", "date_to") if e.get(k) not in (None, "...") and parse_flex_date(str(e[k]), True) is None]
    if bad:
        raise ConfigError(f"eras: invalid dates in {bad}")
    rows = [
        (i, name, _edge(e.get("date_from"), True), _edge(e.get("date_to"), False))
        for i, (name, e) in enumerate(eras.items())
    ]
    declared = spark.createDataFrame(rows, "seq int, EraName string, first date, last date")
    # config rows: the windows order as many rows as there are eras
    earlier = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.last(F.greatest("first", "last"), ignorenulls=True).over(earlier)
    spans = declared.withColumn("first", F.coalesce("first", F.date_add(ended, 1)))
    both = F.col("first").isNotNull() & F.col("last").isNotNull()
    spans = spans.select(
        "EraName",
        F.when(both, F.least("first", "last")).otherwise(F.col("first")).alias("EraDateFrom"),
        F.when(both, F.greatest("first", "last")).otherwise(F.col("last")).alias("EraDateTo"),
    )
    in_order = Window.orderBy(F.col("EraDateFrom").asc_nulls_first(), F.col("EraDateTo").asc_nulls_last())
    begins_next = F.lead(F.coalesce("EraDateFrom", F.to_date(F.lit("0001-01-01")))).over(in_order)
    overlaps = begins_next < F.coalesce("EraDateTo", F.to_date(F.lit("9999-12-31")))
    spans = spans.select("*", (F.row_number().over(in_order) - 1).alias("era_no"), overlaps.alias("overlaps"), F.lead("EraName").over(in_order).alias("other"))
    for r in spans.filter("overlaps OR (EraDateFrom IS NULL AND EraDateTo IS NULL)").collect():
        why = f"overlaps '{r.other}'" if r.overlaps and (r.EraDateFrom or r.EraDateTo) else "needs 'date_from' or 'date_to'"
        raise ConfigError(f"eras.{r.EraName}: {why}")
    return spans.select("EraName", "EraDateFrom", "EraDateTo", "era_no")


def _edge(spec: object, first_day: bool) -> date | None:
    return None if spec in (None, "...") else parse_flex_date(str(spec), first_day)


def assign_interval(txns: DataFrame, intervals: DataFrame, date_col: str = "Date", out_col: str = "EraName") -> DataFrame:
    """Tag each row with the last interval (in interval order) containing its date.

    The intervals are config-sized, so the predicate is a CASE chain evaluated in the same
    projection (no join, no shuffle): later intervals are tested first so the last match wins.
    """
    rows = intervals.orderBy("era_no").collect()  # config-sized (eras), not data
    d = F.col(date_col)
    expr = F.lit(None).cast("string")
    for r in rows:  # build so that the last interval is checked first
        if r.EraDateFrom and r.EraDateTo:
            cond = d.between(F.lit(r.EraDateFrom), F.lit(r.EraDateTo))
        elif r.EraDateFrom:
            cond = d >= F.lit(r.EraDateFrom)
        else:
            cond = d <= F.lit(r.EraDateTo)
        expr = F.when(cond, F.lit(r.EraName)).otherwise(expr)
    return txns.withColumn(out_col, expr)


def assign_interval_long(
    txns: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    date_col: str = "Date",
    out_col: str = "EraName",
    bucket_days: int = 32,
) -> DataFrame:
    """Tag each row with the last interval of its key that holds its date (NULL: none does); for long interval lists.

    ``intervals``: keys, ``EraName``, ``EraDateFrom``, ``EraDateTo`` (NULL: open end), ``era_no`` (the order; the largest
    wins where intervals meet or overlap). Intervals are dealt into buckets of days and gathered per (key, bucket), the
    open-ended ones per key, so a row meets one cell of each in an equi-join: no row is made twice, nothing is grouped
    again, and a key that holds most rows is spread by its buckets.
    """
    first, last = F.col("EraDateFrom"), F.col("EraDateTo")
    entry = F.struct(F.col("era_no"), F.col("EraName"), first.alias("f"), last.alias("t"))
    closed = first.isNotNull() & last.isNotNull()

    def bucket(day: Column) -> Column:
        return F.floor(F.unix_date(day) / F.lit(bucket_days))

    dealt = intervals.filter(closed & (first <= last)).withColumn("_bucket", F.explode(F.sequence(bucket(first), bucket(last))))
    cells = dealt.groupBy(*keys, "_bucket").agg(F.collect_list(entry).alias("_cell"))
    ends = intervals.filter(~closed).groupBy(*keys).agg(F.collect_list(entry).alias("_ends"))
    base = txns.drop(out_col) if out_col in txns.columns else txns
    d = F.col(date_col)
    met = base.withColumn("_bucket", bucket(d)).join(cells, [*keys, "_bucket"], "left").join(ends, list(keys), "left")
    none = F.array().cast(dict(cells.dtypes)["_cell"])

    def holding(cell: str) -> Column:
        return F.filter(F.coalesce(F.col(cell), none), lambda e: (e["f"].isNull() | (e["f"] <= d)) & (e["t"].isNull() | (d <= e["t"])))

    held = F.array_max(F.concat(holding("_cell"), holding("_ends")))
    return met.withColumn(out_col, held["EraName"]).select(*base.columns, out_col)


# ---------------------------------------------------------------------------------------------
# L15 - L17 balance facts and upserts


def account_balances(asof_long: DataFrame, accts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As-of balance facts (Account, Date, Balance), dropping rows before the account's first day.

    First day = earliest of OpenedDate and TxnDateMin. Accounts with neither keep all their rows
    and are also returned in the second frame (balance without transactions).
    """
    first = accts.select("Account", F.least("OpenedDate", "TxnDateMin").alias("_first"))
    j = asof_long.filter(F.col("Balance").isNotNull()).join(first, "Account", "left")
    kept = j.filter(F.col("_first").isNull() | (F.col("Date") >= F.col("_first")))
    no_txns = j.filter(F.col("_first").isNull()).select("Account", "Date", "Balance")
    return kept.select("Account", "Date", "Balance"), no_txns


def category_balances(asof_long: DataFrame) -> DataFrame:
    """(Category, Subcategory, Date, Balance) without transfers; the first report wins per key.

    Input columns: Category, Subcategory, Date, Balance, TxnType, report_seq.
    """
    x = asof_long.filter(F.col("Balance").isNotNull() & ~F.coalesce(F.col("TxnType") == S.TXNTYPE_TRANSFER, F.lit(False)))
    return x.groupBy("Category", "Subcategory", "Date").agg(F.min_by("Balance", "report_seq").alias("Balance"))


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], do_nothing: bool = False) -> DataFrame:
    """INSERT ... ON CONFLICT(keys) DO UPDATE (new values win) or DO NOTHING (old values win)."""
    values = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in values]).withColumn("_t", F.lit(True))
    r = rows.select(*keys, *[(F.col(c) if c in rows.columns else F.lit(None)).alias(f"_r_{c}") for c in values]).withColumn("_r", F.lit(True))
    j = t.join(r, list(keys), "full")
    out = []
    for c in values:
        if do_nothing:
            out.append(F.when(F.col("_t"), F.col(f"_t_{c}")).otherwise(F.col(f"_r_{c}")).alias(c))
        else:
            # DO UPDATE sets only the columns the new row names
            if c in rows.columns:
                out.append(F.when(F.col("_r"), F.col(f"_r_{c}")).otherwise(F.col(f"_t_{c}")).alias(c))
            else:
                out.append(F.col(f"_t_{c}").alias(c))
    return j.select(*keys, *out)


# ---------------------------------------------------------------------------------------------
# L18 enriched view


def enrich(txns: DataFrame, cats: DataFrame) -> DataFrame:
    """Txns + TxnType / TxnClass / CategorySubcategory (left join, NULL-safe on Subcategory).

    The categories dimension is an aggregate of the facts: the planner (AQE) broadcasts it when
    its measured size is small and falls back to a sort-merge join when it is not.
    """
    c = cats.select(F.col("Category").alias("_cc"), F.col("Subcategory").alias("_cs"), F.col("TxnType").alias("_ct"), F.col("TxnClass").alias("_cl"))
    j = txns.join(c, (txns.Category == c._cc) & txns.Subcategory.eqNullSafe(c._cs), "left")
    xfer = F.col("XferAccount").isNotNull()
    return j.select(
        *txns.columns,
        F.when(xfer, F.lit(S.TXNTYPE_TRANSFER)).otherwise(F.col("_ct")).alias("TxnType"),
        F.when(xfer, F.lit(S.TXNCLASS_TRANSFER)).otherwise(F.col("_cl")).alias("TxnClass"),
        F.when(xfer, F.lit(None).cast("string")).otherwise(category_label(F.col("Category"), F.col("Subcategory"))).alias("CategorySubcategory"),
    )


def interval_overlaps(intervals: DataFrame, name: str = "EraName", start: str = "EraDateFrom", end: str = "EraDateTo") -> DataFrame:
    """Pairs of consecutive intervals (in (start, end, name) order) where the next starts before
    this one ends; a shared boundary day is allowed. Open ends count as -inf / +inf.

    Consecutive = numbers n and n + 1 of the distributed numbering, joined on that key, so even a
    long interval table is never ordered inside one task.
    """
    from .numbering import number_rows

    lo = F.coalesce(F.col(start), F.lit("0001-01-01").cast("date"))
    hi = F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))
    x = number_rows(intervals.select(F.col(name).alias("_n"), lo.alias("_s"), hi.alias("_e")), ["_s", "_e", "_n"], "_k")
    nxt = x.select(F.col("_k").alias("_k2"), F.col("_n").alias("second"), F.col("_s").alias("_ns"))
    j = x.join(nxt, F.col("_k") + 1 == F.col("_k2"))
    return j.filter(F.col("_ns") < F.col("_e")).select(F.col("_n").alias("first"), "second")
