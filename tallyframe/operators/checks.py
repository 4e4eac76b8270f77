"""Data-quality jobs: control totals, referential integrity, keys, NOT NULL, coverage.

Each check returns a small DataFrame of findings (empty or zero counts = clean), computed with
aggregates and anti-joins; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def _union(frames: Sequence[DataFrame], spark: SparkSession, ddl: str) -> DataFrame:
    if not frames:
        return spark.createDataFrame([], ddl)
    return reduce(lambda a, b: a.unionByName(b), frames)


def orphans(tables: Mapping[str, DataFrame], fks: Sequence[tuple] = S.FOREIGN_KEYS) -> DataFrame:
    """Violations per foreign key: child rows whose (all non-NULL) key has no parent row.

    Checks the keys of the child tables given; a key whose parent is absent raises.
    """
    spark = next(iter(tables.values())).sparkSession
    out = []
    for child, cols, parent, pcols in fks:
        if child not in tables:
            continue  # not asked
        if parent not in tables:
            raise KeyError(f"foreign key {child}({', '.join(cols)}): table {parent} is absent")
        c = tables[child].select(*[F.col(x).alias(f"_c{i}") for i, x in enumerate(cols)])
        c = c.filter(reduce(lambda a, b: a & b, [F.col(f"_c{i}").isNotNull() for i in range(len(cols))]))
        p = tables[parent].select(*[F.col(x).alias(f"_p{i}") for i, x in enumerate(pcols)]).distinct()
        cond = reduce(lambda a, b: a & b, [F.col(f"_c{i}") == F.col(f"_p{i}") for i in range(len(cols))])
        bad = c.join(p, cond, "left_anti")
        out.append(
            bad.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(child).alias("table"), F.lit(",".join(cols)).alias("columns"), F.lit(parent).alias("parent"), "violations"
            )
        )
    return _union(out, spark, "table string, columns string, parent string, violations long")


def duplicates(tables: Mapping[str, DataFrame], keys: Sequence[tuple] = S.UNIQUE_KEYS) -> DataFrame:
    """Number of key values that occur more than once, per unique key."""
    spark = next(iter(tables.values())).sparkSession
    out = []
    for table, cols in keys:
        if table not in tables:
            continue  # not asked
        if not set(cols) <= set(tables[table].columns):
            raise KeyError(f"unique key {table}({', '.join(cols)}): a column is absent")
        g = tables[table].groupBy(*cols).count().filter(F.col("count") > 1)
        out.append(g.agg(F.count(F.lit(1)).alias("duplicates")).select(F.lit(table).alias("table"), F.lit(",".join(cols)).alias("columns"), "duplicates"))
    return _union(out, spark, "table string, columns string, duplicates long")


def not_null(tables: Mapping[str, DataFrame], schemas: Mapping[str, T.StructType] = S.LEDGER_TABLES) -> DataFrame:
    """NULL count of every NOT NULL column of the ledger schema, one aggregate per table."""
    spark = next(iter(tables.values())).sparkSession
    out = []
    for name, df in tables.items():
        required = [f.name for f in schemas.get(name, T.StructType()).fields if not f.nullable and f.name in df.columns]
        if not required:
            continue
        agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        stacked = ", ".join(f"'{c}', `{c}`" for c in required)
        out.append(agg.selectExpr(f"'{name}' AS table", f"stack({len(required)}, {stacked}) AS (column, nulls)"))
    return _union(out, spark, "table string, column string, nulls long")


def fanout(txns: DataFrame, view: DataFrame) -> DataFrame:
    """The enriched view must not change the number of transactions."""
    both = txns.select(F.lit(True).alias("_t")).unionByName(view.select(F.lit(False).alias("_t")))
    agg = both.agg(F.count_if(F.col("_t")).alias("txns"), F.count_if(~F.col("_t")).alias("view"))
    return agg.withColumn("ok", F.col("txns") == F.col("view"))


def unassigned(txns: DataFrame, column: str = "EraName") -> DataFrame:
    return txns.agg(F.count_if(F.col(column).isNull()).alias("unassigned"), F.count(F.lit(1)).alias("txns"))


def control_total(rows: DataFrame, footer: DataFrame, amount: str = "Amount", key: Sequence[str] = ("file",)) -> DataFrame:
    """Sum of the rows vs the export's footer total, per export file."""
    s = rows.groupBy(*key).agg(F.sum(amount).alias("rows_total"))
    j = s.join(footer.select(*key, F.col("Total").alias("footer_total")), list(key), "full")
    return j.withColumn("ok", F.coalesce(F.col("rows_total") == F.col("footer_total"), F.lit(False)))


def constraints(
    tables: Mapping[str, DataFrame],
    fks: Sequence[tuple] = S.FOREIGN_KEYS,
    uniques: Sequence[tuple] = S.UNIQUE_KEYS,
    schemas: Mapping[str, T.StructType] = S.LEDGER_TABLES,
) -> DataFrame:
    """All constraints of the given tables in one pass: (kind, table, columns, parent, violations), zeros included.

    Each row is read once and gives one entry per constraint it takes part in: the key it refers to, the key it offers to
    children, the key that must be its own, the column it lacks. Entries of equal (constraint, key) meet in one hash
    aggregate, whose map side leaves one row per key and task however hot the key is; a key that children use and
    no parent offers, or that occurs twice, is counted from there. ``violations``: child rows without a parent, keys that
    occur more than once, NULLs.
    """
    known = [("foreign key", t, c, p, pc) for t, c, p, pc in fks if t in tables]
    for _, t, c, p, _ in known:
        if p not in tables:
            raise KeyError(f"foreign key {t}({', '.join(c)}): table {p} is absent")
    known += [("unique", t, c, None, None) for t, c in uniques if t in tables and set(c) <= set(tables[t].columns)]
    known += [("not null", t, (f.name,), None, None) for t in tables for f in schemas.get(t, T.StructType()).fields if not f.nullable and f.name in tables[t].columns]
    spark = next(iter(tables.values())).sparkSession
    if not known:
        return spark.createDataFrame([], "kind string, table string, columns string, parent string, violations long")

    def key(columns: Sequence[str]) -> F.Column:
        return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)]))

    def whole(columns: Sequence[str]) -> F.Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])

    def entry(no: int, k: F.Column, uses: int, offers: int, when: F.Column) -> F.Column:
        return F.when(when, F.struct(F.lit(no).alias("no"), k.alias("key"), F.lit(uses).alias("uses"), F.lit(offers).alias("offers")))

    parts = []
    for name, df in tables.items():
        entries = []
        for no, (kind, t, columns, parent, offered) in enumerate(known):
            if kind == "foreign key":
                if t == name:
                    entries.append(entry(no, key(columns), 1, 0, whole(columns)))
                if parent == name:
                    entries.append(entry(no, key(offered), 0, 1, whole(offered)))
            elif t == name:
                null = kind == "not null"
                entries.append(entry(no, F.lit("") if null else key(columns), 1, 0, ~whole(columns) if null else F.lit(True)))
        if entries:
            parts.append(df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*"))
    met = reduce(DataFrame.unionByName, parts).groupBy("no", "key").agg(F.sum("uses").alias("uses"), F.max("offers").alias("offers"))
    fk, unique = ([no for no, k in enumerate(known) if k[0] == kind] for kind in ("foreign key", "unique"))
    bad = F.when(F.col("no").isin(fk), F.when(F.col("offers") == 0, F.col("uses")).otherwise(0)).when(F.col("no").isin(unique), (F.col("uses") > 1).cast("long")).otherwise(F.col("uses"))
    found = met.groupBy("no").agg(F.sum(bad).alias("violations"))
    rows = [(no, kind, t, ",".join(c), p) for no, (kind, t, c, p, _) in enumerate(known)]
    every = spark.createDataFrame(rows, "no int, kind string, table string, columns string, parent string")
    return every.join(found, "no", "left").select("kind", "table", "columns", "parent", F.coalesce("violations", F.lit(0)).alias("violations"))
