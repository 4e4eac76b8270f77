"""What the ledger's plans read, however large the tables are."""

from pyspark.sql import functions as F
from small_tables import SMALL

from tallyframe.operators.filters import apply_select
from tallyframe.operators.numbering import number_rows
from tallyframe.plans import fanout as K
from tallyframe.plans.assemble import ledger_from_lines
from tallyframe.sources import export_binding as EB
from tallyframe.sources import exports as X


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df, column):
    return sum(column in line for line in plan(df).splitlines() if line.lstrip(" :+-").startswith("Relation"))


def test_facts_are_joined_once(spark, ledger):
    for df in (ledger.view, ledger.accounts, ledger.categories, apply_select(ledger.view, {"account_category": "ASIA"}, ledger.ctx())):
        assert scans(df, "l_orderkey") == 0, "the dimensions join the tables again"


def test_an_export_is_rendered_in_one_pass(spark):
    assert scans(EB.txn_export_lines(spark, SMALL), "l_orderkey") == 1


def test_reports_of_all_values_need_no_list_of_values(ledger):
    assert "LeftSemi" not in plan(K.keyed_view(ledger, {}, "10y"))


def test_lines_are_dealt_by_kind(spark):
    ledger = ledger_from_lines(spark, EB.balance_export_lines(spark, SMALL).unionByName(EB.loan_export_lines(spark, SMALL)))
    assert ledger.of_kind("loan_terms").select("file").distinct().collect()[0].file == "loans"
    assert ledger.of_kind("loan_terms").columns == ledger.lines.columns
    assert ledger.of_kind("loan_terms").unionByName(ledger.of_kind("account_balances")).exceptAll(ledger.lines).isEmpty()
    assert ledger.of_kind("income_spending").isEmpty()
    assert len(ledger.of_kind("loan_terms").inputFiles()) > 0 and "Join" not in plan(ledger.of_kind("loan_terms"))


def started(df):
    """The plan as it starts: what the planner knows before anything has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_files_are_numbered_without_a_shuffle(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("".join(f"{name}{i}\n" for i in range(1, 6)))
    lines = X.read_lines(spark, f"{tmp_path}/*.csv")
    assert "SortMergeJoin" not in started(lines) and "Exchange hashpartitioning(file" not in started(lines)
    assert sorted((r.line, r.line_no) for r in lines.collect()) == [(f"{n}{i}", i) for n in "ab" for i in range(1, 6)]


def test_rendered_exports_are_written_as_they_lie(spark, tmp_path):
    lines = EB.txn_export_lines(spark, SMALL)
    places = lines.withColumn("at", F.spark_partition_id()).groupBy("file").agg(F.count_distinct("at").alias("n"))
    assert places.filter("n > 1").isEmpty(), "the lines of a file lie in several partitions"
    made = sorted(p for p in started(lines).splitlines() if "hashpartitioning(_file" in p)
    assert len(made) == 1 and "Num" not in made[0]
    found = EB.write_files(lines, str(tmp_path / "exports"), gathered=True)
    read = X.read_lines(spark, found)
    assert read.select("file").distinct().count() == places.count()
    back = read.select(EB.file_label(F.col("file")).alias("file"), "line_no", "line")
    want = lines.select("file", "line_no", F.rtrim("line").alias("line"))
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()


def test_numbers_within_groups_are_attached_without_a_shuffle(spark):
    rows = spark.range(300).selectExpr("id % 3 AS g", "id AS k")
    numbered = number_rows(rows, ["k"], "N", partition_by=["g"], num_partitions=4)
    assert "SortMergeJoin" not in started(numbered) and "hashpartitioning(__nr_pid" not in started(numbered)
    assert sorted((r.g, r.k, r.N) for r in numbered.collect()) == [(k % 3, k, k // 3 + 1) for k in sorted(range(300), key=lambda k: (k % 3, k))]
