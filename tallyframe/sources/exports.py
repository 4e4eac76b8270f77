"""Export files -> typed rows: listing, classification, header detection, footer, as-of date.

Exports are small delimited text files with preambles, footers and section rows. They are read
as a *line table* (file, line_no, line): one row per physical line with its true position, so
that order-dependent cleaning (splits, sections) can run as per-file window functions. Files are
independent, so every per-file step partitions by ``file`` (many files -> many tasks).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, write_counted

# --- fixed values: windows-1252 code points that differ from Latin-1 (bytes 0x80 - 0x9F that are assigned) ---
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_TEXT = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
# ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ExportKind:
    """How an export type is recognized and which columns it has."""

    name: str
    header_prefix: str | None  # the header line starts with this (first required column + ',')
    footer_prefix: str | None = None  # a line starting with this must exist somewhere
    contains: str | None = None  # alternative marker: a line containing this
    dated: bool = False  # the report is of one day, named above its header
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    money: tuple[str, ...] = ()
    footer_label: str | None = None  # value of the first column on the control-total row


# --- fixed values: export types in recognition order (the first match wins) -----------------
EXPORT_KINDS: tuple[ExportKind, ...] = (
    ExportKind("account_balances", "Account,", "Net Worth,", dated=True, required=("Account", "Total"), money=("Total",), footer_label="Net Worth"),
    ExportKind(
        "account_balances_details",
        "Account,",
        dated=True,
        required=("Account", "Balance", "Balance.1"),
        optional=("Abbreviation", "Bank Name", "Account Number", "Limit"),
        money=("Balance", "Balance.1", "Limit"),
    ),
    ExportKind(
        "investment_txns",
        None,
        contains=",Commission,",
        required=("Date", "Account", "Investment", "Activity", "Quantity", "Price", "Commission", "Total", "Transfer Account", "Category"),
        optional=("C", "Memo"),
        money=("Quantity", "Price", "Commission", "Total"),
    ),
    ExportKind(
        "loan_terms",
        "Loan,",
        required=("Loan", "Amount", "Rate", "Length", "Interest", "Frequency", "Amount.1", "category", "Payee", "Payment", "Fees", "Type", "Interest.1", "Balance"),
        optional=("Abbreviation", "Number"),
        money=("Amount", "Rate", "Interest", "Amount.1", "Payment", "Fees", "Balance"),
    ),
    ExportKind("monthly_income_expenses", "Category,", "Income less Expenses,", required=("Category", "Total"), money=("Total",), footer_label="Income less Expenses"),
    ExportKind("income_spending", "Category,", "Grand Total,", required=("Category", "Total"), money=("Total",), footer_label="Grand Total"),
    ExportKind(
        "account_txns",
        "Num,",
        required=("Num", "Date", "Payee", "Account", "Category", "Amount"),
        optional=("C", "Memo"),
        money=("Amount",),
        footer_label="Grand Total",
    ),
)
KINDS = {k.name: k for k in EXPORT_KINDS}
# ----------------------------------------------------------------------------------------------


def list_exports(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Expand globs, sort and de-duplicate export paths."""
    found = spark.read.format("binaryFile").load(list(patterns)).select("path").distinct()
    return [r.path for r in found.orderBy("path").collect()]  # a list of file names, not data


def read_lines(spark: SparkSession, paths: Sequence[str] | str, encoding: str = "windows-1252") -> DataFrame:
    """Files -> (file, line_no, line, modified): one row per physical line, 1-based numbers.

    The text source splits large files; a line's number is its place in its block of the file plus the lines of
    earlier blocks, from a table of one row per block. The split rows are written once, so that both
    passes see the same blocks; the table is stored too: a planner that knows its size does not shuffle the lines to meet it.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("_block"),
        meta["file_modification_time"].alias("modified"),
        F.rtrim(decoded(F.col("value").cast("binary"), encoding)).alias("line"),
        F.monotonically_increasing_id().alias("_id"),
    )
    rows = cut_lineage(rows, "lines")
    blocks = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.join(cut_lineage(blocks, "blocks"), ["file", "_block"])
    return numbered.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line", "modified")


def decoded(content: Column, encoding: str) -> Column:
    """Bytes -> text. windows-1252 is Latin-1 with 27 code points exchanged, the same under any configuration."""
    if encoding.lower() in ("windows-1252", "cp1252"):
        return F.translate(F.decode(content, "ISO-8859-1"), CP1252_BYTES, CP1252_TEXT)
    return F.decode(content, encoding)


def lines_of_files(raw: DataFrame, encoding: str = "windows-1252") -> DataFrame:
    """``binaryFile`` rows (path, modificationTime, content) -> the line table (for streams of small files)."""
    text = decoded(F.col("content"), encoding)
    exploded = raw.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    return exploded.select("file", (F.col("pos") + 1).cast("long").alias("line_no"), F.rtrim("line").alias("line"), "modified")


def _marker(kind: ExportKind, line: str = "line") -> Column:
    """Is this line the header of an export of this kind?"""
    return F.col(line).startswith(kind.header_prefix) if kind.header_prefix else F.col(line).contains(kind.contains)


def _heads(lines: DataFrame, kinds: Sequence[ExportKind], order: str, *extra: Column) -> DataFrame:
    """Per file: ``_first`` = place of its first header line of any kind, ``_h{i}`` whether that line is one of kind i,
    ``_day`` the first ``As of`` date above it (anywhere in a file without a header). One aggregate, however long a
    preamble is."""
    hit = F.regexp_extract(F.col("line"), r"As of (\d{1,2}/\d{1,2}/\d{4})", 1)
    day = F.try_to_date(F.nullif(hit, F.lit("")), "M/d/yyyy")
    dated = F.min(F.when(day.isNotNull(), F.struct(F.col(order).alias("at"), day.alias("day"))))
    firsts = [F.min(F.when(_marker(k), F.col(order))).alias(f"_m{i}") for i, k in enumerate(kinds)]
    first = F.least(*[F.col(f"_m{i}") for i in range(len(kinds))])
    g = lines.groupBy("file").agg(dated.alias("_dated"), *firsts, *extra).withColumn("_first", first)
    above = F.col("_first").isNull() | (F.col("_dated.at") < F.col("_first"))
    g = g.withColumns({f"_h{i}": F.coalesce(F.col(f"_m{i}") == F.col("_first"), F.lit(False)) for i in range(len(kinds))})
    return g.withColumn("_day", F.when(above, F.col("_dated.day"))).drop("_dated", *(f"_m{i}" for i in range(len(kinds))))


def classify_exports(lines: DataFrame, kinds: Iterable[ExportKind] = EXPORT_KINDS) -> DataFrame:
    """(file, kind): the first export type whose header the file's first header line is, and whose footer it has; NULL
    kind = unrecognized (S2). A preamble may be of any length."""
    kinds = list(kinds)
    footers = [F.bool_or(F.col("line").startswith(k.footer_prefix)).alias(f"_f{i}") for i, k in enumerate(kinds) if k.footer_prefix]
    g = _heads(lines, kinds, "line_no", *footers)
    kind = F.lit(None).cast("string")
    for i, k in reversed(list(enumerate(kinds))):
        ok = F.col(f"_h{i}") & (F.col(f"_f{i}") if k.footer_prefix else F.lit(True))
        kind = F.when(ok, F.lit(k.name)).otherwise(kind)
    return g.select("file", kind.alias("kind"))


def scan_heads(spark: SparkSession, paths: Sequence[str] | str, encoding: str = "windows-1252", kinds: Iterable[ExportKind] = EXPORT_KINDS) -> DataFrame:
    """First phase of an import: (file, size, modified, kinds, as_of) from the first block of each file alone.

    ``kinds`` are the export types whose header the first header line is (those with the same header are told apart by
    their footer when the body is read); ``as_of`` is the date named above the header. Rows of later blocks are dropped at
    the scan; nothing is numbered, split or written. The header must lie in the first block.
    """
    kinds = list(kinds)
    meta = F.col("_metadata")
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths)).filter(meta["file_block_start"] == 0)
    rows = rows.select(
        meta["file_path"].alias("file"),
        meta["file_size"].alias("size"),
        meta["file_modification_time"].alias("modified"),
        decoded(F.col("value").cast("binary"), encoding).alias("line"),
        F.monotonically_increasing_id().alias("_id"),  # ascending within a block
    )
    g = _heads(rows, kinds, "_id", F.max("size").alias("size"), F.max("modified").alias("modified"))
    names = F.filter(F.array(*[F.when(F.col(f"_h{i}"), F.lit(k.name)) for i, k in enumerate(kinds)]), lambda n: n.isNotNull())
    return g.select("file", "size", "modified", names.alias("kinds"), F.col("_day").alias("as_of"))


def judge_heads(heads: DataFrame, date_from=None, date_to=None, kinds: Iterable[ExportKind] = EXPORT_KINDS) -> DataFrame:
    """``heads`` with ``opened`` and ``problem``: files of no kind, and reports of one day that don't name it, are
    problems; a dated report outside the import window is passed over; all other files are opened (S5, S6)."""
    dated = F.arrays_overlap("kinds", F.array(*[F.lit(k.name) for k in kinds if k.dated]))
    problem = F.when(F.size("kinds") == 0, F.lit("unknown kind")).when(dated & F.col("as_of").isNull(), F.lit("no as-of date"))
    inside = F.lit(True)
    if date_from is not None:
        inside = inside & (F.col("as_of") >= F.lit(date_from))
    if date_to is not None:
        inside = inside & (F.col("as_of") <= F.lit(date_to))
    return heads.withColumn("problem", problem).withColumn("opened", F.col("problem").isNull() & (~dated | F.coalesce(inside, F.lit(False))))


def open_exports(spark: SparkSession, heads: DataFrame, encoding: str = "windows-1252") -> DataFrame:
    """Second phase: the line table of the opened files alone; the scan lists no other file.

    The names of the opened files pass through the driver, as those of every file scan do.
    """
    names = [r.file for r in heads.filter("opened").select("file").orderBy("file").collect()]
    return read_lines(spark, names, encoding) if names else spark.createDataFrame([], LINE_SCHEMA)


def with_fields(df: DataFrame, line: str, out: str, width: int) -> DataFrame:
    """Add ``out`` = the CSV fields of ``line`` as an array (quotes handled, empty -> NULL).

    The line is parsed once, inside a one-element ``explode``: predicates on the fields cannot be
    pushed below a generator, so the optimizer cannot inline the parse once per field reference
    (a plain projection gets inlined into every later filter - 80 parses per line).
    """
    schema = ", ".join(f"c{i} STRING" for i in range(width))
    parse = F.from_csv(F.col(line), F.lit(schema), {"mode": "PERMISSIVE"})
    parsed = df.select("*", F.explode(F.array(parse)).alias("_csv"))
    arr = F.array(*[F.nullif(F.col("_csv").getField(f"c{i}"), F.lit("")) for i in range(width)])
    return parsed.withColumn(out, arr).drop("_csv")


def _dedupe_names(hdr: Column) -> Column:
    """Repeated header names get ``.1``, ``.2`` ... like the original reader (``Balance.1``)."""
    return F.transform(
        hdr,
        lambda x, i: F.when(
            F.size(F.filter(F.slice(hdr, 1, i), lambda y: y == x)) > 0,
            F.concat(x, F.lit("."), F.size(F.filter(F.slice(hdr, 1, i), lambda y: y == x)).cast("string")),
        ).otherwise(x),
    )


def header_positions(lines: DataFrame, kind: ExportKind, header_rows: int = 1) -> DataFrame:
    """One row per file: header line number, header names and the position of each expected column.

    The header is the first line with the kind's marker. With
    ``header_rows=2`` the line above it is a first header row whose names fill blanks of the second.
    Repeated names get ``.1``, ``.2`` ... like the original reader (``Balance.1``). The header lines are stored: what is
    asked of them reads the lines once, and a planner that knows their size does not shuffle the lines to meet them.
    """
    filled = lines.filter(F.trim(F.col("line")) != "")
    heads = filled.filter(_marker(kind)).groupBy("file").agg(F.min("line_no").alias("_hdr_no"), F.min_by("line", "line_no").alias("_hline"))
    heads = cut_lineage(heads, "heads")
    widest = heads.agg(F.max(F.regexp_count("_hline", F.lit(",")))).first()[0]  # one number
    heads = with_fields(heads, "_hline", "_hdr", (widest or 0) + 1)
    heads = heads.withColumn("_hdr", F.slice("_hdr", 1, F.greatest(F.regexp_count("_hline", F.lit(",")) + 1, F.lit(1))))
    if header_rows == 2:
        earlier = filled.join(heads.select("file", "_hdr_no"), "file").filter(F.col("line_no") < F.col("_hdr_no"))
        above = earlier.groupBy("file").agg(F.max_by("line", "line_no").alias("_aline"))
        heads = heads.join(above, "file", "left")
        heads = with_fields(heads, "_aline", "_above", (widest or 0) + 1).withColumn(
            "_hdr", F.transform(F.col("_hdr"), lambda h, i: F.coalesce(h, F.element_at(F.col("_above"), i + 1)))
        )
    heads = heads.withColumn("_hdr", _dedupe_names(F.col("_hdr")))
    expected = [*kind.required, *kind.optional]
    return heads.select(
        "file",
        "_hdr_no",
        "_hdr",
        *[F.array_position(F.col("_hdr"), F.lit(n)).cast("int").alias(f"_p{i}") for i, n in enumerate(expected)],
    )


def _fields_below(lines: DataFrame, pos: DataFrame, width: int) -> DataFrame:
    """The non-blank lines below each file's header with their fields ``_f``. The fields are made below the join: a
    projection beside their uses would be inlined into each of them."""
    filled = with_fields(lines.filter(F.trim(F.col("line")) != ""), "line", "_f", width)
    return filled.join(pos, "file").filter(F.col("line_no") > F.col("_hdr_no"))


def read_export(lines: DataFrame, kind: ExportKind, header_rows: int = 1) -> DataFrame:
    """Rows of one export type: the expected columns (text), plus file / line_no (S3).

    Lines before the header are preamble; blank lines are skipped. Columns not expected are
    dropped; rows whose expected columns are all NULL are dropped. A file without a header or
    without a required column yields no rows (see ``export_problems``). Header positions are
    resolved once per file and joined to the file's lines.
    """
    expected = [*kind.required, *kind.optional]
    pos = header_positions(lines, kind, header_rows)
    n_req = len(kind.required)
    pos = cut_lineage(pos.filter(F.least(*[F.col(f"_p{i}") for i in range(n_req)]) > 0).drop("_hdr"), "positions")
    # parse only up to the right-most column any file needs (one scalar from the per-file table)
    width = pos.agg(F.max(F.greatest(*[F.col(f"_p{i}") for i in range(len(expected))]))).first()[0] or 1
    body = _fields_below(lines, pos, int(width))
    cols = [F.when(F.col(f"_p{i}") > 0, F.element_at(F.col("_f"), F.col(f"_p{i}"))).alias(n) for i, n in enumerate(expected)]
    out = body.select("file", "line_no", *cols)
    any_value = None
    for n in expected:
        c = F.col(f"`{n}`").isNotNull()
        any_value = c if any_value is None else any_value | c
    return out.filter(any_value)


def read_asof_columns(lines: DataFrame, kind: ExportKind) -> DataFrame:
    """The ``MM/DD/YYYY`` columns of an export as rows: (file, line_no, name, Date, value text), blanks left out.

    ``name`` is the row's first required column. One row per cell, for any number of date columns.
    """
    pos = header_positions(lines, kind).filter(F.col("_p0") > 0).select("file", "_hdr_no", "_hdr", "_p0")
    width = pos.agg(F.max(F.size("_hdr"))).first()[0] or 1
    body = _fields_below(lines, pos, int(width))
    cells = body.select("file", "line_no", F.element_at("_f", F.col("_p0")).alias("name"), F.explode(F.arrays_zip("_hdr", "_f")).alias("_cell"))
    day = F.try_to_date(F.col("_cell._hdr"), "M/d/yyyy")
    cells = cells.select("file", "line_no", "name", day.alias("Date"), F.col("_cell._f").alias("value"))
    return cells.filter("Date IS NOT NULL AND value IS NOT NULL AND name IS NOT NULL")


def export_problems(lines: DataFrame, kind: ExportKind, header_rows: int = 1) -> DataFrame:
    """(file, problem) for files of this kind without a header or with missing required columns."""
    pos = header_positions(lines, kind, header_rows)
    files = lines.select("file").distinct().join(pos, "file", "left")
    missing = F.filter(
        F.array(*[F.when(F.col(f"_p{i}") == 0, F.lit(n)) for i, n in enumerate(kind.required)]), lambda x: x.isNotNull()
    )
    return files.select(
        "file",
        F.when(F.col("_hdr_no").isNull(), F.lit("header row not found"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", ")))
        .alias("problem"),
    ).filter(F.col("problem").isNotNull())


def split_footer(rows: DataFrame, label: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(data rows, footer rows): the control-total row is the one whose ``column`` equals ``label``."""
    is_footer = F.coalesce(F.col(f"`{column}`") == F.lit(label), F.lit(False))
    return rows.filter(~is_footer), rows.filter(is_footer)


def as_of_date(lines: DataFrame, fallback_mtime: bool = True, kinds: Sequence[ExportKind] = EXPORT_KINDS) -> DataFrame:
    """(file, as_of): ``As of MM/DD/YYYY`` above the file's header, however far down that is, else the file's mtime."""
    g = _heads(lines, kinds, "line_no", F.max("modified").alias("_m"))
    as_of = F.coalesce(F.col("_day"), F.to_date(F.col("_m"))) if fallback_mtime else F.col("_day")
    return g.select("file", as_of.alias("as_of"))


def prune_exports(lines: DataFrame, as_of: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Lines of files whose as-of date lies in the import window (file-level skip, S6)."""
    keep = as_of
    if date_from is not None:
        keep = keep.filter(F.col("as_of") >= F.lit(date_from))
    if date_to is not None:
        keep = keep.filter(F.col("as_of") <= F.lit(date_to))
    return lines.join(keep.select("file"), "file", "left_semi")


def write_interim(df: DataFrame, path: str) -> bool:
    """Cleaned rows to CSV with a header; nothing is left for an empty frame (S7). The rows are counted as they are
    written, so their plan runs once."""
    return write_counted(df, path, lambda rows: rows.write.mode("overwrite").option("header", True).csv(path)) > 0


LINE_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("line", T.StringType()),
        T.StructField("modified", T.TimestampType()),
    ]
)
