"""Open sections of sectioned reports: the stack of headers above each line, of any depth, in one pass over a file.

A line without a total opens a section; ``Total X`` closes the innermost open section if that is X. Which sections are
open on a line depends on all lines above it, so a file is cut into chunks of line numbers:

1. each chunk's section lines (only those leave their rows) are folded on an empty stack. What a chunk does to the lines
   after it is its summary: closings it could not match itself, and headers it left open. Summaries combine
   associatively, whatever the depth;
2. a scan over a file's summaries, one small row per chunk, gives each chunk the stack it starts with and settles its
   unmatched closings: they close the innermost section, name another open one (a fault), or are plain items;
3. within a chunk, a line has the stack of the last section line at or above it (a window per chunk).

Items never leave the JVM and no file is one task's work; a chunk's section lines are bounded by CHUNK.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 16
TOTAL_PREFIX = "Total "

OPEN, CLOSE, ITEM, FAULT = "open", "close", "item", "fault"

_EVENTS = T.ArrayType(T.StructType([T.StructField("line_no", T.LongType()), T.StructField("opens", T.BooleanType()), T.StructField("name", T.StringType())]))
_PENDING = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("innermost", T.BooleanType())]))
_STATES = T.ArrayType(
    T.StructType(
        [
            T.StructField("line_no", T.LongType()),
            T.StructField("role", T.StringType()),  # NULL: settled by the scan
            T.StructField("local", T.ArrayType(T.StringType())),
            T.StructField("pending", T.IntegerType()),
        ]
    )
)
_SUMMARY = T.StructType([T.StructField("pending", _PENDING), T.StructField("left_open", T.ArrayType(T.StringType())), T.StructField("states", _STATES)])


def summarize(events: list[Any]) -> tuple[list, list, list]:
    """(unmatched closings, headers left open, state after each section line) of a chunk's section lines."""
    pending, stack, states = [], [], []
    for e in sorted(events, key=lambda e: e["line_no"]):
        role = None
        if e["opens"]:
            stack.append(e["name"])
            role = OPEN
        elif stack and stack[-1] == e["name"]:
            stack.pop()
            role = CLOSE
        elif e["name"] in stack:
            role = FAULT
        else:
            pending.append((e["name"], not stack))
        states.append((e["line_no"], role, list(stack), len(pending)))
    return pending, list(stack), states


def scan(chunks: Iterator[tuple[list, list]]) -> Iterator[tuple[list[str], list[int], list[str]]]:
    """For each chunk's (unmatched closings, headers left open), in order: the stack it starts with, how many of those
    are closed after each number of unmatched closings, and what each of them turned out to be."""
    stack: list[str] = []
    for pending, left_open in chunks:
        carried, closed, roles = list(stack), [0], []
        for name, innermost in pending:
            if innermost and stack and stack[-1] == name:
                stack.pop()
                roles.append(CLOSE)
            else:
                roles.append(FAULT if name in stack else ITEM)
            closed.append(len(carried) - len(stack))
        stack = stack + list(left_open)
        yield carried, closed, roles


def _carry(file: pd.DataFrame) -> pd.DataFrame:
    file = file.sort_values("_chunk")
    steps = scan(([(p["name"], p["innermost"]) for p in pending], left) for pending, left in zip(file["pending"], file["left_open"], strict=True))
    carried, closed, roles = zip(*steps, strict=True)
    return pd.DataFrame({"_cf": file["file"], "_cc": file["_chunk"], "_carried": carried, "_closed": closed, "_roles": roles})


def open_sections(rows: DataFrame, name: str, opens: Column, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with ``_stack`` (names of the open headers, outermost first; a header's own is the last) and ``_role``.

    ``opens`` marks header lines; lines are ordered by ``line_no`` within ``file``.
    """
    title = F.col(f"`{name}`")
    closing = ~opens & F.coalesce(title.startswith(TOTAL_PREFIX), F.lit(False))
    base = rows.withColumn("_chunk", F.floor(F.col("line_no") / F.lit(chunk)))
    event = F.when(
        opens | closing,
        F.struct(F.col("line_no").cast("long").alias("line_no"), opens.alias("opens"), F.when(opens, title).otherwise(F.expr(f"substring(`{name}`, {len(TOTAL_PREFIX) + 1})")).alias("name")),
    )
    summary = F.udf(summarize, _SUMMARY)
    chunks = base.groupBy("file", "_chunk").agg(F.collect_list(event).cast(_EVENTS).alias("_events")).withColumn("_s", F.explode(F.array(summary("_events"))))
    carried = chunks.select("file", "_chunk", "_s.pending", "_s.left_open").groupBy("file").applyInPandas(
        _carry, "_cf string, _cc long, _carried array<string>, _closed array<int>, _roles array<string>"
    )
    states = chunks.select(F.col("file").alias("_sf"), F.explode("_s.states").alias("_e")).select("_sf", F.col("_e.line_no").alias("_sl"), "_e")
    x = base.join(states, (F.col("file") == F.col("_sf")) & (F.col("line_no") == F.col("_sl")), "left")
    x = x.join(carried, (F.col("file") == F.col("_cf")) & (F.col("_chunk") == F.col("_cc")), "left")
    so_far = Window.partitionBy("file", "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_now", F.last("_e", ignorenulls=True).over(so_far))
    settled = F.coalesce(F.col("_now.pending"), F.lit(0))
    kept = F.slice("_carried", 1, F.size("_carried") - F.element_at("_closed", settled + 1))
    stack = F.concat(kept, F.coalesce(F.col("_now.local"), F.array().cast("array<string>")))
    role = F.when(F.col("_e").isNull(), F.lit(ITEM)).otherwise(F.coalesce(F.col("_e.role"), F.element_at("_roles", F.greatest(settled, F.lit(1)))))
    return x.withColumns({"_stack": stack, "_role": role}).select(*rows.columns, "_stack", "_role")
