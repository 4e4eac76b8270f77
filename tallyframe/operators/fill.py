"""Filling down from marked rows as the rows lie, without dealing them out.

Parsed files are stored in the order of their lines: a task reads stretches of files that ascend, so all but a stretch's
edges is settled where it is read.

1. Each task fills down within its *runs* (rows of one key, one after the other, that ascend) and tells each row whether the
   next one is marked; its rows are written with the run's number, less those the caller has no use for.
2. The first and last row of each run are its summary. A run takes what the one before it in its key leaves, and its
   last row asks the first row of the next: one row per run, joined back to the few keys that have several.

Runs that don't follow each other in a key (rows that come in any order, places that come twice) can't be filled so:
``filled`` says so, and the caller deals the rows out (see ``operators.scan``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import DENSE, cut_lineage

MARK, RUN, FIRST, NEXT, HAS = "_mark", "_run", "_first", "_next", "_has"
#: Runs shorter than this on average are no stretches of files: the rows are dealt out instead.
SHORT = 8


def _above(name: str) -> str:
    return f"_above_{name}"


def _fill(names: Sequence[str], key: str, order: str, values: Sequence[str]):
    at = {n: i for i, n in enumerate(names)}
    out = [*names, RUN, FIRST, NEXT, HAS, *map(_above, values)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no = TaskContext.get().partitionId() << 33
        last_key, last_order, held, above = None, None, None, None

        def shown(rows: pa.RecordBatch) -> pa.RecordBatch:
            """Without the marked rows that an unmarked one follows; a run's first row stays, as its summary."""
            mark, first, ahead = (rows.column(out.index(c)) for c in (MARK, FIRST, NEXT))
            gone = mark.to_numpy(zero_copy_only=False) & ~first.to_numpy(zero_copy_only=False) & ~ahead.fill_null(True).to_numpy(zero_copy_only=False)
            return rows.filter(pa.array(~gone)) if gone.any() else rows

        def with_next(rows: pa.RecordBatch, ahead: pa.Array) -> pa.RecordBatch:
            i = out.index(NEXT)
            return pa.RecordBatch.from_arrays([ahead if j == i else rows.column(j) for j in range(len(out))], names=out)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = batch.column(at[key]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            place = batch.column(at[order]).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            mark = batch.column(at[MARK]).to_numpy(zero_copy_only=False).astype(bool)
            new = np.ones(n, bool)
            new[1:] = (codes[1:] != codes[:-1]) | (place[1:] <= place[:-1])
            new[0] = held is None or batch.column(at[key])[0].as_py() != last_key or place[0] <= last_order
            i = np.arange(n)
            begins, marked = np.maximum.accumulate(np.where(new, i, -1)), np.maximum.accumulate(np.where(mark, i, -1))
            inside = (marked >= 0) & (marked >= begins)
            before = (marked < 0) & (begins < 0) & (above is not None)  # from an earlier batch
            has = inside | before
            source = [batch.column(at[v]) for v in values]
            if above is not None:
                source = [pa.concat_arrays([a, s]) for a, s in zip(above, source, strict=True)]
            index = np.where(before, 0, marked + (above is not None))
            taken = [s.take(pa.array(index, mask=mark | ~has)) for s in source]
            ahead = np.append(mark[1:], False)
            following = pa.array(ahead, mask=np.append(new[1:], True))
            runs = no + np.cumsum(new)
            rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs), pa.array(new), following, pa.array(has), *taken], names=out)
            if held is not None:
                yield shown(with_next(held, pa.array([None if new[0] else bool(mark[0])], pa.bool_())))
            if n > 1:
                yield shown(rows.slice(0, n - 1))
            held, no, last_key, last_order = rows.slice(n - 1, 1), int(runs[-1]), batch.column(at[key])[n - 1].as_py(), int(place[-1])
            above = [s.take(pa.array([index[-1]])) for s in source] if has[-1] else None
        if held is not None:
            yield shown(held)

    return run


def filled(rows: DataFrame, key: str, order: str, mark: Column, values: Sequence[str]) -> tuple[DataFrame, dict[str, Column], Column, Column] | None:
    """(rows, value of each of ``values`` in the last marked row of the key at or above an unmarked one, whether there is one,
    whether the next row of the key is unmarked), or None where the rows don't lie in order.

    The rows are stored; marked rows with an unmarked next one may be missing from them. ``values`` of marked rows are NULL.
    """
    given = rows.withColumn(MARK, F.coalesce(mark, F.lit(False)))
    schema = T.StructType([*given.schema.fields, T.StructField(RUN, T.LongType()), *(T.StructField(c, T.BooleanType()) for c in (FIRST, NEXT, HAS))])
    schema = T.StructType([*schema.fields, *(T.StructField(_above(v), given.schema[v].dataType) for v in values)])
    stored = cut_lineage(given.mapInArrow(_fill(given.columns, key, order, values), schema), "filled", DENSE)
    own = F.struct(*(F.when(F.col(MARK), F.col(v)).otherwise(F.col(_above(v))).alias(v) for v in values))
    size = stored.agg(F.count_if(FIRST).alias("runs"), F.count(F.lit(1)).alias("n")).first()
    if size.runs * SHORT > size.n and size.runs > 1000:
        return None
    edges = stored.filter(F.col(FIRST) | F.col(NEXT).isNull()).groupBy(key, RUN).agg(
        F.min(order).alias("lo"),
        F.max(order).alias("hi"),
        F.count_if(F.col(order).isNull()).alias("placeless"),
        F.bool_or(F.when(F.col(FIRST), F.col(MARK))).alias("marked"),
        F.max_by(F.when(F.col(HAS), own), F.col(NEXT).isNull()).alias("leaves"),
    )
    w = Window.partitionBy(key).orderBy("lo")
    edges = edges.withColumns(
        {
            "_several": F.count(F.lit(1)).over(Window.partitionBy(key)) > 1,
            "_wrong": (F.lag("hi").over(w) >= F.col("lo")) | (F.col("placeless") > 0),
            "_takes": F.last("leaves", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_asks": F.lead("marked").over(w),
        }
    ).filter(F.col("_several") | F.coalesce("_wrong", F.lit(False)))
    edges = cut_lineage(edges.select(F.col(RUN).alias("_of"), F.coalesce("_wrong", F.lit(False)).alias("_wrong"), "_takes", "_asks"), "edges")
    if not edges.filter("_wrong").isEmpty():
        return None
    joined = stored.join(edges.drop("_wrong"), F.col(RUN) == F.col("_of"), "left")  # stored: the planner knows how few there are
    above = {v: F.when(F.col(HAS), F.col(_above(v))).otherwise(F.when(~F.col(MARK), F.col("_takes")[v])) for v in values}
    has = F.col(HAS) | F.col("_takes").isNotNull()
    unmarked = ~F.coalesce(F.col(NEXT), F.col("_asks"), F.lit(True))
    return joined, above, has, unmarked
