"""Ordered running aggregates per key (forward fill, running sum) that never put a whole key in
one task.

Order-dependent cleaning needs "the last header above this line" or "the depth so far" within an
export file. A window partitioned by file would send a huge file to a single task. Instead:

1. lines are cut into fixed chunks of ``chunk`` line numbers: (key, chunk) is a deterministic
   hash-partitioning key, so a hot file spreads over many tasks;
2. the running aggregates are computed inside each chunk (window over (key, chunk));
3. each chunk is summarized (its last non-null value, its sum) - one row per chunk;
4. a window over the small chunk table (per key, ordered by chunk) gives the carry-in of every
   chunk; it is joined back on (key, chunk), the partitioning the lines already have.

Everything is deterministic (no sampled range bounds), so no materialization is needed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_LINES = 1 << 20


def running(
    df: DataFrame,
    key: str,
    order: str,
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    chunk: int | None = None,
    next_is: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add, per ``key`` in ``order`` (inclusive of the current row):

    * ``last[name]``: the last non-NULL value of the expression so far (forward fill);
    * ``total[name]``: the running sum of the expression;
    * ``next_is[name]``: whether the expression holds in the row that follows (rows of one place are asked together).
    """
    last, total, next_is = dict(last or {}), dict(total or {}), dict(next_is or {})
    chunk = chunk or CHUNK_LINES
    base = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    for n, c in last.items():
        base = base.withColumn(f"_lv_{n}", c)
    for n, c in total.items():
        base = base.withColumn(f"_tv_{n}", c)
    for n, c in next_is.items():
        base = base.withColumn(f"_bv_{n}", F.coalesce(c, F.lit(False)))
    w = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_l_{n}": F.last(f"_lv_{n}", ignorenulls=True).over(w) for n in last}
    local.update({f"_s_{n}": F.sum(f"_tv_{n}").over(w) for n in total})
    ahead, place = Window.partitionBy(key, "_chunk").orderBy(order), Window.partitionBy(key, "_chunk", order)
    x = base.withColumns(local | {f"_b_{n}": F.lead(f"_bv_{n}").over(ahead) for n in next_is})
    # a chunk's last row asks the first one of the next chunk
    x = x.withColumns({f"_e_{n}": F.bool_or(F.col(f"_b_{n}").isNull()).over(place) for n in next_is} | {f"_b_{n}": F.bool_or(f"_b_{n}").over(place) for n in next_is})
    # one row per chunk, straight from the input with a partial (map-side) aggregate - no sort:
    # the chunk's last non-NULL value (by order) and its sum
    aggs = [F.max(F.when(F.col(f"_lv_{n}").isNotNull(), F.struct(F.col(order).alias("o"), F.col(f"_lv_{n}").alias("v")))).getField("v").alias(f"_cl_{n}") for n in last]
    aggs += [F.sum(f"_tv_{n}").alias(f"_cs_{n}") for n in total]
    aggs += [F.min(F.struct(F.col(order).alias("o"), F.col(f"_bv_{n}").alias("v"))).getField("v").alias(f"_cb_{n}") for n in next_is]
    summary = base.groupBy(key, "_chunk").agg(*aggs)
    cw = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        F.col(key).alias("_ck"),
        F.col("_chunk").alias("_cc"),
        *[F.last(f"_cl_{n}", ignorenulls=True).over(cw).alias(f"_k_{n}") for n in last],
        *[F.sum(f"_cs_{n}").over(cw).alias(f"_t_{n}") for n in total],
        *[F.lead(f"_cb_{n}").over(Window.partitionBy(key).orderBy("_chunk")).alias(f"_a_{n}") for n in next_is],
    )
    j = x.join(carry, (F.col(key) == F.col("_ck")) & (F.col("_chunk") == F.col("_cc")), "left")
    outs = {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_k_{n}")) for n in last}
    outs.update({n: F.col(f"_s_{n}") + F.coalesce(F.col(f"_t_{n}"), F.lit(0)) for n in total})
    outs.update({n: F.coalesce(F.col(f"_b_{n}"), F.lit(False)) | (F.col(f"_e_{n}") & F.coalesce(F.col(f"_a_{n}"), F.lit(False))) for n in next_is})
    drop = ["_chunk", "_ck", "_cc", *[p + n for n in last for p in ("_lv_", "_l_", "_k_")], *[p + n for n in total for p in ("_tv_", "_s_", "_t_")], *[p + n for n in next_is for p in ("_bv_", "_b_", "_e_", "_a_")]]
    return j.withColumns(outs).drop(*drop)
