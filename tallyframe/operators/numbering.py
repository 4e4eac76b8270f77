"""Dense 1..n numbering in a total order, without funnelling rows through one task.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into a single task, and a
per-key ``row_number`` puts a hot key (one date holding a third of the rows) into one task.
Instead:

1. range-partition on the full sort key (sampled bounds split even a hot leading key, since
   the trailing key columns differ) and sort inside each partition;
2. tag each row with its partition id and its position in the partition;
3. materialize that (reliable checkpoint: both later passes read the same partitioning, and
   an executor loss does not re-sample different bounds);
4. count rows per (partition, group) - at most partitions + groups rows - and turn the counts
   into offsets with a small window;
5. number = offset + position - first position of the group in that partition + 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import DENSE, cut_lineage


def range_partitions(df: DataFrame) -> int:
    """Partitions for a range shuffle of ``df``: the size of its largest input relation (the fact
    scan; join estimates without statistics are unusable) over the advisory partition size
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), at least the shuffle partitions."""
    spark = df.sparkSession
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    # file scans only: in-memory or RDD-backed relations report no real size
    scans = [leaves.apply(i) for i in range(leaves.size())]
    sizes = [int(str(p.stats().sizeInBytes())) for p in scans if p.getClass().getSimpleName() == "LogicalRelation"]
    target = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    )
    return max([base, *(-(-size // max(int(target), 1)) for size in sizes)])


def _asc(c: Column | str) -> Column:
    if isinstance(c, str):
        return F.col(c).asc_nulls_first()
    return c


def tag_positions(
    df: DataFrame,
    order_by: Sequence[Column | str],
    partition_by: Sequence[str] = (),
    num_partitions: int | None = None,
    path: str | None = None,
    keep: Sequence[str] | None = None,
    first_partition: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The materialized half of the numbering: (tagged rows, offsets).

    Rows are range-partitioned and sorted on the full key and written with their partition id
    and position (to ``path`` when given - e.g. the ledger's own fact table - else to the shared
    checkpoint folder); ``keep`` limits the written columns (sort-only columns can be dropped).
    ``offsets`` holds one row per (partition, group): where its numbers start.
    """
    spark = df.sparkSession
    n = num_partitions or range_partitions(df)
    order_by = list(dict.fromkeys(order_by)) if all(isinstance(c, str) for c in order_by) else list(order_by)
    keys = [F.col(c).asc_nulls_first() for c in partition_by] + [_asc(c) for c in order_by]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    tagged = ranged.withColumn("__nr_pid", F.spark_partition_id() + F.lit(first_partition)).withColumn("__nr_pos", F.monotonically_increasing_id())
    if keep is not None:
        tagged = tagged.select(*dict.fromkeys([*keep, *partition_by]), "__nr_pid", "__nr_pos")
    if path:
        tagged.write.mode("overwrite").parquet(path, compression=DENSE)
        tagged = spark.read.parquet(path)
    else:
        tagged = cut_lineage(tagged, "numbering", DENSE)
    return tagged, offsets_of(tagged, partition_by)


def offsets_of(tagged: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Where the numbers of each (partition, group) of tagged rows start."""
    grp = list(partition_by)
    counts = tagged.groupBy("__nr_pid", *grp).agg(F.count(F.lit(1)).alias("__nr_cnt"), F.min("__nr_pos").alias("__nr_first"))
    w = Window.partitionBy(*grp).orderBy("__nr_pid").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__nr_off", F.coalesce(F.sum("__nr_cnt").over(w), F.lit(0))).drop("__nr_cnt")


def attach_numbers(tagged: DataFrame, offsets: DataFrame, name: str = "N", partition_by: Sequence[str] = ()) -> DataFrame:
    """``name`` = offset of the row's (partition, group) + its position in it + 1."""
    grp = list(partition_by)
    renamed = {k: f"__nr_o{i}" for i, k in enumerate(["__nr_pid", *grp])}
    offsets = offsets.select(*[F.col(k).alias(v) for k, v in renamed.items()], "__nr_first", "__nr_off")
    # without groups there is one row per partition, which bounds the broadcast; with groups the planner chooses
    offsets = offsets if grp else F.broadcast(offsets)
    cond = [F.col(k).eqNullSafe(F.col(v)) for k, v in renamed.items()]
    out = tagged.join(offsets, cond).drop(*renamed.values())
    return out.withColumn(name, (F.col("__nr_off") + F.col("__nr_pos") - F.col("__nr_first") + 1).cast("long")).drop(
        "__nr_pid", "__nr_pos", "__nr_first", "__nr_off"
    )


def number_rows(
    df: DataFrame,
    order_by: Sequence[Column | str],
    name: str = "N",
    partition_by: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = 1..n in ``order_by`` order (restarting per ``partition_by`` group).

    ``order_by`` entries are column names (ascending, NULLs first) or sort Columns. Rows that tie
    on every key get consecutive numbers in an arbitrary order.
    """
    tagged, offsets = tag_positions(df, order_by, partition_by, num_partitions)
    if partition_by:  # stored: a planner that knows how few offsets there are does not shuffle the rows to meet them
        offsets = cut_lineage(offsets, "offsets")
    return attach_numbers(tagged, offsets, name, partition_by)
