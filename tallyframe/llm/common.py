"""Small helpers of the operators: shipping the package to workers, table access, typed map stages."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PACKAGE = "tallyframe.zip"


def ship(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package, wherever the driver was started."""
    sc = spark.sparkContext
    if PACKAGE not in sc._python_includes:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="tallyframe-ship-"), PACKAGE)
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in sorted(os.walk(root)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the largest file scan below ``df`` (0 for rows that come from no file)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return max([0, *(int(str(p.stats().sizeInBytes())) for p in scans if p.getClass().getSimpleName() == "LogicalRelation")])


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[list]], fields: list[tuple[str, T.DataType]]
) -> DataFrame:
    """``mapInArrow`` with ``fn`` giving the columns (lists or arrays) of the rows made from a batch."""
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])
    arrow = pa.schema([(name, _arrow(kind)) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                        for c, f in zip(columns, arrow, strict=True)
                    ],
                    schema=arrow,
                )
        release()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def release() -> None:
    """Give the memory that a task has freed back to the system: workers are reused by tasks of every kind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the C library of most Linux systems
        ctypes.CDLL(None).malloc_trim(0)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
