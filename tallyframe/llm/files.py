"""Files that tasks write and read in the shared folder: any file system that pyarrow opens by URI.

A file is written under a temporary name and renamed when it is whole, so a lost or repeated task leaves
either no file of that name or a whole one. What belongs to a data set is what its manifest lists.
"""

from __future__ import annotations

import bisect
import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import shared_path


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a URI or a plain path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints."""
    uri = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    filesystem, path = opened(uri)
    filesystem.create_dir(path, recursive=True)
    return uri


def put(folder: str, name: str, write: Callable[[pa.NativeFile], None]) -> str:
    """Write ``folder/name`` through a temporary name; returns its URI."""
    filesystem, path = opened(folder)
    temporary = f"{path}/_tmp-{uuid.uuid4().hex}"
    with filesystem.open_output_stream(temporary) as out:
        write(out)
    filesystem.move(temporary, f"{path}/{name}")
    return f"{folder}/{name}"


def range_bounds(keys: DataFrame, key: str, partitions: int, per_partition: int = 32) -> list:
    """Up to ``partitions`` - 1 upper bounds that cut the distinct keys into ranges of about equal size.

    They depend on the keys alone, not on how the rows are dealt out: the keys whose hash falls in a
    share of about ``partitions * per_partition`` of all are the sample (that is what reaches the driver).
    """
    ids = keys.select(key).filter(F.col(key).isNotNull())
    share = max(1, ids.count() // (partitions * per_partition))
    sample = sorted(r[0] for r in ids.filter(F.pmod(F.xxhash64(key), F.lit(share)) == 0).distinct().collect())
    return sorted({sample[i * len(sample) // partitions] for i in range(1, partitions)}) if sample else []


def by_range(df: DataFrame, key: str, bounds: list, partitions: int) -> DataFrame:
    """``df`` dealt out by ``bounds``: partition i holds the keys up to bound i; nulls go to the first."""

    @F.arrow_udf(T.IntegerType())
    def place(values: pa.Array) -> pa.Array:
        if pa.types.is_integer(values.type):
            first = np.iinfo(np.int64).min
            at = np.searchsorted(np.array(bounds, np.int64), values.cast(pa.int64()).fill_null(first).to_numpy())
            return pa.array(at.astype(np.int32))
        return pa.array([0 if v is None else bisect.bisect_left(bounds, v) for v in values.to_pylist()], pa.int32())

    return df.repartitionById(partitions, place(F.col(key)))


def read_stream(uri: str) -> io.BufferedReader:
    filesystem, path = opened(uri)
    return io.BufferedReader(filesystem.open_input_file(path), 1 << 20)


def commit(manifest: DataFrame, folder: str) -> DataFrame:
    """Run the writing job: the rows of its manifest, committed as a table beside the files."""
    manifest.write.parquet(f"{folder}/_manifest")
    return manifest.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def map_files(
    manifest: DataFrame, fn: Callable[[str], Iterator[list]], fields: list[tuple[str, T.DataType]], partitions: int
) -> DataFrame:
    """``fn`` over the files that a manifest lists, dealt out over tasks; it yields columns of row batches."""
    from tallyframe.llm.common import map_batches

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for uri in batch.column("file").to_pylist():
            yield from fn(uri)

    return map_batches(manifest.select("file").repartition(partitions, F.col("file")), run, fields)
