"""Pick up new export files from a folder and append their cleaned transactions.

A file stream over ``binaryFile`` yields one row per new file; each micro-batch is parsed with the
same batch code (``plans.ingest.parse_txn_exports``) and written to ``<output>/batch=<epoch>``
with overwrite, so a retried epoch replaces its own output instead of duplicating it. Files of
other export types are skipped by the classifier. The stream's checkpoint lives in the shared
checkpoint folder unless given.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import parse_txn_exports
from ..session import shared_path
from ..sources.exports import classify_exports, lines_of_files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _batch_writer(output_dir: str, encoding: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        lines = lines_of_files(batch, encoding)
        kinds = classify_exports(lines).filter(F.col("kind") == "account_txns").select("file")
        txn_lines = lines.join(kinds, "file", "left_semi")
        rows = parse_txn_exports(txn_lines).rows
        rows.write.mode("overwrite").parquet(os.path.join(output_dir, f"batch={epoch_id}"))

    return write


def stream_txn_exports(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    checkpoint: str | None = None,
    encoding: str = "windows-1252",
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the incremental ingestion; ``available_now`` processes what is there and stops."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(input_dir)
    writer = files.writeStream.foreachBatch(_batch_writer(output_dir, encoding)).option(
        "checkpointLocation", checkpoint or shared_path(spark, "stream-txn-exports")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
