"""Session helpers: a local session for tests/bench, reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tallyframe") -> SparkSession:
    """Session for tests and the local bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Codec of stored rows and lines: smaller than the default by a quarter and more.
DENSE = "zstd"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; set a scratch one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder and is used as is.
    Only an unset session (tests, local bench) gets a fresh folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="tallyframe-ckpt-")
    sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table next to the checkpoints (shared storage on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name) if "://" not in base else f"{base.rstrip('/')}/tables/{name}"


def cut_lineage(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Materialize ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Like a reliable checkpoint (survives executor loss, cuts the lineage), but columnar: later
    passes that need a few columns read only those. ``codec``: for tables as long as the facts, where disk counts.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a location, for commits and clean-up by the driver."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_counted(df: DataFrame, path: str, write: Callable[[DataFrame], None], keep_empty: bool = False) -> int:
    """Run ``write`` on ``df`` once, counting its rows on the way; an empty output is removed again. Returns the count."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    rows = int(seen.get["rows"])
    if not rows and not keep_empty:
        fs, p = hadoop_path(df.sparkSession, path)
        fs.delete(p, True)
    return rows
