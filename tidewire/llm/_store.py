"""Shared-folder tables, code shipping and size-checked broadcasts.

Executors come and go, so whatever is read twice is written as Parquet to the
folder that the cluster names in ``spark.checkpoint.dir`` and read back: lineage
is cut and no executor holds the only copy of anything.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may hold; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch. Whole texts travel to Python, so the session's default of 10,000 is too many.
BATCH_ROWS, BATCH_SETTING = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A temporary one only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewire-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back (removed when the JVM ends)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewire-{tag}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that numbers its rows, the same whenever and wherever they are read.

    Rows of Parquet files have their file and place in it; any other frame is written first.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):  # these neither repeat nor merge rows
        plan = plan.children().head()
    if plan.children().isEmpty() and not plan.metadataOutput().isEmpty():
        with contextlib.suppress(AnalysisException):  # raised where files don't number their rows
            return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
    ids = F.monotonically_increasing_id()
    return materialise(df.select("*", F.struct(F.lit(0).cast("bigint").alias("file"), ids.alias("row")).alias(name)), "numbered")


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows stay within ``max_rows``.

    Give it a materialised frame of narrow rows. Beyond the bound the frame comes
    back unmarked and the join is shuffled (adaptive execution splits hot keys).
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they run, and bounds their batches (once a session)."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_tidewire_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        path = os.path.join(tempfile.mkdtemp(prefix="tidewire-code-"), "tidewire_code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, f"tidewire/{file.relative_to(root)}")
        context.addPyFile(path)
    context._tidewire_shipped = True


def release() -> None:
    """Gives what a Python worker no longer uses back to the machine (called when a task's rows are done).

    Workers are reused, and what they hold on to is missing for the next stage.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
