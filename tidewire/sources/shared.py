"""Intermediate tables in the folder that driver and executors share.

Whatever is read twice is written as Parquet and read back, which cuts lineage and
leaves no executor with the only copy of anything.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewire-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables of one computation. Superseded ones are deleted at once, the rest when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tidewire-{name}-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))
        self._made = 0

    def keep(self, table: DataFrame, tag: str, instead_of: DataFrame | None = None) -> DataFrame:
        """``table`` written and read back; then the kept table ``instead_of``, which nothing may read any more, is deleted."""
        self._made += 1
        path = f"{self.root}/{tag}-{self._made}"
        table.write.parquet(path)
        back = self.spark.read.schema(table.schema).parquet(path)
        back._scratch_path = path
        if instead_of is not None:
            self._fs.delete(self._path(instead_of._scratch_path), True)
        return back
