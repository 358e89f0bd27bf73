"""Bounds on what one Arrow batch hands to a Python worker."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch of whole texts. The session's defaults, 10,000 rows and 64 MB, let a worker hold a whole partition with all results.
ROWS, BYTES = 1_000, 8 << 20
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES}


def bound() -> None:
    """Lowers the session's batches to these bounds where they are wider; results don't depend on it."""
    conf = SparkSession.active().conf
    for setting, most in SETTINGS.items():
        now = conf.get(setting)
        if not 0 < int(now.removesuffix("b")) <= most:
            conf.set(setting, str(most))
