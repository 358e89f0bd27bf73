"""Structured Streaming ingest: messages to news records, exactly once per url, dead letters aside.

``foreachBatch`` adds a batch's new rows to the store before its checkpoint advances;
a failed or repeated batch is read again and changes nothing that is stored (known
urls are ignored). A batch costs what its own parts of the store hold in urls, not
the whole history. Delivery dedupe inside the stream keeps its state bounded by a
watermark, an extension of the batch semantics.

A batch that the store refuses stays unacknowledged as a whole: the query ends, and
the next start reads the same batch again. How often a batch failed is written to a
ledger beside the stream, so a restart of the program goes on counting. After the last
try the batch is set aside, whole, and the stream goes on.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.sources import bus
from tidewire.sources.store import SnapshotStore


Sink = Callable[[DataFrame, int], None]


class Ledger:
    """Failed tries by batch: one file a try, named by its number, with the error as its content."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._path = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, batch_id: int) -> str:
        return f"{self.root}/batch={batch_id}"

    def tries(self, batch_id: int) -> int:
        folder = self._path(self._folder(batch_id))
        return len(self._fs.listStatus(folder)) if self._fs.exists(folder) else 0

    def failed(self, batch_id: int, error: str) -> int:
        """Writes a failed try down; how many there are now."""
        n = self.tries(batch_id) + 1
        out = self._fs.create(self._path(f"{self._folder(batch_id)}/try={n}"), False)
        try:
            out.write(bytearray(error.encode()))
        finally:
            out.close()
        return n

    def all_tries(self) -> int:
        """Over all batches, one listing."""
        root = self._path(self.root)
        return sum(self.tries(int(s.getPath().getName().split("=")[1])) for s in self._fs.listStatus(root)) if self._fs.exists(root) else 0


@dataclass(frozen=True)
class Retries:
    """``tries``: how often a batch is tried in all (None: until it is stored); ``wait``: seconds before the next try."""

    ledger: str
    set_aside: str
    tries: int | None = None
    wait: float = 60.0


def news_sink(store: SnapshotStore, dead_letters: str) -> Sink:
    """Valid messages to the news store, which has ``url`` as its key; the others to ``dead_letters``."""

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        valid, rejected = bus.parse(batch, bus.NEWS, bus.REQUIRED)
        rejected.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}")
        store.add_new(valid.drop("routing_key"), F.col("published_at").asc_nulls_last(), F.col("title"))

    return store_batch


def counted(spark: SparkSession, sink: Sink, how: Retries) -> Sink:
    """``sink`` with its failures in the ledger; a batch that fails for the last time is set aside as it came."""
    ledger = Ledger(spark, how.ledger)

    def commit(batch: DataFrame, batch_id: int) -> None:
        try:
            if how.tries is None or ledger.tries(batch_id) < how.tries:
                sink(batch, batch_id)
                return
        except Exception as error:
            n = ledger.failed(batch_id, repr(error))
            if how.tries is None or n < how.tries:
                raise
        batch.write.mode("overwrite").parquet(f"{how.set_aside}/batch={batch_id}")

    return commit


def ingest(spark: SparkSession, topic: str, store: SnapshotStore, dead_letters: str, checkpoint: str, max_files: int = 1) -> StreamingQuery:
    """Drains a topic folder into the news store (``availableNow``); a batch that can't be stored ends the query."""
    return _start(spark, topic, news_sink(store, dead_letters), checkpoint, max_files)


def _start(spark: SparkSession, topic: str, sink: Sink, checkpoint: str, max_files: int) -> StreamingQuery:
    return bus.read_topic(spark, topic, max_files).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(spark: SparkSession, topic: str, sink: Sink, checkpoint: str, how: Retries, max_files: int = 1) -> None:
    """Everything that has arrived goes to ``sink`` or aside; returns when nothing is left.

    After a failed batch it waits and starts again at this batch. Errors that are not
    the sink's are raised.
    """
    ledger, sink = Ledger(spark, how.ledger), counted(spark, sink, how)
    while True:
        before = ledger.all_tries()
        try:
            _start(spark, topic, sink, checkpoint, max_files).awaitTermination()
            return
        except StreamingQueryException:
            if ledger.all_tries() == before:
                raise
            time.sleep(how.wait)


def distinct_deliveries(deliveries: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """A stream's deliveries, each key once within the watermark."""
    stamped = deliveries.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.dropDuplicatesWithinWatermark(keys)


def delivery_counts(deliveries: DataFrame, at: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Deliveries per window and type, late ones dropped after ``late``."""
    stamped = deliveries.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.groupBy(F.window(at, window), "event_type").agg(F.count("*").alias("n"))
