"""The message bus as frames: typed JSON records, routing keys, dead letters, ordered micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUTING_PREFIX = "news.raw."
BATCH_ITEMS, BATCH_SECONDS = 100, 60
NEWS = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_link", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_reliability", T.StringType()),
        T.StructField("source_tags", T.ArrayType(T.StringType())),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("excerpt", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
REQUIRED = ["url", "title", "text", "source_id"]


def wire(items: DataFrame, kind: str = "source_type") -> DataFrame:
    """Records as ``(routing_key, body)`` messages."""
    return items.select(F.concat(F.lit(ROUTING_PREFIX), kind).alias("routing_key"), F.to_json(F.struct("*")).alias("body"))


def parse(messages: DataFrame, schema: T.StructType, required: list[str], body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Valid rows (all columns typed) and dead letters (the message and ``reason``), never requeued."""
    bad = "_corrupt"
    typed = messages.withColumn("__row", F.from_json(body, T.StructType([*schema.fields, T.StructField(bad, T.StringType())]), {"columnNameOfCorruptRecord": bad, "mode": "PERMISSIVE"}))
    row = F.col("__row")
    reason: Column = F.when(row.isNull() | row[bad].isNotNull(), "not json")
    for c in required:
        reason = reason.when(row[c].isNull(), f"{c} is missing")
    judged = typed.withColumn("reason", reason)
    rest = [c for c in messages.columns if c != body and c not in schema.names]
    return judged.where("reason IS NULL").select(*rest, *(row[f.name].alias(f.name) for f in schema.fields)), judged.where("reason IS NOT NULL").select(*messages.columns, "reason")


def read_topic(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    """A stream of JSON-lines deliveries ``routing_key, body`` from a folder."""
    return spark.readStream.schema("routing_key string, body string").option("maxFilesPerTrigger", max_files).json(folder)


def write_topic(items: DataFrame, folder: str) -> None:
    """Appends messages to a topic folder, by routing key."""
    wire(items).write.mode("append").json(folder)


def micro_batches(deliveries: DataFrame, key: str, at: str, order: str, items: int = BATCH_ITEMS, seconds: int = BATCH_SECONDS) -> DataFrame:
    """The batch number of every delivery in its queue: a batch closes at ``items``, or before the first delivery later than ``seconds`` after its first.

    The close depends on all deliveries before it, so this is a fold over each queue
    in order. Queues are sorted within partitions and stream through in Arrow
    batches; only the open batch's count and first time are carried, however long a
    queue is.
    """

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, batch, count, first = None, -1, 0, 0.0
        for part in parts:
            keys, times = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
            out = np.empty(len(keys), np.int64)
            at = 0
            while at < len(keys):
                if keys[at] != key_now or batch < 0 or count >= items or times[at] - first > seconds:
                    batch = 0 if keys[at] != key_now else batch + 1
                    key_now, count, first = keys[at], 0, times[at]
                to = min(len(keys), at + items - count)
                ends = np.flatnonzero((keys[at:to] != key_now) | (times[at:to] - first > seconds))
                to = at + int(ends[0]) if len(ends) else to
                out[at:to] = batch
                count += to - at
                at = to
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out)], names=["k", "o", "batch"])

    narrow = deliveries.select(F.col(key).alias("k"), F.col(order).alias("o"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"))
    schema = T.StructType(narrow.select("k", "o").schema.fields).add("batch", T.LongType())
    got = narrow.where("k IS NOT NULL AND t IS NOT NULL").repartition("k").sortWithinPartitions("k", "o").mapInArrow(fold, schema)
    return got.select(F.col("k").alias(key), F.col("o").alias(order), "batch")
