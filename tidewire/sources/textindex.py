"""A trigram index for case-insensitive substring search.

A run of three characters of a row's lower-cased texts is a number, its code points
side by side. Some hundred rows at a time, every run gets a posting with the keys of
the rows that hold it; postings are dealt by run and sorted by it, so that a search
reads the pages of its own trigrams only. A text that holds a term holds all the
term's trigrams: the keys that the term's rarest trigrams have in common are a
superset of the matches, and only their rows are put to the exact test. Keys come as
few ranges, which reach the table's scan and skip its row groups.

Terms of fewer than three characters, and terms whose rarest trigram lies in more
than ``SCAN_SHARE`` of all rows, prune nothing. Rows that are added are indexed by
themselves (a delta); rows that are deleted are no longer met in the table, so their
postings don't matter. A delta exists once its last folder is committed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.sources.shared import Scratch

#: Trigrams that a search reads postings of, and the share of rows from which it scans instead.
RAREST, SCAN_SHARE = 4, 0.2
#: Keys that are turned into ranges for the table's scan, and the ranges; more keys meet the table in a join.
MOST_KEYS, RANGES = 10_000, 64
#: Characters that are turned into postings at a time (one row may hold more), and the bits of a code point.
CHUNK_CHARS, BITS = 2_000_000, 21


def trigrams(text: str) -> list[int]:
    """The numbers of all runs of three characters of a lower-cased text, each once."""
    codes = [ord(c) for c in text]
    return sorted({(a << 2 * BITS) | (b << BITS) | c for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)})


def _pairs(texts: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``(gram, row)``: every run of the rows' texts, once a row, in this order."""
    codes = [np.frombuffer("".join(t.fill_null("").to_pylist()).encode("utf-32-le"), np.uint32) for t in texts]
    owner = np.concatenate([np.repeat(np.arange(rows) + k * rows, pc.utf8_length(t.fill_null("")).to_numpy(zero_copy_only=False)) for k, t in enumerate(texts)])
    codes = np.concatenate(codes)
    met = np.zeros(1 << BITS, bool)
    met[codes] = True
    alphabet = np.flatnonzero(met)
    size = len(alphabet)
    if rows > 1 and size**3 * rows >= 1 << 62:  # numbers within the chunk's own alphabet would overflow
        half = rows // 2
        (g, r), (h, q) = (_pairs([t.slice(at, n) for t in texts], n) for at, n in ((0, half), (half, rows - half)))
        order = np.lexsort((np.concatenate((r, q + half)), np.concatenate((g, h))))
        return np.concatenate((g, h))[order], np.concatenate((r, q + half))[order]
    small = (np.cumsum(met) - 1)[codes]
    whole = np.flatnonzero(owner[:-2] == owner[2:]) if len(codes) > 2 else np.zeros(0, np.int64)
    gram = (small[whole] * size + small[whole + 1]) * size + small[whole + 2]
    both = np.sort(gram * rows + owner[whole] % rows)
    both = both[np.diff(both, prepend=-1) > 0]
    gram, row = np.divmod(both, rows)
    high, low = np.divmod(gram, max(size, 1))
    first, middle = np.divmod(high, max(size, 1))
    return (alphabet[first] << 2 * BITS) | (alphabet[middle] << BITS) | alphabet[low] if size else gram, row


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns rows of a key and lower-cased texts into rows ``gram, n, keys``, one per run and chunk."""
    for batch in batches:
        chars = sum(pc.utf8_length(t.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64) for t in batch.columns[1:])
        ends, at = np.cumsum(chars), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_CHARS, "right")))
            key, *texts = batch.slice(at, end - at).columns
            gram, row = _pairs(texts, len(key))
            starts = np.flatnonzero(np.diff(gram, prepend=-1))
            borders = np.append(starts, len(gram))
            keys = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), key.take(pa.array(row)))
            yield pa.RecordBatch.from_arrays([pa.array(gram[starts], pa.int64()), pa.array(np.diff(borders), pa.int64()), keys], ["gram", "n", "keys"])
            at = end


class TextIndex:
    """``texts`` are expressions over the table's columns; ``key`` identifies its rows."""

    def __init__(self, spark: SparkSession, root: str, texts: list[Column], key: str = "id"):
        self.spark, self.root, self.texts, self.key = spark, root.rstrip("/"), texts, key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _deltas(self, complete: bool = True) -> list[str]:
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        found = sorted(int(n.split("=")[1]) for n in names if n.startswith("delta="))
        return [f"{self.root}/delta={n}" for n in found if not complete or self._fs.exists(self._path(f"{self.root}/delta={n}/counts/_SUCCESS"))]

    def add(self, rows: DataFrame) -> None:
        """Indexes ``rows``, which are not indexed yet."""
        last = self._deltas(complete=False)
        folder = f"{self.root}/delta={int(last[-1].rsplit('=', 1)[1]) + 1 if last else 1}"
        key = rows.schema[self.key].dataType
        lowered = (F.lower(t).alias(f"text_{k}") for k, t in enumerate(self.texts))
        given = rows.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), *lowered)
        kind = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(key))])
        postings = given.mapInArrow(_postings, kind)
        # A run that every row holds has a posting per chunk, no more than any other run of that chunk.
        postings.repartition("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/postings")
        self.spark.range(1).select(F.lit(rows.count()).alias("rows")).write.parquet(f"{folder}/rows")
        counts = self.spark.read.parquet(f"{folder}/postings").groupBy("gram").agg(F.sum("n").alias("n"))
        counts.sortWithinPartitions("gram").write.parquet(f"{folder}/counts")

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{d}/{what}" for d in self._deltas()))

    def keys(self, term: str) -> DataFrame | None:
        """``key`` of the rows that may hold ``term``; None where the index can't tell."""
        grams = trigrams(self.spark.range(1).select(F.lower(F.lit(term))).first()[0])  # lower-cased as the rows are
        if not grams or not self._deltas():
            return None
        counts = {r.gram: r.n for r in self._read("counts").where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a term's trigrams
        rarest = sorted(grams, key=lambda g: counts.get(g, 0))[:RAREST]
        if counts.get(rarest[0], 0) > SCAN_SHARE * (self._read("rows").agg(F.sum("rows").alias("n")).first().n or 0):
            return None
        found = self._read("postings").where(F.col("gram").isin(rarest)).select("gram", F.explode("keys").alias("key"))
        return found.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("key")

    def prune(self, table: DataFrame, term: str) -> DataFrame:
        """``table`` without rows that can't hold ``term`` (the exact test is still to come)."""
        found = self.keys(term)
        if found is None:
            return table
        found = Scratch(self.spark, "search").keep(found.withColumnRenamed("key", self.key), "keys")
        some = [r[0] for r in found.limit(MOST_KEYS + 1).collect()]
        if len(some) > MOST_KEYS:
            return table.join(found, self.key, "left_semi")
        if isinstance(table.schema[self.key].dataType, T.IntegralType):
            table = table.where(_ranges(F.col(self.key), sorted(some)))
        return table.join(F.broadcast(found), self.key, "left_semi")


def _ranges(key: Column, values: list[int]) -> Column:
    """A condition of at most ``RANGES`` ranges that hold all values, cut at the widest gaps."""
    if not values:
        return F.lit(False)
    gaps = sorted(range(1, len(values)), key=lambda k: values[k - 1] - values[k])[: RANGES - 1]
    cuts = [0, *sorted(gaps), len(values)]
    out = F.lit(False)
    for a, b in zip(cuts, cuts[1:], strict=False):
        out = out | key.between(values[a], values[b - 1])
    return out
