"""Line dedup with a sharded minimal perfect hash (operator 6).

1. Every line's key (blanks of ``[\\x20\\x09-\\x0D]`` stripped at both ends, A-Z
   lower-cased) is hashed to 128 bits; a document sends each key once. Counting
   documents and taking the largest ``doc_id`` per key combines on the map side.
2. Keys of at least ``min_docs`` documents are dealt to shards by hash. Each
   shard becomes one blob: a minimal perfect hash (a cascade of bit arrays with
   ranks: a key owns the first level where nothing else falls on its bit) that
   indexes an array of 64-bit fingerprints, one of counts and one of keepers.
   A probe hashes with one half of the 128 bits and compares the other half.
3. Documents probe the arrays; no line meets another line. While the blobs stay
   within ``broadcast_bytes`` (their summed size is checked) every worker holds
   them and the text never moves. Beyond that, ``(shard, key hash, doc_id)``
   probes meet their shard's blob in one cogroup, with shards small enough for
   one task and hot shards salted, and only hits travel back to the documents.
   Both ways give the same rows.

Null or empty text: one empty line, which is never dropped (it is shorter than
``min_chars``). A null ``doc_id`` counts as a document and sorts below all
others. Repeated rows count as documents of their own; rows that share the
largest ``doc_id`` all keep the line. A line repeated within one document counts
once; if it goes, all its repeats go.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm._store import materialise, release, ship, small_side

BLANKS = b" \t\n\x0b\x0c\r"
#: Total size of the blobs up to which every worker holds all of them.
BROADCAST_BYTES = 32 << 20
#: Keys that a shard aims at, and the rows of one probe task on the shuffled way.
SHARD_KEYS, PROBE_ROWS = 50_000, 500_000
#: Bits per key of a level of the perfect hash.
GAMMA = 2.0


def line_keys(text: str | None) -> list[bytes]:
    """The key of every line of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return [x.strip(BLANKS).lower() for x in data.split(b"\n")]  # bytes.lower() maps A-Z only


def _long_enough(key: bytes, min_chars: int) -> bool:
    size = len(key)
    return size >= min_chars and (size >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _hashes(key: bytes) -> tuple[int, int]:
    high, low = struct.unpack("<qq", xxhash.xxh3_128_digest(key))
    return high, low


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def build_shard(high: np.ndarray, low: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> bytes:
    """Blob of one shard; ``high`` (the hashed half) may repeat only with another ``low``."""
    keys = high.view(np.uint64)
    left = np.arange(len(keys))
    levels: list[np.ndarray] = []
    slot = np.zeros(len(keys), np.int64)
    base = 0
    while len(left) and len(levels) < 48:
        size = max(8, int(GAMMA * len(left) + 7) // 8 * 8)
        at = (_mix(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        ranks = np.cumsum(alone) - 1
        own = alone[at]
        slot[left[own]] = base + ranks[at[own]]
        base += int(alone.sum())
        levels.append(alone)
        left = left[~own]
    # Equal hashed halves (odds of n^2 / 2^65) never part: they are kept as a short list at the end.
    slot[left] = base + np.arange(len(left))
    order = np.empty(len(keys), np.int64)
    order[slot] = np.arange(len(keys))
    head = struct.pack("<qqq", len(keys), len(levels), len(left)) + b"".join(struct.pack("<q", len(x)) for x in levels)
    bits = b"".join(np.packbits(x).tobytes() for x in levels)
    return head + low[order].astype("<i8").tobytes() + keepers[order].astype("<i8").tobytes() + counts[order].astype("<i4").tobytes() + high[slot.argsort()][len(keys) - len(left) :].astype("<i8").tobytes() + bits


class Shard:
    """Reader of a blob."""

    def __init__(self, blob: bytes):
        n, depth, rest = struct.unpack_from("<qqq", blob)
        sizes = struct.unpack_from(f"<{depth}q", blob, 24)
        at = 24 + 8 * depth

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        self.prints, self.keepers, self.counts, self.rest = take("<i8", n), take("<i8", n), take("<i4", n), take("<i8", rest)
        self.levels = []
        base = 0
        for size in sizes:
            bit = np.unpackbits(take("u1", size // 8)).astype(bool)
            self.levels.append((bit, (base + np.cumsum(bit) - 1).astype(np.int32)))
            base += int(bit.sum())
        self.base = base

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of every probed key, -1 where the shard doesn't hold it."""
        found = np.full(len(high), -1, np.int64)
        open_ = np.arange(len(high))
        keys = high.view(np.uint64)
        for level, (bit, rank) in enumerate(self.levels):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(len(bit))).astype(np.int64)
            hit = bit[at]
            slots = rank[at[hit]]
            same = self.prints[slots] == low[open_[hit]]
            found[open_[hit][same]] = slots[same]
            open_ = open_[~hit]
        for k, x in enumerate(self.rest):
            same = open_[(high[open_] == x) & (low[open_] == self.prints[self.base + k])]
            found[same] = self.base + k
        return found


#: Keeper of keys whose documents all have a null doc_id.
NO_ID = -(1 << 63)


def key_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(high, low, doc_id)``, each key of a document once."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            high, low, owner = [], [], []
            for i, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                for key in set(line_keys(text)):
                    if _long_enough(key, min_chars):
                        a, b = _hashes(key)
                        high.append(a)
                        low.append(b)
                        owner.append(NO_ID if i is None else i)
            yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(owner, pa.int64())], names=["high", "low", "doc_id"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "high bigint, low bigint, doc_id bigint")


def _shard_of(shards: int) -> Column:
    return F.pmod(F.shiftright("high", 7), F.lit(shards)).cast("int")


def build_index(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> tuple[DataFrame, int]:
    """``(shard, n_keys, n_docs, blob)`` of all keys that ``min_docs`` documents share, and the shard count."""
    keys = key_table(docs, min_chars)
    common = materialise(
        keys.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs),
        "line-keys",
    )
    shards = max(1, -(-common.count() // SHARD_KEYS))

    def build(group: pa.Table) -> pa.Table:
        column = {name: group[name].to_numpy() for name in ("high", "low", "n", "keeper")}
        blob = build_shard(column["high"], column["low"], np.minimum(column["n"], 2**31 - 1), column["keeper"])
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "n_keys": pa.array([group.num_rows], pa.int64()), "n_docs": pa.array([int(column["n"].sum())], pa.int64()), "blob": pa.array([blob], pa.binary())})

    index = common.withColumn("shard", _shard_of(shards)).groupBy("shard").applyInArrow(build, "shard int, n_keys bigint, n_docs bigint, blob binary")
    return materialise(index, "line-index"), shards


def _rebuilt(text: str | None, drop: list[bool]) -> str:
    return "\n".join(x for x, gone in zip((text or "").split("\n"), drop, strict=True) if not gone)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``text`` rebuilt from the lines that stay, and ``n_lines``, ``n_dropped``."""
    spark = docs.sparkSession
    ship(spark)
    index, shards = build_index(docs, min_chars, min_docs)
    size = index.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("s")).first().s
    if size <= broadcast_bytes:
        blobs = spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in index.select("shard", "blob").collect()})
        return _rewrite(docs, None, lambda: _held_probe(blobs.value, shards), min_chars)
    hits = _cogrouped_hits(key_table(docs, min_chars), index, shards)
    marked = docs.withColumn("__at", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)))
    # One short list per document; a document's own lines bound it.
    drops = hits.groupBy("doc_id").agg(F.collect_set(F.struct("high", "low")).alias("__drop")).withColumnRenamed("doc_id", "__at")
    return _rewrite(marked.join(drops, "__at", "left").drop("__at"), "__drop", lambda: None, min_chars)


def _held_probe(blobs: dict[int, bytes], shards: int):
    opened: dict[int, Shard] = {}

    def probe(high: np.ndarray, low: np.ndarray, owner: np.ndarray) -> np.ndarray:
        at = np.mod(high >> 7, shards)
        gone = np.zeros(len(high), bool)
        for k in np.unique(at) if shards > 1 else ([0] if len(at) else []):
            if int(k) in blobs:
                if int(k) not in opened:
                    opened[int(k)] = Shard(blobs[int(k)])
                own = np.flatnonzero(at == k)
                slots = opened[int(k)].find(high[own], low[own])
                hit = slots >= 0
                gone[own[hit]] = opened[int(k)].keepers[slots[hit]] != owner[own[hit]]
        return gone

    return probe


def _cogrouped_hits(keys: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``(high, low, doc_id)`` of lines to drop, found where probes meet their shard's blob."""
    salts = index.select("shard", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / PROBE_ROWS)).cast("int").alias("salts"))
    probes = (
        keys.withColumn("shard", _shard_of(shards))
        .join(small_side(salts), "shard")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
        .select("shard", "salt", "high", "low", "doc_id")
    )
    copies = index.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "blob")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(["high", "low", "doc_id"]).slice(0, 0)
        shard = Shard(right["blob"][0].as_py())
        high, low, owner = (left[c].to_numpy() for c in ("high", "low", "doc_id"))
        slots = shard.find(high, low)
        gone = (slots >= 0) & (shard.keepers[slots] != owner)
        return left.select(["high", "low", "doc_id"]).filter(pa.array(gone))

    return probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(run, "high bigint, low bigint, doc_id bigint")


def _rewrite(docs: DataFrame, drop_column: str | None, make_probe, min_chars: int) -> DataFrame:
    columns = [c for c in docs.columns if c != drop_column]
    fields = {f.name: f for f in docs.schema.fields}
    schema = docs.select(columns).schema
    for name in ("n_lines", "n_dropped"):
        if name in columns:
            columns.remove(name)
            schema = docs.select(columns).schema
    for name in ("n_lines", "n_dropped"):
        schema = schema.add(name, T.LongType())
    assert "text" in fields and "doc_id" in fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = make_probe()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column(columns.index("text")).to_pylist()
                ids = [NO_ID if i is None else i for i in batch.column(batch.num_columns - 1 - bool(drop_column)).to_pylist()]
                keys = [line_keys(t) for t in texts]
                drops = [[False] * len(k) for k in keys]
                where, high, low, owner = [], [], [], []
                for d, lines in enumerate(keys):
                    for n, key in enumerate(lines):
                        if _long_enough(key, min_chars):
                            a, b = _hashes(key)
                            where.append((d, n))
                            high.append(a)
                            low.append(b)
                            owner.append(ids[d])
                if drop_column:
                    sets = [{(x["high"], x["low"]) for x in s or ()} for s in batch.column(batch.num_columns - 1).to_pylist()]
                    gone = [(a, b) in sets[d] for (d, _), a, b in zip(where, high, low, strict=True)]
                else:
                    gone = probe(np.array(high, np.int64), np.array(low, np.int64), np.array(owner, np.int64))
                for (d, n), g in zip(where, gone, strict=True):
                    drops[d][n] = bool(g)
                out = {c: batch.column(i) for i, c in enumerate(columns)}
                out["text"] = pa.array([_rebuilt(t, x) for t, x in zip(texts, drops, strict=True)], pa.string())
                out["n_lines"] = pa.array([len(x) for x in drops], pa.int64())
                out["n_dropped"] = pa.array([sum(x) for x in drops], pa.int64())
                yield pa.RecordBatch.from_arrays([out[f.name] for f in schema.fields], names=schema.names)
        release()

    given = docs.select(*columns, F.col("doc_id").cast("bigint").alias("__id"), *([drop_column] if drop_column else []))
    return given.mapInArrow(run, schema)


def digest(deduped: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of :func:`dedup_lines`."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], min_chars: int = 20, min_docs: int = 3) -> list[tuple[int | None, int, int, str]]:
    """Plain-Python answer for small tests."""
    seen: dict[str, list[int]] = {}
    strip = " \t\n\x0b\x0c\r"

    def key(line: str) -> str:
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))

    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            seen.setdefault(k, []).append(NO_ID if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = []
        for x in lines:
            k = key(x)
            stay.append(len(k) < min_chars or len(seen[k]) < min_docs or max(seen[k]) == (NO_ID if i is None else i))
        kept = "\n".join(x for x, s in zip(lines, stay, strict=True) if s)
        out.append((i, len(lines), stay.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return out


ORACLE = """
WITH split AS (
  SELECT doc_id, l.line, l.n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
       LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS n) l
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT s.doc_id, s.n, s.line, c.keeper IS NOT NULL AND c.keeper <> s.doc_id AS gone FROM keyed s LEFT JOIN common c ON s.k = c.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
