"""N-gram Jaccard join by MinHash banding (operator 1).

1. A text's set of ``n``-word shingles (words: runs without ``[\\x20\\x09-\\x0D]``)
   is hashed to 64 bits each. Texts with equal sets form a class with a number of
   its own; from here on one representative (a row with the smallest
   ``doc_id``) stands for it, however many copies there are. Ids may be null or
   repeat with other texts: nothing is keyed by an id alone.
2. Rows per band are the most that reach ``RECALL`` at the threshold within
   ``MAX_HASHES`` hash functions. Representatives are shuffled on band hashes; a
   band's members are tied to its smallest member, never to each other, and the
   ties' connected parts are the candidate groups.
3. Full shingle sets of candidates only are computed again and dealt to units.
   A unit is a whole candidate group, or one band bucket where dealing a group's
   buckets moves fewer sets (long chains of buckets); buckets with the same
   members are one. In a unit of more than a few dozen members, blocks of bounded
   numbers and shingles are dealt to pairs of blocks. Each pair of a unit is
   verified through postings of shared shingles. It counts if it shares a band, in
   whole groups too, so links don't depend on how groups are dealt, and it counts
   in the first unit that holds both. A task returns link counts and a spanning forest of the
   verified links, so nothing grows with the square of a unit but the comparisons
   that the counts ask for, and no task holds more than two blocks.
4. The forests' connected components are the near-duplicate classes.

Texts with 1 to ``n - 1`` words have one shingle, all their words. Null, empty
and blank texts have none: they link with nothing and are classes of their own.
Repeated rows are copies; ``keep_one`` keeps one of rows that share id and text.
A null ``doc_id`` sorts below all others. An empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm._graph import connected_components
from tidewire.llm._store import materialise, numbered, release, ship, small_side

WORDS, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9999, 192
#: Representatives of a block (a quarter of it in units of few blocks), and shingles of a block that holds several.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
NO_ID = -(1 << 63)
KEEP_WORDS = 150_000
_U = np.uint64


def choose_bands(threshold: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds pairs at the threshold with this recall."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        if hit < 1e-12:
            break
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_FACTORS = [_U((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF) for k in range(64)]


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``n``-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at [\x20\x09-\x0D]
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(n, len(w))
    size = len(w) - width + 1
    total = np.full(size, width, np.uint64)
    for k in range(width):
        total += _mixed(w[k : k + size] + _FACTORS[k % 64]) * _FACTORS[(k + 7) % 64]
    return np.unique(_mixed(total))


class Signer:
    """Band hashes of shingle sets."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20)
        self.bands, self.rows = bands, rows
        self.factor = (rng.integers(0, 1 << 32, bands * rows, np.uint64) | _U(1)).astype(np.uint32)[:, None]
        self.shift = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)[:, None]
        self.row_factor = rng.integers(0, 1 << 63, rows, np.uint64) * _U(2) + _U(1)
        self.band_shift = rng.integers(0, 1 << 63, bands, np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        x = (hashes >> _U(32)).astype(np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(least, (self.factor * x[None, at : at + 2048] + self.shift).min(axis=1), out=least)
        of_rows = _mixed(least.astype(np.uint64).reshape(self.bands, self.rows) + _U(1)) * self.row_factor
        return _mixed(of_rows.sum(axis=1, dtype=np.uint64) + self.band_shift).view(np.int64)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``(id, key, row, high, low, size, bands)`` of every numbered row (``key``: a hash of the text); ``bands`` is empty where there is no shingle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                high, low, size, hashes = [], [], [], []
                for text in some.column(3).to_pylist():
                    own = shingles(text, n)
                    a, b = struct.unpack("<qq", xxhash.xxh3_128_digest(own.tobytes()))
                    high.append(a)
                    low.append(b)
                    size.append(len(own))
                    hashes.append(sign(own) if len(own) else np.empty(0, np.int64))
                ends = np.cumsum([0] + [len(x) for x in hashes])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), some.column(2), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(hashes)))],
                    names=["id", "key", "row", "high", "low", "size", "bands"],
                )
        _WORDS.clear()
        release()

    given = docs.select(_id().alias("id"), F.xxhash64("text").alias("key"), F.col("__row").alias("row"), "text")
    return given.mapInArrow(run, "id bigint, key bigint, row struct<file: bigint, row: bigint>, high bigint, low bigint, size bigint, bands array<bigint>")


def verify_blocks(
    ids: np.ndarray, copies: np.ndarray, block: np.ndarray, sets: list[np.ndarray], pair: tuple[int, int], threshold: float, before: list[set[int]] | None = None, bands: np.ndarray | None = None
) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Link counts by id, and a spanning forest of the links, among the rows of two blocks of a unit.

    With ``pair`` (k, k) all pairs of block k are compared, else those across the two blocks.
    ``before``: units of each row that count before this one; pairs that share any are left to it.
    ``bands``: band hashes by row; pairs that share none don't count.
    """
    left = np.flatnonzero(block == pair[0])
    right = left if pair[0] == pair[1] else np.flatnonzero(block == pair[1])
    if not len(left) or not len(right):
        return {}, []
    size = np.array([len(s) for s in sets])
    values = np.concatenate([sets[k] for k in left])
    owner = np.repeat(np.arange(len(left)), size[left])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    links = np.zeros(len(ids), np.int64)
    group = np.arange(len(ids))
    forest = []
    for r in right:
        first = np.searchsorted(values, sets[r], "left")
        count = np.searchsorted(values, sets[r], "right") - first
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(owner[at], minlength=len(left))
        union = size[left] + size[r] - shared
        found = left[shared >= threshold * union - 1e-9]
        found = found[found != r]
        if bands is not None:
            found = found[(bands[found] == bands[r]).any(axis=1)]
        if before and before[r]:
            found = found[[before[r].isdisjoint(before[k]) for k in found]] if len(found) else found
        links[r] += copies[found].sum()
        if pair[0] != pair[1]:
            links[found] += copies[r]
        met, at = np.unique(group[found], return_index=True)
        new = met != group[r]
        if new.any():
            forest += zip(ids[found[at[new]]].tolist(), [int(ids[r])] * int(new.sum()), strict=True)
            group[np.isin(group, met[new])] = group[r]
    return {int(ids[k]): int(links[k]) for k in np.flatnonzero(links)}, forest


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, copy_of, n_links, kept`` of every row of ``docs`` (``doc_id, text``).

    ``class_id``: smallest doc_id reachable by links; ``copy_of``: smallest doc_id
    with the same shingle set; ``n_links``: other rows linked directly, copies
    included; ``kept``: the row has its class's smallest doc_id.
    """
    joined = _grouped(numbered(docs.select("doc_id", "text"), "__row"), n, threshold, recall)
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    empty = F.col("size") == 0

    def known(c: str):
        return F.when(empty, F.col("id")).otherwise(F.col(c))

    return joined.select(
        own.alias("doc_id"),
        F.nullif(known("component"), F.lit(NO_ID)).alias("class_id"),
        F.nullif(known("rep"), F.lit(NO_ID)).alias("copy_of"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
        (known("component") == F.col("id")).alias("kept"),
    )


def _grouped(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """``(id, key, row, size, rep, component, component_key, n_links)`` of every row of numbered ``docs``; the last four are null without shingles.

    ``rep``: the smallest id of the row's class; ``component, component_key``: the smallest id, and its text's key, of all classes reachable.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = materialise(signatures(docs, n, bands, rows), "signatures")
    first = F.min(F.struct("id", "key", "row"))
    classes = signed.where("size > 0").groupBy("high", "low").agg(first.alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    # Numbered once: the numbers are read back from here on.
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "high", "low", F.col("first.id").alias("rep"), F.col("first.key").alias("key"), F.col("first.row").alias("row"), "copies", "size", "bands"), "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    ties = banded.join(shared, "band").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    units = _units(classes, materialise(connected_components(ties), "groups"))
    dealt = materialise(units.join(classes.select("node", F.col("row").alias("__row"), "copies", "bands"), "node"), "dealt")
    verified = materialise(_verify(docs, dealt, n, threshold), "verified")
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(verified.where("other is not null"), "id", "other")
    least = components.join(classes.select("node", "rep", "key"), "node").groupBy("component").agg(F.min(F.struct("rep", "key")).alias("least"))
    by_class = materialise(
        classes.select("node", "high", "low", "rep", "key", "copies")
        .join(links.withColumnRenamed("id", "node"), "node", "left")
        .join(components.join(least, "component"), "node", "left")
        .withColumn("least", F.coalesce("least", F.struct("rep", "key")))
        .select(
            "high", "low", "rep", F.col("least.rep").alias("component"), F.col("least.key").alias("component_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
        ),
        "by-class",
    )
    return signed.select("id", "key", "row", "size", "high", "low").join(by_class, ["high", "low"], "left")


def _blocks(n: Column, widest: Column) -> Column:
    """Blocks of a unit of ``n`` members with up to ``widest`` shingles: of BLOCK members where there are many, of a quarter where they would be few."""
    size = F.least(F.lit(float(BLOCK)), F.greatest(F.lit(BLOCK / 4), n / 32))
    return F.greatest(F.ceil(n / size), F.least(n, F.ceil(n * widest / BLOCK_SHINGLES))).cast("int")


def _units(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """``(node, units)``: the units (``unit, blocks``, ascending) that each candidate is dealt to.

    A group is one unit, or its distinct buckets are, whichever copies fewer sets.
    """
    whole = groups.join(classes.select("node", "size"), "node").groupBy("component").agg(F.count("*").alias("n"), F.max("size").alias("widest"))
    whole = materialise(whole.withColumn("blocks", _blocks(F.col("n"), F.col("widest"))), "whole-units")
    # Groups of one block are cheapest as they are.
    large = whole.where("blocks > 1").select("component", "widest", (F.col("n") * F.col("blocks")).alias("whole_cost"))
    banded = groups.join(large, "component").join(classes.select("node", "bands"), "node").select("node", "component", "widest", "whole_cost", F.explode("bands").alias("band"))
    members = F.bit_xor(F.xxhash64("node")).alias("members")
    buckets = banded.groupBy("component", "widest", "whole_cost", "band").agg(F.count("*").alias("n"), members, F.min("node").alias("least")).where("n > 1")
    apart = buckets.groupBy("component", "widest", "whole_cost", "n", "members", "least").agg(F.min("band").alias("unit")).withColumn("blocks", _blocks(F.col("n"), F.col("widest")))
    apart = materialise(apart, "distinct-buckets")
    cheaper = apart.groupBy("component", "whole_cost").agg(F.sum(F.col("n") * F.col("blocks")).alias("cost")).where("cost < whole_cost").select("component")
    cheaper = materialise(cheaper, "bucket-groups")
    dealt = groups.join(whole.join(cheaper, "component", "left_anti"), "component").select("node", F.col("component").alias("unit"), "blocks")
    if cheaper.limit(1).count():
        chosen = apart.join(cheaper, "component", "left_semi").select(F.col("unit").alias("band"), "blocks")
        dealt = dealt.unionByName(banded.join(chosen, "band").select("node", F.col("band").alias("unit"), "blocks"))
    return dealt.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("unit", "blocks"))).alias("units"))  # a unit for each band at most


def _verify(docs: DataFrame, dealt: DataFrame, n: int, threshold: float) -> DataFrame:
    """``(id, links, other)``: link counts (other null) and forest edges (links 0)."""
    given = docs.select("__row", "text").join(small_side(dealt), "__row")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                own = [shingles(t, n) for t in some.column(4).to_pylist()]
                ends = np.cumsum([0] + [len(s) for s in own])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(4)), lists], names=["id", "copies", "units", "bands", "hashes"])
        _WORDS.clear()
        release()

    sized = given.select(F.col("node").alias("id"), "copies", "units", "bands", "text").mapInArrow(
        sets, "id bigint, copies bigint, units array<struct<unit: bigint, blocks: int>>, bands array<bigint>, hashes array<bigint>"
    )
    in_units = sized.select("id", "copies", "bands", "hashes", F.col("units.unit").alias("units"), F.explode("units").alias("u")).select("id", "copies", "bands", "hashes", "units", "u.unit", "u.blocks")
    pairs = (
        in_units.withColumn("block", F.pmod(F.xxhash64("id", "unit"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("unit", F.least("block", "with").alias("lower"), F.greatest("block", "with").alias("upper"), "id", "copies", "units", "bands", "block", "hashes")
    )

    def compare(group: pa.Table) -> pa.Table:
        ids, lists = group["id"].to_numpy(), group["hashes"].combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        own = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        unit, pair = group["unit"][0].as_py(), (group["lower"][0].as_py(), group["upper"][0].as_py())
        before = [{u for u in units if u < unit} for units in group["units"].to_pylist()]
        bands = np.asarray(group["bands"].combine_chunks().flatten()).reshape(len(ids), -1)
        counts, forest = verify_blocks(ids, group["copies"].to_numpy(), group["block"].to_numpy(), own, pair, threshold, before, bands)
        return pa.table(
            {
                "id": pa.array([*counts, *(a for a, _ in forest)], pa.int64()),
                "links": pa.array([*counts.values(), *(0 for _ in forest)], pa.int64()),
                "other": pa.array([*(None for _ in counts), *(b for _, b in forest)], pa.int64()),
            }
        )

    return pairs.groupBy("unit", "lower", "upper").applyInArrow(compare, "id bigint, links bigint, other bigint")


def keep_one(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each near-duplicate class, columns unchanged.

    What goes is found by row numbers, so whole texts are shuffled only where the
    numbers of the rows that go are too many to broadcast.
    """
    rows = numbered(docs, "__row")
    grouped = _grouped(rows.select("doc_id", "text", "__row"), n, threshold, recall)
    stays = (F.col("size") == 0) | ((F.col("id") == F.col("component")) & (F.col("key") == F.col("component_key")))
    # Rows that repeat an id and its text are one document.
    kept = grouped.where(stays).groupBy("id", "key").agg(F.min("row").alias("row")).select("row")
    gone = materialise(grouped.select("row").join(kept, "row", "left_anti").withColumnRenamed("row", "__row"), "gone")
    return rows.join(small_side(gone), "__row", "left_anti").drop("__row")


ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y, c = p.n AND c = q.n AS same FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), classes AS (
  SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x
), linked AS (
  SELECT x AS doc_id, count(*) AS n_links, min(CASE WHEN same THEN y END) AS twin FROM links GROUP BY x
)
SELECT d.doc_id, c.class_id, least(d.doc_id, coalesce(l.twin, d.doc_id)) AS copy_of, coalesce(l.n_links, 0) AS n_links, d.doc_id = c.class_id AS kept
FROM documents d JOIN classes c ON c.doc_id = d.doc_id LEFT JOIN linked l ON l.doc_id = d.doc_id
"""
