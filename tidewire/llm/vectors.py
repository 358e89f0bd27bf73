"""Embedding near-dedup by spherical k-means cells (operator 5).

1. Vectors that are bitwise equal become one representative with a copy count.
2. Spherical k-means is fitted on a bounded sample, chosen by a hash of the id:
   ``PER_CELL`` rows a cell, ``SAMPLE`` at least, and no more than ``SAMPLE_BYTES``.
   Cells grow with the rows, ``CELL`` of them to a cell, up to ``MAX_CELLS``. Every
   vector is assigned to its nearest centroid, its cell.
3. A vector also visits each other cell that is no further from it than half a
   link. If x (cell c) and y (cell d) have cosine >= t, then ``<y, d - c> >= 0``,
   ``<x, c - d> >= 0``, and their sum ``<y - x, d - c>`` is at most
   ``sqrt(2 - 2t) |d - c|``, so one of the two is at most half of that. y visits c
   unless ``<y, d - c>`` exceeds this half, and x likewise d: at least one end of
   every link visits the other's cell, in any dimension and however vectors lie.
4. A cell's own vectors and its visitors are compared in blocks of cosine
   products in double precision. Each of its own vectors counts its links there,
   and a visitor those to own vectors that don't visit its cell in turn (a vector
   carries a list of the cells it visits), so both ends count a link just once.
   A block returns counts and a spanning forest of its links, never pairs. Hot
   cells have many blocks of bounded size, and no task holds more than one.
5. Components of the forests give the groups; the smallest ``vec_id`` is kept.

Null or zero vectors, and those with null or non-finite parts, link with nothing
and are their own components. Vectors of each length are a table of their own:
clustered if they fill more than one cell, else one cell. Repeated rows are copies. A null ``vec_id``
sorts below all others. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm._graph import connected_components
from tidewire.llm._store import materialise, ship, small_side

THRESHOLD = 0.95
#: Rows that k-means is fitted on (in all, a cell, and the bytes of their doubles on the driver), the vectors a cell aims at, and the most cells.
SAMPLE, PER_CELL, SAMPLE_BYTES = 20_000, 16, 128 << 20
CELL, MAX_CELLS = 2048, 8192
#: Own vectors and others that one comparison task holds.
OWN_BLOCK, OTHER_BLOCK = 4096, 8192
NO_ID = -(1 << 63)


def _read(batch: pa.RecordBatch, kind: type) -> Iterator[np.ndarray | None]:
    for v in batch.column(1).to_pylist():
        x = None if v is None or any(e is None for e in v) else np.array(v, kind)
        yield x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (first by their largest part, so that no square over- or underflows)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """``k`` unit centroids of unit rows ``x``."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(x[at : at + 4096] @ centroids.T).argmax(axis=1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        empty = size < 1e-9
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        size[empty] = 1.0
        centroids = sums / size[:, None]
    return np.unique(centroids, axis=0)


def visited(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cell of every unit row, and the other cells it visits."""
    near = x @ centroids.T
    cell = near.argmax(axis=1)
    home, which = np.unique(cell, return_inverse=True)  # distances of the cells that these rows lie in
    apart = np.sqrt(np.maximum(2 - 2 * centroids[home] @ centroids.T, 0))
    reach = np.sqrt(max(0.0, 2 - 2 * threshold) + 1e-12) / 2
    gap = near[np.arange(len(x)), cell][:, None] - near
    goes = gap <= reach * apart[which] + 1e-7  # more than rounding can move either side
    goes[np.arange(len(x)), cell] = False
    return cell, [np.flatnonzero(g) for g in goes]


def _kind(column: T.DataType) -> tuple[str, type]:
    """How vectors travel: single precision as it is, everything else double. Arithmetic is always double."""
    return ("float", np.float32) if column.elementType == T.FloatType() else ("double", np.float64)


def _representatives(vectors: DataFrame) -> DataFrame:
    """``(id, high, low, width, v)``; the digest is null where a vector links with nothing."""
    ship(vectors.sparkSession)
    name, kind = _kind(vectors.schema["embedding"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, width, kept = [], [], [], []
            for x in _read(batch, kind):
                a, b = struct.unpack("<qq", xxhash.xxh3_128_digest((x + 0.0).tobytes())) if x is not None else (None, None)
                high.append(a)
                low.append(b)
                width.append(None if x is None else len(x))
                kept.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(width, pa.int32()), pa.array(kept, pa.list_(pa.from_numpy_dtype(kind)))], names=["id", "high", "low", "width", "v"])

    return vectors.mapInArrow(run, f"id bigint, high bigint, low bigint, width int, v array<{name}>")


def _rows(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    lists = table[column]
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def compare_block(
    own: np.ndarray, own_id: np.ndarray, own_copies: np.ndarray, goes: tuple[np.ndarray, np.ndarray], other: np.ndarray, other_id: np.ndarray, copies: np.ndarray, home: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each own unit vector to the others (their copies summed), of each visitor to own vectors that don't visit its cell, and a forest.

    ``goes`` has how many cells each own vector visits, and these cells; ``home`` is a visitor's cell, -1 for the cell's own.
    The forest joins every vector of a group of links to the group's smallest id.
    """
    # Which own vectors visit which of the visitors' cells.
    cells, which = np.unique(home, return_inverse=True)
    visits = np.zeros((len(own), len(cells)), bool)
    at = np.minimum(np.searchsorted(cells, goes[1]), len(cells) - 1) if len(cells) else goes[1]
    met = cells[at] == goes[1] if len(cells) else np.zeros(len(at), bool)
    visits[np.repeat(np.arange(len(own)), goes[0])[met], at[met]] = True
    visitor = np.flatnonzero(home >= 0)
    links, back = np.zeros(len(own), np.int64), np.zeros(len(other), np.int64)
    nodes = np.union1d(own_id, other_id)  # ascending, so the smallest place is the smallest id
    mine, theirs = np.searchsorted(nodes, own_id), np.searchsorted(nodes, other_id)
    parent = np.arange(len(nodes))
    for at in range(0, len(own), 256):
        some = slice(at, at + 256)
        hit = own[some] @ other.T >= threshold
        hit &= own_id[some, None] != other_id[None, :]
        links[some] = hit @ copies
        if len(visitor):
            back[visitor] += own_copies[some] @ (hit[:, visitor] & ~visits[some][:, which[visitor]])
        rows, columns = hit.any(axis=1), hit.any(axis=0)
        hit, a, b = hit[rows][:, columns], mine[some][rows], theirs[columns]
        while hit.size:
            mark = parent[a], parent[b]
            # Every row offers its group to the columns it hits, and takes the least of theirs.
            least = np.where(hit, mark[1][None, :], len(nodes)).min(axis=1)
            down = np.where(hit, mark[0][:, None], len(nodes)).min(axis=0)
            np.minimum.at(parent, mark[0], least)
            np.minimum.at(parent, mark[1], down)
            while (parent != parent[parent]).any():
                parent = parent[parent]
            if (parent[a] == mark[0]).all() and (parent[b] == mark[1]).all():
                break
    joined = np.flatnonzero(parent != np.arange(len(nodes)))
    return links, back, np.column_stack([nodes[joined], nodes[parent[joined]]])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding``)."""
    spark = vectors.sparkSession
    given = vectors.select(F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("id"), "embedding")
    read = materialise(_representatives(given), "vectors")
    reps = materialise(
        read.where("high is not null").groupBy("high", "low", "width").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")),
        "vector-classes",
    )
    large = [r.width for r in reps.groupBy("width").count().where(F.col("count") > CELL).collect()]  # few: each fills a cell
    # Lengths that fit into a cell are one each.
    rest = reps.where(~F.col("width").isin(large)).select(F.col("width").alias("cell"), F.lit(-1).alias("home"), F.array().cast("array<int>").alias("goes"), "rep", "copies", "v")
    found = _compare(rest, threshold)
    for width in large:
        found = found.unionByName(_compare(_in_cells(reps.where(F.col("width") == width), threshold, sample), threshold))
    found = materialise(found, "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other is not null"), "id", "other")
    by_class = materialise(
        reps.select("high", "low", F.col("rep"), "copies")
        .join(links.withColumnRenamed("id", "rep"), "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("high", "low", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")),
        "vector-groups",
    )
    out = read.select("id", "high", "low").join(by_class, ["high", "low"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.nullif("id", F.lit(NO_ID)).alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.nullif(component, F.lit(NO_ID)).alias("component_id"),
        (component == F.col("id")).alias("kept"),
    )


def _in_cells(reps: DataFrame, threshold: float, sample: int) -> DataFrame:
    """``(cell, home, goes, rep, copies, v)``: every vector in its own cell and in those it visits. All have one length.

    ``home`` is a visitor's own cell; it is -1 in its own cell, where ``goes`` has the cells that it visits (null elsewhere).
    """
    spark = reps.sparkSession
    total = reps.count()
    width = reps.select("width").first().width
    cells = max(1, min(MAX_CELLS, -(-total // CELL)))
    sample = max(1, min(max(sample, PER_CELL * cells), SAMPLE_BYTES // (8 * width)))
    cut = 1 << 30 if total <= sample else int(sample / total * (1 << 30))
    some = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < cut).select("rep", "v").toArrow().sort_by("rep")
    x = unit(_rows(some, "v")) if some.num_rows else unit(_rows(reps.select("v").limit(1).toArrow(), "v"))
    centroids = spark.sparkContext.broadcast(spherical_kmeans(x, cells))  # no larger than the sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                own, goes = visited(unit(_rows(batch, "v")), centroids.value, threshold)
                times = np.array([1 + len(g) for g in goes])
                take = pa.array(np.repeat(np.arange(len(own)), times))
                cells = np.concatenate([np.concatenate([[c], g]) for c, g in zip(own, goes, strict=True)])
                first = np.cumsum(times) - times
                home = np.repeat(own, times)
                home[first] = -1
                sizes = np.zeros(len(cells), np.int64)
                sizes[first] = times - 1
                absent = np.ones(len(cells), bool)
                absent[first] = False
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.delete(cells, first).astype(np.int32)), mask=pa.array(absent))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.astype(np.int32)), pa.array(home.astype(np.int32)), lists, *(batch.column(k).take(take) for k in range(3))], names=["cell", "home", "goes", "rep", "copies", "v"]
                )

    placed = reps.select("rep", "copies", "v").mapInArrow(assign, f"cell int, home int, goes array<int>, rep bigint, copies bigint, v {reps.schema['v'].dataType.simpleString()}")
    return materialise(placed, "cells")


def _compare(placed: DataFrame, threshold: float) -> DataFrame:
    """``(id, links, other)``: link counts (other null) and forest edges (links 0), block by block."""
    sizes = placed.groupBy("cell").agg(F.count_if(F.col("home") < 0).alias("owners"), F.count("*").alias("members"))
    blocks = materialise(
        sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("owners") / OWN_BLOCK)).cast("int").alias("nb"), F.ceil(F.col("members") / OTHER_BLOCK).cast("int").alias("mb")), "cell-blocks"
    )
    dealt = placed.join(small_side(blocks), "cell")
    salt = F.xxhash64("rep")
    as_other = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), F.pmod(salt, F.col("mb")).cast("int").alias("j"), F.lit(False).alias("own"), "home", F.lit(None).cast("array<int>").alias("goes"), "rep", "copies", "v")
    as_own = dealt.where("home < 0").select("cell", F.pmod(F.shiftright(salt, 20), F.col("nb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"), F.lit(True).alias("own"), "home", "goes", "rep", "copies", "v")

    def compare(group: pa.Table) -> pa.Table:
        mine = group["own"].to_numpy()
        x, ids, copies = unit(_rows(group, "v")), group["rep"].to_numpy(), group["copies"].to_numpy()
        lists = group["goes"].combine_chunks().drop_null()
        goes = (lists.value_lengths().to_numpy(), lists.flatten().to_numpy().astype(np.int64))
        counts, back, forest = compare_block(x[mine], ids[mine], copies[mine], goes, x[~mine], ids[~mine], copies[~mine], group["home"].to_numpy()[~mine], threshold)
        all_ids, all_counts = np.concatenate([ids[mine], ids[~mine]]), np.concatenate([counts, back])
        have = np.flatnonzero(all_counts)
        return pa.table(
            {
                "id": pa.array(np.concatenate([all_ids[have], forest[:, 0]])),
                "links": pa.array(np.concatenate([all_counts[have], np.zeros(len(forest), np.int64)])),
                "other": pa.concat_arrays([pa.nulls(len(have), pa.int64()), pa.array(forest[:, 1].copy())]),
            }
        )

    return as_other.unionByName(as_own).groupBy("cell", "i", "j").applyInArrow(compare, "id bigint, links bigint, other bigint")


def brute_force(ids: list[int], x: np.ndarray, threshold: float = THRESHOLD) -> tuple[dict[int, int], dict[int, int]]:
    """Links and components by id, for small tests (all vectors valid)."""
    x = unit(np.asarray(x, np.float64))
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    component = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(hit), strict=True):
            if component[ids[b]] < component[ids[a]]:
                component[ids[a]] = component[ids[b]]
                changed = True
    return {i: int(h) for i, h in zip(ids, hit.sum(axis=1), strict=True)}, component


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95 AND isfinite(list_cosine_similarity(a.e, b.e))
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), component AS (
  SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN component c ON v.vec_id = c.vec_id
"""
