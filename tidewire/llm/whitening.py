"""Embedding whitening (operator 12).

Vectors become whole numbers, ``x = floor(1024 c) + 100000``, are centred and
projected on the leading eigenvectors of their covariance, each scaled to
variance one. The eigenvectors come from a randomised range finder: a random
block of ``components + OVERSAMPLE`` directions is multiplied by the covariance
in passes over all centred rows, orthonormalised between passes, and a
Rayleigh-Ritz step on the block gives components, eigenvalues and, from the same
pass, their residuals. Once every residual is small against the gap to the next
eigenvalue (``TOLERANCE``), or no larger than the covariance's own rounding, the
components are right to double precision. If the
passes don't get there, or shrink the residuals too slowly to get there in
``PASSES``, the block is expanded to full dimension, where the step is exact.

A pass is one map over the rows whose tasks each return one partial product; the
sums of these (dimension x block numbers) are all that reaches the driver.

Rows whose vector is null, empty, or holds null or non-finite entries are
dropped. Vectors of another length are a population of their own, with their own
count, sums and components. Entries beyond a long's range saturate. Null and
repeated ids, repeated rows and extra columns don't matter: every row counts and
comes back once per component. A component without variance (one row, equal
rows, fewer rows than components) has ``whitened`` null; ``explained`` is null
where nothing varies at all, ``identity_error`` covers the components that vary
and is null if there are none. A table without such rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm._store import materialise, ship

COMPONENTS, OVERSAMPLE, PASSES, SEED = 8, 8, 6, 12
#: Largest residual, in gaps to the nearest other eigenvalue, of a component that counts as found.
TOLERANCE = 1e-12
SCALE, SHIFT = 1024.0, 100_000.0
#: Longs that every sum of this many squares and rows below fits.
SAFE = 2**62


def whole_numbers(column: pa.ListArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that count and have ``dimension`` entries, and their whole-number vectors."""
    here = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == dimension)
    values = column.take(pa.array(here)).flatten()
    entries = np.asarray(pc.fill_null(values, np.nan), np.float64).reshape(len(here), dimension)
    good = np.isfinite(entries).all(axis=1)
    x = np.floor(entries[good] * SCALE) + SHIFT
    return here[good], np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: longs, or Python's own numbers where longs don't suffice."""
    most = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    wide = n * most + max(map(abs, sums)) >= SAFE
    return x.astype(object) * n - np.array(sums, object) if wide else x * n - np.array(sums, np.int64)


def _exact(x: np.ndarray, axis: int) -> np.ndarray:
    wide = x.dtype == object or x.size and int(np.abs(x).max()) * x.shape[axis] >= SAFE
    return (x.astype(object) if wide else x).sum(axis=axis)


def _squares(d: np.ndarray) -> list[int]:
    """Exact sums of squares by row."""
    wide = d.dtype == object or d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= SAFE
    return [int(v) for v in (np.square(d.astype(object)) if wide else np.square(d)).sum(axis=1)]


def populations(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By vector length: how many vectors count, and their sums by dimension."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            column = batch.column(1)
            for d in pc.unique(pc.drop_null(pc.list_value_length(column))).to_pylist():
                if d:
                    _, x = whole_numbers(column, d)
                    now = [len(x), *map(int, _exact(x, 0))] if len(x) else [0] * (d + 1)
                    totals[d] = [a + b for a, b in zip(totals.get(d, [0] * (d + 1)), now, strict=True)]
        rows = [(d, k, Decimal(v)) for d, found in totals.items() for k, v in enumerate(found)]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["length", "place", "total"])

    sums = vectors.mapInArrow(add_up, "length int, place int, total decimal(38,0)").groupBy("length", "place").agg(F.sum("total").alias("total"))
    found: dict[int, dict[int, int]] = {}
    for r in sums.collect():  # one number a dimension
        found.setdefault(r.length, {})[r.place] = int(r.total)
    return {d: (v[0], [v[k] for k in range(1, d + 1)]) for d, v in sorted(found.items()) if v[0]}


def covariance_times(vectors: DataFrame, n: int, sums: list[int], block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance (divisor n) times a block of directions, and the covariance's trace: one pass over the rows."""
    dimension, width = block.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace = np.zeros((dimension, width)), 0.0
        for batch in batches:
            _, x = whole_numbers(batch.column(1), dimension)
            if len(x):
                centred = deviations(x, n, sums).astype(np.float64) / n
                total += centred.T @ (centred @ block)
                trace += float(np.square(centred).sum())
        values = np.append(total.ravel(), trace) / n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int64()), pa.array(values)], names=["place", "value"])

    parts = vectors.mapInArrow(multiply, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value"))
    flat = np.zeros(dimension * width + 1)
    for r in parts.collect():  # dimension x block numbers
        flat[r.place] = r.value
    return flat[:-1].reshape(dimension, width), float(flat[-1])


def rayleigh_ritz(block: np.ndarray, product: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """``wanted`` eigenvalues, falling, their unit vectors, and the worst residual as a multiple of what is allowed."""
    inner = block.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    residual = np.linalg.norm(product @ turn - (block @ turn) * values, axis=0)[:wanted]
    apart = np.abs(values[:wanted, None] - values[None, :])
    apart[np.arange(wanted), np.arange(wanted)] = np.inf
    gap = apart.min(axis=1, initial=np.inf)
    rounding = len(block) * np.finfo(float).eps * max(values[0], np.finfo(float).tiny)
    gap[np.isinf(gap)] = 0.0
    worst = float(np.max(residual / (TOLERANCE * gap + rounding), initial=0.0))
    vectors = block @ turn[:, :wanted]
    return values[:wanted], vectors / np.linalg.norm(vectors, axis=0), worst


def components(multiply: Callable[[np.ndarray], tuple[np.ndarray, float]], dimension: int, wanted: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Eigenvalues, unit eigenvectors (columns), trace, and the block's last width.

    ``multiply(block)`` returns the covariance times the block, and the trace.
    """
    wanted = min(wanted, dimension)
    width = min(wanted + oversample, dimension)
    if width < dimension:
        block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, width)))[0]
        before = np.inf
        for left in range(passes - 1, -1, -1):
            product, trace = multiply(block)
            values, vectors, worst = rayleigh_ritz(block, product, wanted)
            if worst <= 1:
                return values, vectors, trace, width
            if np.isfinite(before) and worst * min(1.0, worst / before) ** left > 1:
                break  # what is left of the passes won't do
            before = worst
            block = np.linalg.qr(product)[0]
    block = np.eye(dimension)
    product, trace = multiply(block)
    values, vectors, _ = rayleigh_ritz(block, product, wanted)
    return values, vectors, trace, dimension


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation`` (decimal), ``whitened, explained, identity_error``."""
    ship(table.sparkSession)
    vectors = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    kind = vectors.schema["vec_id"].dataType
    found = [_whiten_length(vectors, d, n, sums, wanted) for d, (n, sums) in populations(vectors).items()]
    if not found:
        columns = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return table.sparkSession.createDataFrame([], T.StructType([T.StructField("vec_id", kind), *T._parse_datatype_string(columns).fields]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _whiten_length(vectors: DataFrame, dimension: int, n: int, sums: list[int], wanted: int) -> DataFrame:
    values, directions, trace, _ = components(lambda block: covariance_times(vectors, n, sums, block), dimension, wanted)
    # Eigenvalues that rounding alone may have made are zero.
    varies = values > dimension * np.finfo(float).eps * max(trace, 0.0)
    scaled = directions / np.sqrt(np.where(varies, values, 1.0))
    schema = vectors.select("vec_id").schema.add("deviation", T.DecimalType(38, 0)).add("whitened", T.ArrayType(T.DoubleType()))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole_numbers(batch.column(1), dimension)
            exact = deviations(x, n, sums)
            out = (exact.astype(np.float64) / n) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(values), pa.int32()), pa.array(out.ravel()))
            far = pa.array([Decimal(v) for v in _squares(exact)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), far, lists], names=schema.names)

    projected = materialise(vectors.mapInArrow(project, schema), "whitened")
    error = _identity_error(projected, n, [k for k, v in enumerate(varies) if v])
    explained = F.array(*(F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in np.where(varies, values, 0.0)))
    kept = F.array(*(F.lit(bool(v)) for v in varies))
    each = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.when(F.get(kept, "at"), F.col("value")).alias("whitened"), F.get(explained, "at").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def _identity_error(projected: DataFrame, n: int, varying: list[int]) -> float | None:
    """Largest entry of the projected rows' covariance minus the identity."""
    if not varying:
        return None
    part = {k: F.get("whitened", F.lit(k)) for k in varying}
    means = projected.agg(*(F.avg(part[k]).alias(f"m{k}") for k in varying)).first()
    pairs = [(i, j) for i in varying for j in varying if i <= j]
    sums: Row = projected.agg(*(F.sum((part[i] - means[f"m{i}"]) * (part[j] - means[f"m{j}"])).alias(f"s{i}_{j}") for i, j in pairs)).first()
    return max(abs(sums[f"s{i}_{j}"] / n - (i == j)) for i, j in pairs)
