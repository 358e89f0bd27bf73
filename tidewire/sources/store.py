"""Versioned Parquet tables of three kinds of folders under one root.

``base=<n>`` holds a whole table, ``delta=<n>`` rows added to it, ``parts=<n>`` the
whole next state of some key parts. With a ``key`` the rows are laid out by the
key's hash in ``parts`` parts, so adding, changing or deleting rows by key reads the
parts that these keys fall in, and writes the new rows, or those parts, alone. A
part's content in a version is what the last base or parts folder with this part
holds, and what was added since. A parts folder has one row without values per
part (the mark), so that a part whose rows are all deleted is still told.

A version exists once Spark's committer has put ``_SUCCESS`` into its folder, the
last thing that a write does; there is no pointer to move. A write that dies leaves
a folder without it, which readers skip and no later write reuses. All paths go
through Spark's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART, MARK = "__part", "__mark"


class SnapshotStore:
    """One writer at a time; readers are never disturbed."""

    def __init__(self, spark: SparkSession, root: str, key: str | None = None, parts: int = 256, compact_after: int = 50):
        self.spark, self.root, self.key, self.parts, self.compact_after = spark, root.rstrip("/"), key, parts, compact_after
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self) -> list[tuple[int, str, bool]]:
        """(number, kind, complete) of every version's folder."""
        root = self._paths(self.root)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        found = [(m, name) for name in names if (m := re.fullmatch(r"(base|delta|parts)=(\d+)", name))]
        return sorted((int(m[2]), m[1], self._fs.exists(self._paths(f"{self.root}/{name}/_SUCCESS"))) for m, name in found)

    def version(self) -> int | None:
        """The last committed version, None before the first commit."""
        return max((n for n, _, complete in self._folders() if complete), default=None)

    def _chain(self, version: int) -> list[tuple[int, str]]:
        """The folders of a version: its last base and what was written since."""
        done = [(n, kind) for n, kind, complete in self._folders() if complete and n <= version]
        if version not in [n for n, _ in done]:
            raise FileNotFoundError(f"{self.root} has no committed version {version}")
        start = max((n for n, kind in done if kind == "base"), default=0)
        return [(n, kind) for n, kind in done if n >= start]

    def _parts_of(self, folder: str) -> set[int]:
        """The parts that a folder has files of (``parts`` names at most)."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._paths(f"{self.root}/{folder}"))]
        return {int(name.removeprefix(f"{PART}=")) for name in names if name.startswith(f"{PART}=")}

    def _read(self, version: int | None, only: set[int] | None = None) -> DataFrame:
        """A version's rows with their part; of the parts ``only``, where given, and no file of any other."""
        at = self.version() if version is None else version
        if at is None:
            raise FileNotFoundError(f"{self.root} has no committed version")
        chain = self._chain(at)
        if self.key is None:
            frames = [self.spark.read.parquet(f"{self.root}/{kind}={n}") for n, kind in chain]
        else:
            owner: dict[int, int] = {}
            held = {n: self._parts_of(f"{kind}={n}") for n, kind in chain}
            for n, kind in chain:
                if kind == "parts":
                    owner |= dict.fromkeys(held[n], n)
            frames = []
            for n, kind in chain:
                wanted = {p for p in held[n] if owner.get(p, 0) <= n and (only is None or p in only)}
                if wanted:
                    frame = self.spark.read.parquet(f"{self.root}/{kind}={n}").where(F.col(PART).isin(sorted(wanted)))
                    frames.append(frame.where(F.col(MARK).isNull()).drop(MARK) if kind == "parts" else frame)
            if not frames:  # no rows; the first folder tells the columns
                n, kind = chain[0]
                bare = self.spark.read.parquet(f"{self.root}/{kind}={n}").limit(0).drop(PART, MARK)
                return bare.withColumn(PART, F.lit(0))
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(version).drop(PART)

    def _write(self, table: DataFrame, kind: str) -> int:
        after = max((n for n, _, _ in self._folders()), default=0) + 1  # a failed write's number is not used again
        laid_out = table if self.key is None else table.withColumn(PART, self._part())
        writer = laid_out.write.mode("error")
        if self.key is not None and not table.isEmpty():  # without rows there would be no file that tells the columns
            writer = laid_out.repartition(PART).write.mode("error").partitionBy(PART)
        writer.parquet(f"{self.root}/{kind}={after}")
        return after

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.parts)).cast("int")

    def commit(self, table: DataFrame) -> int:
        """Writes the whole table as the next version."""
        return self._write(table, "base")

    def add_new(self, rows: DataFrame, *order: Column) -> int:
        """Adds the rows whose key is not stored yet, the first one of each key by ``order``; the version after that. Running it again adds nothing."""
        if self.key is None:
            raise ValueError("adding rows asks for a key")
        first = F.row_number().over(Window.partitionBy(self.key).orderBy(*(order or (F.lit(1),))))
        once = rows.where(F.col(self.key).isNotNull()).withColumn("__n", first).where("__n = 1").drop("__n")
        if self.version() is not None:
            touched = [r[0] for r in rows.select(self._part()).distinct().collect()]  # ``parts`` numbers at most
            known = self._read(None, set(touched)).select(self.key)
            once = once.join(known, self.key, "left_anti").select(*rows.columns)
            if once.isEmpty():
                return self.version()
        return self._compacted(self._write(once, "delta"))

    def change(self, keys: DataFrame, to: Callable[[DataFrame], DataFrame]) -> int:
        """Replaces the parts that ``keys`` (a frame with the key column) fall in by ``to(their rows)``; the version after that.

        ``to`` is a next state as in ``operators.merge``: it may change, drop and add rows,
        but no row of another part. Without keys nothing is written.
        """
        if self.key is None:
            raise ValueError("changing rows asks for a key")
        touched = {r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self._part()).distinct().collect()}  # ``parts`` numbers at most
        if not touched:
            return self.version() or 0
        now = self._read(None, touched).drop(PART)
        strange = F.raise_error(F.lit("a row of a part that no key falls in"))
        after = to(now).select(*now.columns).withColumn(PART, self._part()).withColumn(MARK, F.lit(None).cast("boolean"))
        after = after.withColumn(PART, F.when(F.col(PART).isin(sorted(touched)), F.col(PART)).otherwise(strange))
        marks = self.spark.createDataFrame([(p, True) for p in sorted(touched)], f"{PART} int, {MARK} boolean")
        version = max((n for n, _, _ in self._folders()), default=0) + 1
        both = after.unionByName(marks, allowMissingColumns=True)
        both.repartition(PART).write.mode("error").partitionBy(PART).parquet(f"{self.root}/parts={version}")
        return self._compacted(version)

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """``merge(stored, rows)``, one of ``operators.merge``, on the parts that ``rows`` fall in."""
        return self.change(rows, lambda stored: merge(stored, rows))

    def delete(self, keys: DataFrame) -> int:
        gone = keys.select(self.key).distinct()
        return self.change(gone, lambda stored: stored.join(gone, self.key, "left_anti"))

    def _compacted(self, version: int) -> int:
        return self._write(self.read(version), "base") if len(self._chain(version)) > self.compact_after else version

    def drop_before(self, version: int) -> None:
        """Deletes folders that neither ``version`` nor a later one reads."""
        kept = {n for n, _ in self._chain(version)}
        for n, kind, _ in self._folders():
            if n < version and n not in kept:
                self._fs.delete(self._paths(f"{self.root}/{kind}={n}"), True)


def cascade(gone: DataFrame, parent: SnapshotStore, children: list[tuple[SnapshotStore, str, str]]) -> None:
    """Deletes the ``gone`` keys of ``parent`` and every row that refers to what goes.

    ``children``: (store, its column, ``"parent"`` or the place of an earlier child that the
    column refers to). Each store rewrites the parts with rows that go. The last children
    go first and the parent last, so a run that dies leaves no row without its parent and
    is completed by running it again.
    """
    lost: list[DataFrame] = []
    for store, column, of in children:
        above, key = (gone, parent.key) if of == "parent" else (lost[int(of)], children[int(of)][0].key)
        lost.append(store.read().join(above.select(F.col(key).alias(column)).distinct(), column, "left_semi").select(store.key))
    for (store, _, _), keys in reversed([*zip(children, lost, strict=True)]):
        store.delete(keys)
    parent.delete(gone)
