"""Periodic pulls of sources: what is due is a query, who runs it is decided by a claim in the shared folder.

A job's time is cut into slots of its interval. A slot is run at most once,
whoever asks: runners claim it by moving a folder of their own to the slot's name,
which file systems let one of them do. Slots that nobody ran in time are not made
up for: the latest one counts for all. A job that still runs is left alone until
its lease ends, which frees the jobs of runners that died. Waking up every now
and then is left to whatever starts the program.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def due(jobs: DataFrame, last: DataFrame, now: float) -> DataFrame:
    """``id, slot, missed`` of the jobs to run at ``now`` (seconds since 1970).

    ``jobs``: id, seconds, and ``since``, the moment the job was scheduled; ``last``: id and the
    last ``slot`` that was claimed. A job is first due one interval after it was scheduled;
    ``missed`` counts the slots before this one that nobody ran.
    """
    slot = F.floor((F.lit(now) - F.col("since")) / F.col("seconds"))
    known = last.groupBy("id").agg(F.max("slot").alias("__last"))
    found = jobs.where(F.col("seconds") > 0).withColumn("slot", slot).join(known, "id", "left").withColumn("__last", F.coalesce("__last", F.lit(0)))
    return found.where(F.col("slot") > F.col("__last")).select("id", "slot", (F.col("slot") - F.col("__last") - 1).alias("missed"))


class Claims:
    """Claimed slots under ``root``: ``job=<id>/slot=<n>`` with its runner's token, and ``done`` once it has ended."""

    def __init__(self, spark: SparkSession, root: str, lease: float = 3600.0):
        self.spark, self.root, self.lease = spark, root.rstrip("/"), lease
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _slots(self, job: str) -> list[int]:
        return [int(n.split("=")[1]) for n in self._names(f"{self.root}/{job}") if n.startswith("slot=")]

    def last(self) -> DataFrame:
        """``id, slot``: the last claimed slot of every job (one row a job)."""
        rows = [(int(job.split("=")[1]), max(slots)) for job in self._names(self.root) if job.startswith("job=") and (slots := self._slots(job))]
        return self.spark.createDataFrame(rows, "id bigint, slot bigint")

    def busy(self, job: int, now: float) -> bool:
        """Whether the job's last run goes on and its lease has not ended."""
        slots = self._slots(f"job={job}")
        names = self._names(f"{self.root}/job={job}/slot={max(slots)}") if slots else []
        return bool(names) and "done" not in names and any(now < float(n.split("=")[1]) for n in names if n.startswith("until="))

    def take(self, job: int, slot: int, now: float) -> bool:
        """Claims a slot; True for one runner only."""
        token, home = f"runner={uuid.uuid4().hex}", f"{self.root}/job={job}"
        mine = f"{home}/.{token}"
        for name in (token, f"until={now + self.lease}"):
            self._fs.create(self._path(f"{mine}/{name}")).close()
        self._fs.rename(self._path(mine), self._path(f"{home}/slot={slot}"))
        won = self._fs.exists(self._path(f"{home}/slot={slot}/{token}"))
        if not won:  # left where it was, or moved into the winner's folder
            for lost in (mine, f"{home}/slot={slot}/.{token}"):
                self._fs.delete(self._path(lost), True)
        return won

    def done(self, job: int, slot: int) -> None:
        self._fs.create(self._path(f"{self.root}/job={job}/slot={slot}/done")).close()


def run_due(jobs: DataFrame, claims: Claims, run: Callable[[int], None], now: float) -> list[int]:
    """Runs what is due and nobody else has claimed; the ids that this runner ran. A job that raises is done all the same."""
    ran = []
    for r in due(jobs, claims.last(), now).orderBy("id").toLocalIterator():
        if claims.busy(r.id, now) or not claims.take(r.id, r.slot, now):
            continue
        try:
            run(r.id)
        except Exception as error:  # the next interval tries again
            print(f"job {r.id} failed: {error!r}")
        finally:
            claims.done(r.id, r.slot)
        ran.append(r.id)
    return ran
