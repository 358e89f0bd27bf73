"""Periodic jobs: one runner per slot, missed slots count once, leases of dead runners end."""

from __future__ import annotations

import threading
import time

from tidewire.streaming.jobs import Claims, due, run_due

JOBS = "id bigint, seconds bigint, since double"


def test_due(spark):
    jobs = spark.createDataFrame([(1, 60, 1000.0), (2, 60, 1000.0), (3, 300, 1000.0), (4, None, 1000.0), (5, 60, 1190.0)], JOBS)
    last = spark.createDataFrame([(2, 2), (2, 1)], "id bigint, slot bigint")
    at = lambda now: {(r.id, r.slot, r.missed) for r in due(jobs, last, now).collect()}
    assert at(1059.9) == set() and at(1060.0) == {(1, 1, 0)}
    assert at(1185.0) == {(1, 3, 2), (2, 3, 0)} and at(1300.0) == {(1, 5, 4), (2, 5, 2), (3, 1, 0), (5, 1, 0)}


def test_missed_intervals_give_one_run(spark, tmp_path):
    jobs, claims, ran = spark.createDataFrame([(7, 10, 0.0)], JOBS), Claims(spark, f"file://{tmp_path}/claims"), []
    for now in (5, 10, 11, 19, 52, 53, 60):
        run_due(jobs, claims, lambda job, now=now: ran.append(now), now)
    assert ran == [10, 52, 60]


def test_two_runners_never_run_a_slot_twice(spark, tmp_path):
    jobs = spark.createDataFrame([(k, 1, 0.0) for k in range(4)], JOBS).cache()
    ran, lock = [], threading.Lock()

    def runner():
        claims = Claims(spark, f"file://{tmp_path}/claims")
        for now in range(1, 6):
            start.wait()
            run_due(jobs, claims, lambda job, now=now: lock.__enter__() and (ran.append((job, now)), lock.__exit__(None, None, None)), float(now))

    start = threading.Barrier(2)
    both = [threading.Thread(target=runner) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(ran) == [(job, now) for job in range(4) for now in range(1, 6)]
    assert not [p for p in tmp_path.rglob(".runner=*") if p.is_dir()]


def test_one_instance_and_leases(spark, tmp_path):
    jobs, claims = spark.createDataFrame([(1, 10, 0.0)], JOBS), Claims(spark, f"file://{tmp_path}/claims", lease=25.0)
    assert claims.take(1, 1, 10.0) and not claims.take(1, 1, 10.0)  # this runner dies at its work
    ran = []
    assert run_due(jobs, claims, ran.append, 21.0) == [] and claims.busy(1, 34.0)
    assert run_due(jobs, claims, ran.append, 36.0) == [1] == ran and not claims.busy(1, 36.0)

    def fails(job):
        raise OSError("no")

    assert run_due(jobs, claims, fails, 41.0) == [1] and run_due(jobs, claims, ran.append, 42.0) == [] and run_due(jobs, claims, ran.append, 51.0) == [1]


def test_a_real_clock(spark, tmp_path):
    jobs, claims, ran = spark.createDataFrame([(1, 1, time.time())], JOBS), Claims(spark, f"file://{tmp_path}/claims"), []
    ends = time.time() + 3.5
    while time.time() < ends:
        run_due(jobs, claims, ran.append, time.time())
        time.sleep(0.05)
    assert 2 <= len(ran) <= 3
