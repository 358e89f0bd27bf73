"""Batches that the store refuses: tried again whole, counted across restarts, set aside in the end."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.errors import StreamingQueryException

from tidewire.sources.store import SnapshotStore
from tidewire.streaming import ingest as streaming


@pytest.fixture
def topic(tmp_path):
    folder = tmp_path / "topic"
    folder.mkdir()
    for k in range(3):
        item = lambda u: {"schema_version": 1, "source_id": "s", "url": u, "title": "t", "text": "x"}
        lines = [json.dumps({"routing_key": "news.raw.rss", "body": json.dumps(item(f"{k}-{n}"))}) for n in range(2)]
        (folder / f"{k}.json").write_text("\n".join(lines))
        time.sleep(0.02)  # files are read by age
    return str(folder)


def retries(tmp_path, **how):
    return streaming.Retries(f"file://{tmp_path}/ledger", f"file://{tmp_path}/aside", **({"tries": 3, "wait": 0.2} | how))


def flaky(store, dead, times, broken=1, seen=None):
    """A sink that fails ``times`` times on batch ``broken`` after it has begun to work."""
    real, left = streaming.news_sink(store, dead), [times]

    def sink(batch, batch_id):
        if seen is not None:
            seen.append((batch_id, batch.count(), time.time()))
        if batch_id == broken and left[0]:
            left[0] -= 1
            raise ConnectionError("the store is away")
        real(batch, batch_id)

    return sink


def urls(store):
    return sorted(r.url for r in store.read().collect())


ALL = [f"{k}-{n}" for k in range(3) for n in range(2)]


def test_a_batch_that_fails_twice_is_stored_at_last(spark, tmp_path, topic):
    store, seen = SnapshotStore(spark, f"file://{tmp_path}/news", "url", parts=2), []
    streaming.drain(spark, topic, flaky(store, f"file://{tmp_path}/dead", 2, seen=seen), f"file://{tmp_path}/c", retries(tmp_path))
    assert [(b, n) for b, n, _ in seen] == [(0, 2), (1, 2), (1, 2), (1, 2), (2, 2)]
    assert all(b - a >= 0.2 for (_, _, a), (_, _, b) in zip(seen[1:3], seen[2:4], strict=True))
    assert urls(store) == ALL and not (tmp_path / "aside").exists()
    assert "away" in (tmp_path / "ledger" / "batch=1" / "try=2").read_text()


def test_a_batch_that_never_works_is_set_aside(spark, tmp_path, topic):
    store, seen = SnapshotStore(spark, f"file://{tmp_path}/news", "url", parts=2), []
    streaming.drain(spark, topic, flaky(store, f"file://{tmp_path}/dead", 99, seen=seen), f"file://{tmp_path}/c", retries(tmp_path))
    assert [b for b, _, _ in seen] == [0, 1, 1, 1, 2]
    assert urls(store) == [u for u in ALL if not u.startswith("1-")]
    assert spark.read.parquet(f"file://{tmp_path}/aside").count() == 2
    streaming.drain(spark, topic, flaky(store, f"file://{tmp_path}/dead", 99, seen=seen), f"file://{tmp_path}/c", retries(tmp_path))
    assert len(seen) == 5  # nothing has arrived since


def test_tries_are_counted_across_restarts(spark, tmp_path, topic):
    """Each start fails once and dies; the third finds two tries in the ledger."""
    store, how = SnapshotStore(spark, f"file://{tmp_path}/news", "url", parts=2), retries(tmp_path)
    for _ in range(2):
        sink = streaming.counted(spark, flaky(store, f"file://{tmp_path}/dead", 99), how)
        with pytest.raises(StreamingQueryException):
            streaming._start(spark, topic, sink, f"file://{tmp_path}/c", 1).awaitTermination()
    assert streaming.Ledger(spark, how.ledger).tries(1) == 2
    seen = []
    streaming.drain(spark, topic, flaky(store, f"file://{tmp_path}/dead", 99, seen=seen), f"file://{tmp_path}/c", how)
    assert [b for b, _, _ in seen] == [1, 2] and spark.read.parquet(f"file://{tmp_path}/aside").count() == 2


def test_without_a_limit_a_batch_is_tried_until_it_is_stored(spark, tmp_path, topic):
    store = SnapshotStore(spark, f"file://{tmp_path}/news", "url", parts=2)
    streaming.drain(spark, topic, flaky(store, f"file://{tmp_path}/dead", 5), f"file://{tmp_path}/c", retries(tmp_path, tries=None, wait=0.0))
    assert urls(store) == ALL


def test_other_errors_are_raised(spark, tmp_path):
    (tmp_path / "c").write_text("no folder")
    (tmp_path / "topic").mkdir()
    (tmp_path / "topic" / "a.json").write_text("{}")
    with pytest.raises(Exception):  # noqa: B017
        streaming.drain(spark, str(tmp_path / "topic"), lambda b, i: None, f"file://{tmp_path}/c", retries(tmp_path))
