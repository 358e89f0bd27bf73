"""Changes of a keyed table: touched parts only, crashes at every step, cascades."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewire.operators import merge
from tidewire.sources.store import PART, SnapshotStore, cascade

NEWS = "id bigint, url string, source_id bigint, is_alert boolean"


def news(spark, rows):
    return spark.createDataFrame(rows, NEWS)


def item(k, source=0, alert=False):
    return (k, f"u{k}", source, alert)


def stored(store, version=None):
    return sorted(map(tuple, store.read(version).collect()))


def parts_of(spark, store, urls):
    return {r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(store._part()).distinct().collect()}


def test_an_upsert_reads_and_writes_its_parts_only(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/t", "url", parts=256)
    rows = [item(k) for k in range(2000)]
    store.commit(news(spark, rows).repartition(4))
    new = [item(9000 + k, 5, True) for k in range(5)] + [(k, f"u{k}", 7, True) for k in range(5)]
    touched = parts_of(spark, store, [r[1] for r in new])
    assert len(touched) <= 10
    for folder in (tmp_path / "t" / "base=1").glob(f"{PART}=*"):  # whatever else would be read is gone
        if int(folder.name.split("=")[1]) not in touched:
            folder.rename(tmp_path / folder.name)
            folder.mkdir()
    assert store.upsert(news(spark, new), merge.upsert_alert) == 2
    assert {p.name for p in (tmp_path / "t" / "parts=2").glob(f"{PART}=*")} == {f"{PART}={p}" for p in touched}
    for folder in tmp_path.glob(f"{PART}=*"):
        shutil.rmtree(tmp_path / "t" / "base=1" / folder.name)
        folder.rename(tmp_path / "t" / "base=1" / folder.name)
    want = {r[1]: r for r in rows} | {r[1]: r for r in new[:5]} | {f"u{k}": (k, f"u{k}", 0, True) for k in range(5)}
    assert stored(store) == sorted(want.values()) and stored(store, 1) == sorted(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_mix_of_writes_equals_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    store, want, history = SnapshotStore(spark, f"file://{tmp_path}/t", "url", parts=3, compact_after=4), {}, {}
    store.commit(news(spark, []))
    for _ in range(9):
        some = [item(k, rng.randrange(3), rng.random() < 0.5) for k in rng.sample(range(12), 4)]
        how = rng.choice(["add", "upsert", "delete"])
        if how == "add":
            store.add_new(news(spark, some))
            want = {r[1]: r for r in some} | want
        elif how == "upsert":
            store.upsert(news(spark, some), merge.upsert_alert)
            for r in some:
                old = want.get(r[1])
                want[r[1]] = r if old is None else (*old[:3], old[3] or r[3])
        else:
            store.delete(news(spark, some))
            for r in some:
                want.pop(r[1], None)
        history[store.version()] = sorted(want.values())
        assert stored(store) == sorted(want.values()), how
    last = max(history)
    store.drop_before(last)
    assert stored(store) == history[last]


def test_all_rows_of_a_part_deleted(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/t", "url", parts=1)
    store.commit(news(spark, [item(1), item(2)]))
    assert store.delete(news(spark, [item(1), item(2), item(3)])) == 2
    assert stored(store) == [] and store.read().columns == ["id", "url", "source_id", "is_alert"]
    store.add_new(news(spark, [item(4)]))
    assert stored(store) == [item(4)]
    assert store.delete(news(spark, [])) == store.version()


def test_a_change_may_not_leave_its_parts(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/t", "url", parts=50)
    store.commit(news(spark, [item(1), item(2)]))
    keys = news(spark, [item(1)])
    with pytest.raises(PySparkException):
        store.change(keys, lambda rows: rows.withColumn("url", F.lit("u77")))
    assert stored(store) == [item(1), item(2)] and store.version() == 1
    assert store.change(keys, lambda rows: rows.withColumn("source_id", F.lit(3).cast("bigint"))) > 1
    assert stored(store) == [(1, "u1", 3, False), item(2)]


def test_changes_survive_a_crash_at_every_step(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/t", "url", parts=4)
    store.commit(news(spark, [item(k) for k in range(8)]))
    store.delete(news(spark, [item(1)]))
    before = stored(store)
    whole = tmp_path / "t" / "parts=2"
    for step in ("nothing", "files", "marks without success"):  # what a write may leave behind
        left = tmp_path / "t" / f"parts={store._folders()[-1][0] + 1}"
        left.mkdir()
        if step != "nothing":
            for folder in whole.glob(f"{PART}=*"):
                shutil.copytree(folder, left / folder.name)
        assert stored(store) == before and store.version() == 2
    assert store.delete(news(spark, [item(2)])) == 6
    assert stored(store) == sorted(item(k) for k in range(8) if k not in (1, 2))


def test_cascade(spark, tmp_path):
    """Sources, their news, the states of these: referring rows go, and a run that died is completed by the next."""
    sources = SnapshotStore(spark, f"file://{tmp_path}/sources", "id", parts=8)
    items = SnapshotStore(spark, f"file://{tmp_path}/news", "id", parts=8)
    states = SnapshotStore(spark, f"file://{tmp_path}/states", "news_id", parts=8)
    sources.commit(spark.createDataFrame([(k,) for k in range(4)], "id bigint"))
    items.commit(news(spark, [item(k, k % 4) for k in range(40)]))
    states.commit(spark.createDataFrame([(k, "s") for k in range(40)], "news_id bigint, summary string"))
    gone = spark.createDataFrame([(2,), (99,)], "id bigint")
    children = [(items, "source_id", "parent"), (states, "news_id", "0")]
    states.delete(items.read().where("source_id = 2").select(F.col("id").alias("news_id")))  # as far as the first run came
    assert states.read().count() == 30 and items.read().count() == 40
    for _ in range(2):
        cascade(gone, sources, children)
        assert {r.id for r in sources.read().collect()} == {0, 1, 3}
        assert {r.source_id for r in items.read().collect()} == {0, 1, 3}
        assert {r.news_id for r in states.read().collect()} == {k for k in range(40) if k % 4 != 2}
