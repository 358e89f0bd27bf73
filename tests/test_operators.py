from __future__ import annotations

import io
import json
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from tidewire.operators import acts, crawl, dedup, merge, ranking, registry
from tidewire.operators.feed import FeedQuery
from tidewire.plans.api import NewsDesk
from tidewire.sources import bus, feeds
from tidewire.sources.store import SnapshotStore
from tidewire.streaming import ingest as streaming


def test_choose_clusters():
    assert dedup.choose_clusters([(1, []), (2, [(1, "SAME")])]) == {1: 1, 2: 1}
    assert dedup.choose_clusters([(1, []), (2, [(1, "UNCERTAIN")])]) == {1: 1, 2: 2}
    assert dedup.choose_clusters([(1, [(9, "SAME")]), (2, [(1, "SAME"), (9, "SAME")])]) == {1: 9, 2: 9}  # both resolve to 9
    assert dedup.choose_clusters([(3, [(7, "SAME"), (8, "SAME")])]) == {3: 3}
    assert dedup.choose_clusters([(3, [(7, "SAME"), (8, "UNCERTAIN")])]) == {3: 3}
    assert dedup.choose_clusters([(3, [(7, "SAME"), (8, "UNCERTAIN")])], veto=False) == {3: 7}
    assert dedup.choose_clusters([(3, [(7, "SAME"), (7, "DIFFERENT")])]) == {3: 3}


def test_greedy_is_complete_and_repeatable(spark, sf):
    desk = NewsDesk.over_test_tables(spark, sf)
    got = {r.id: r.cluster_id for r in desk.assign_pending().collect()}
    assert got == {r.id: r.cluster_id for r in desk.assign_pending().collect()}
    assert set(got) == {r.id for r in dedup.pending(desk.news, desk.state).collect()}


def test_upserts_are_idempotent(spark):
    now = spark.createDataFrame([(1, "a", False), (2, "b", True)], "id int, url string, is_alert boolean")
    new = spark.createDataFrame([(7, "a", True), (8, "c", False)], "id int, url string, is_alert boolean")
    once = merge.upsert_alert(now, new)
    twice = merge.upsert_alert(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", True), (2, "b", True), (8, "c", False)]


def test_insert_ignore_keeps_the_first(spark):
    now = spark.createDataFrame([("a", 0)], "url string, n int")
    new = spark.createDataFrame([("b", 2), ("b", 1), ("a", 3)], "url string, n int")
    assert sorted(map(tuple, merge.insert_ignore(now, new, "url", F.col("n")).collect())) == [("a", 0), ("b", 1)]


def test_bm25_counts_repeats_and_empty_corpus(spark):
    corpus = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "")], "doc_id int, text string")
    once, twice = (
        {r.doc_id: r.score for r in ranking.bm25(corpus, spark.createDataFrame([("q", q)], "query_id string, text string")).collect()} for q in ("alpha", "alpha alpha")
    )
    assert set(once) == {1} and abs(twice[1] - 2 * once[1]) < 1e-9
    assert ranking.bm25(corpus.limit(0), spark.createDataFrame([("q", "x y")], "query_id string, text string")).count() == 0


def _articles(spark, days):
    rows = [(k, "h", None if d is None else datetime(2024, 1, d)) for k, d in enumerate(days)]
    return spark.createDataFrame(rows, "pos int, hub_url string, published_at timestamp_ntz")


def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")


def test_stale_streak(spark):
    old = crawl.stale_streak(_articles(spark, [1] * 10), now(), batch=2, min_dates=2).orderBy("batch").collect()
    assert [r.read for r in old] == [True, True, False, False, False]
    assert all(r.read for r in crawl.stale_streak(_articles(spark, [1] * 10), now(), batch=2, min_dates=3).collect())
    assert all(r.read for r in crawl.stale_streak(_articles(spark, [19] * 6), now(), batch=2, min_dates=2).collect())


def test_cards_until_old_and_merge(spark):
    assert [r.pos for r in crawl.cards_until_old(_articles(spark, [19, None, 1, 19]), now()).orderBy("pos").collect()] == [0, 1]
    rows = spark.createDataFrame(
        [(0, "https://a.test/x?utm_source=1", "", datetime(2024, 1, 1)), (1, "https://a.test/y", "https://a.test/x", datetime(2024, 1, 2)), (2, "https://a.test/z", "", datetime(2024, 1, 1))],
        "pos int, url string, canonical_url string, published_at timestamp_ntz",
    )
    assert [r.pos for r in crawl.merge_duplicates(rows).collect()] == [1, 2]


def test_acts(spark):
    rows = spark.createDataFrame(
        [(1, 0, "d4", "u1", "t"), (1, 1, "d5", "u1", "t"), (1, 2, "d5", "u1", "t2"), (1, 3, acts.PUBLISHED_STAGE, "u2", "t3"), (1, 4, "d12", "u3", "t4")],
        "act_id int, version_id int, stage_code string, document_url string, text string",
    )
    got = acts.changes(rows).orderBy("version_id").collect()
    assert [r.kind for r in got] == ["first", "changed", "unchanged", "changed", "changed"]
    assert got[1].message == acts.NO_TEXT_CHANGE and got[3].needs_summary
    states = acts.states(rows, F.col("stage_code") == acts.PUBLISHED_STAGE).orderBy("version_id").collect()
    assert [(r.status, r.checked) for r in states][2:] == [("tracking", True), ("published", True), ("published", False)]


def test_address_rules(spark):
    sources = spark.createDataFrame(
        [(1, "https://a.test", "web", 900, False, False), (2, "https://b.test", "web", 900, True, False), (3, "https://c.test", "rss", 900, True, True)],
        "id int, link string, type string, poll_interval_seconds int, is_relevant boolean, is_enabled boolean",
    )
    changes = spark.createDataFrame([(1, "https://new.test", True), (2, "https://t.me/x", False), (3, "HTTPS://WWW.C.test/", False)], "id int, new_link string, has_feed boolean")
    got = {r.id: r for r in registry.update_addresses(sources, changes).collect()}
    assert (got[1].type, got[1].is_enabled, got[1].is_relevant, got[1].poll_interval_seconds) == ("rss", True, True, 900)
    assert (got[2].type, got[2].is_enabled, got[2].poll_interval_seconds) == ("telegram", False, None)
    assert (got[3].link, got[3].type) == ("https://c.test", "rss")


def test_feed_reader(spark):
    atom = (
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="alternate" href="https://a.test/1"/><published>2024-01-01T00:00:00Z</published>'
        '<updated>2024-01-02T00:00:00Z</updated><category term="x"/><category term="x"/><category term=" "/></entry><entry><title>no link</title></entry></feed>'
    )
    got = feeds.feed_entries(spark.createDataFrame([(1, atom), (2, "broken <"), (3, None)], "source_id int, body string")).collect()
    assert len(got) == 1 and got[0].tags == ["x"] and got[0].updated_at.day == 2
    entries = spark.createDataFrame([(1, "u", 1, 0), (1, "u", 0, 5), (1, "v", 1, 1)], "source_id int, url string, feed_pos int, entry_pos int")
    assert sorted((r.url, r.feed_pos) for r in feeds.merge_feeds(entries).collect()) == [("u", 0), ("v", 1)]


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f"<w:document {w}><w:body>{p('One')}{p('')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('Two')}</w:body></w:document>"
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("word/document.xml", body)
    assert feeds.docx_text(file.getvalue()) == "One\nTwo\na | b"
    assert feeds.docx_text(b"junk") is None


def test_store_and_stream(spark, tmp_path):
    topic = tmp_path / "topic"
    topic.mkdir()
    item = lambda u, t: {"schema_version": 1, "source_id": "s", "url": u, "title": t, "text": "x"}
    batches = [[json.dumps(item("a", "1")), "{broken"], [json.dumps(item("a", "2")), json.dumps(item("b", "3")), json.dumps({"url": "c"})]]
    for k, bodies in enumerate(batches):
        (topic / f"{k}.json").write_text("\n".join(json.dumps({"routing_key": "news.raw.rss", "body": b}) for b in bodies))
    store = SnapshotStore(spark, f"file://{tmp_path}/news", "url", parts=4)
    for _ in range(2):  # the second run finds nothing new
        streaming.ingest(spark, str(topic), store, f"file://{tmp_path}/dead", f"file://{tmp_path}/checkpoint").awaitTermination()
    got = sorted((r.url, r.title) for r in store.read().collect())
    assert [u for u, _ in got] == ["a", "b"]
    assert sorted(r.reason for r in spark.read.parquet(f"file://{tmp_path}/dead").collect()) == ["not json", "title is missing"]
    assert store.read(1).count() < store.version() + 2


def test_store_survives_a_crash_at_every_step(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(f"u{k}", k) for k in ids], "url string, n int")
    store = SnapshotStore(spark, f"file://{tmp_path}/t", "url", parts=4, compact_after=3)
    assert store.version() is None
    assert store.commit(rows(1, 2)) == 1 and store.add_new(rows(2, 3, 3)) == 2
    assert sorted(r.n for r in store.read().collect()) == [1, 2, 3]
    # A write that died before it began, half-way, and before its last step.
    for n, (name, files) in enumerate([("base", []), ("delta", ["part-0.parquet"]), ("base", ["_temporary"])], 3):
        (tmp_path / "t" / f"{name}={n}").mkdir()
        for f in files:
            (tmp_path / "t" / f"{name}={n}" / f).write_text("half")
        assert store.version() == 2
        assert sorted(r.n for r in store.read().collect()) == [1, 2, 3]
    assert store.add_new(rows(3, 4)) == 6  # numbers of failed writes are not used again
    assert sorted(r.n for r in store.read().collect()) == [1, 2, 3, 4] and store.add_new(rows(4)) == 6
    assert store.add_new(rows(4, 5)) == 8  # the fourth folder was folded into a base
    assert sorted(r.n for r in store.read(2).collect()) == [1, 2, 3] and sorted(r.n for r in store.read().collect()) == [1, 2, 3, 4, 5]
    store.drop_before(8)
    assert sorted(r.n for r in store.read().collect()) == [1, 2, 3, 4, 5] and not (tmp_path / "t" / "base=1").exists()


def test_cluster_scores_in_blocks(spark):
    import numpy as np

    from tidewire.operators.dedup import cluster_scores

    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = [(k, datetime(2024, 1, 1 + k % 9, k % 24, 30), x[k].tolist(), k % 7 if k % 3 else None) for k in range(90)]
    table = spark.createDataFrame(rows, "id bigint, event_time timestamp_ntz, unit array<double>, event_cluster_id bigint")
    pool = table.where("event_cluster_id IS NOT NULL")
    want = {}
    for a in rows:
        for b in rows:
            if b[3] is not None and a[0] != b[0] and abs((a[1] - b[1]).total_seconds()) <= 3 * 86_400:
                want[a[0], b[3]] = max(want.get((a[0], b[3]), -2), float(np.dot(a[2], b[2])))
    for block in (2048, 4):
        got = {(r.query_id, r.cluster_id): r.score for r in cluster_scores(table, pool, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_numbers_in_order(spark):
    from tidewire.operators.dedup import numbered_in_order

    rows = [(k, datetime(2024, 1, 1, k * 7 % 5, k % 3, k % 2) if k % 11 else None) for k in range(60)]
    got = {r.id: r.at for r in numbered_in_order(spark.createDataFrame(rows, "id bigint, event_time timestamp_ntz")).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])))}


def test_micro_batches(spark):
    """Against a fold over each queue, with batches of rows that cut queues anywhere."""
    import random

    rng = random.Random(1)
    rows = [(k % 3, k, datetime(2024, 1, 1, 0, rng.randrange(3), rng.randrange(60))) for k in range(400)] + [(None, 900, datetime(2024, 1, 1))]
    want = {}
    for key in range(3):
        batch, count, first = -1, 0, None
        for _, o, t in [r for r in rows if r[0] == key]:
            if first is None or count >= 7 or (t - first).total_seconds() > 60:
                batch, count, first = batch + 1, 0, t
            count += 1
            want[o] = batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    got = bus.micro_batches(spark.createDataFrame(rows, "k bigint, o bigint, t timestamp_ntz"), "k", "t", "o", items=7, seconds=60).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.o: r.batch for r in got} == want


def test_feed_query_bounds():
    import pytest

    with pytest.raises(ValueError, match="q must"):
        FeedQuery(q="")
    with pytest.raises(ValueError, match="visibility"):
        FeedQuery(visibility="some")


def test_watermarked_dedupe(spark, tmp_path):
    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:01"), (3, "b", "2024-01-01 00:00:02")], "n int, k string, t string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("n int, k string, t string").json(str(tmp_path / "in"))
    got = streaming.distinct_deliveries(stream, "t", ["k"])
    got.writeStream.format("memory").queryName("distinct_deliveries").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert spark.table("distinct_deliveries").count() == 2


def test_event_links_cover_all_events(spark):
    from tidewire.operators.crawl import reach
    from tidewire.plans.crawl_queries import event_links

    n = 3000
    edges = {(k, k * 3 % n) for k in range(n)} | {(k, k + 1) for k in range(0, n, 4)}
    links = event_links(spark.range(n).withColumnRenamed("id", "event_id"))
    assert {(r.source, r.target) for r in links.collect()} == edges
    depth, edge = {1004: 0}, {1004}
    for k in (1, 2, 3):
        edge = {b for a, b in edges if a in edge} - set(depth)
        depth |= dict.fromkeys(edge, k)
    assert {r.node: r.depth for r in reach(spark.range(1004, 1005).withColumnRenamed("id", "node"), links, 3).collect()} == depth
