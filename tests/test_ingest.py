from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewire.functions import models
from tidewire.operators.feed import FeedQuery, feed
from tidewire.operators.ingest import Models, Tables, ingest_batch

NEWS = "id bigint, url string, source_name string, reliability string, title string, text string, created_at timestamp_ntz, published_at timestamp_ntz, is_alert boolean, dismissed_at timestamp_ntz"
STATE = "news_id bigint, summary string, primary_event_found boolean, embedding array<float>, event_cluster_id bigint"
RANKING = "cluster_id bigint, relevance_score double, category string, member_count bigint"


def item(i, text, hour=0, alert=False):
    at = datetime(2024, 1, 1, hour)
    return (i, f"https://e.test/{i}", "s", "high", text[:20], text, at, at, alert, None)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_batches(spark, tmp_path):
    def keep(frame, name, count=[0]):  # noqa: B006
        count[0] += 1
        path = f"{tmp_path}/{count[0]}-{name}"
        frame.write.parquet(path)
        return spark.read.parquet(path)

    empty = Tables(*(spark.createDataFrame([], s) for s in (NEWS, STATE, RANKING)))
    facets = spark.createDataFrame([(1, "factory opens in the north", ["factory"])], "facet_id int, semantic_query string, terms array<string>")
    first = spark.createDataFrame([item(1, "A new factory opens in the north today. More."), item(2, "A new factory opens in the north today! Other.", 1), item(3, "Completely different words about weather patterns.", 2), item(4, "Too short.", 3)], NEWS)
    one = ingest_batch(empty, first, facets, keep=keep)
    assert {r.news_id: r.event_cluster_id for r in one.state.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    again = ingest_batch(one, first, facets, keep=keep)
    assert rows(again.news) == rows(one.news) and rows(again.state.drop("embedding")) == rows(one.state.drop("embedding")) and rows(again.ranking) == rows(one.ranking)
    second = spark.createDataFrame([item(5, "A new factory opens in the north today. Late.", 5), item(3, "ignored", 9, alert=True)], NEWS)
    two = ingest_batch(one, second, facets, keep=keep)
    assert {r.news_id: r.event_cluster_id for r in two.state.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    assert {r.cluster_id: r.member_count for r in two.ranking.collect()}[1] == 3
    assert [r.id for r in two.news.where("is_alert").collect()] == [3]
    shown = feed(two.news, two.state, two.ranking, FeedQuery(is_alert=True)).collect()
    assert [r.id for r in shown] == [3]


def test_model_function(spark):
    frame = spark.createDataFrame([(k, f"t{k}") for k in range(10)], "k int, t string").coalesce(1)
    double = models.model_function(lambda texts: [x * 2 for x in texts], "string", items=3)
    assert [r.x for r in frame.select("k", double(F.col("t")).alias("x")).orderBy("k").collect()] == [f"t{k}t{k}" for k in range(10)]

    def broken(texts):
        raise OSError("no service")

    assert frame.select(models.model_function(broken, "string", tries=2)(F.col("t")).alias("x")).where("x IS NOT NULL").count() == 0


def test_embedding_has_length_one(spark):
    got = spark.createDataFrame([("a word or two",), ("",)], "t string").select(models.embedding(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in got[0].v) - 1) < 1e-5 and got[1].v is None


def test_ports_of_structs(spark, tmp_path):
    """Summaries of several items by index, judgements by cluster; what fails is asked again with the next batch."""

    def keep(frame, name, count=[0]):  # noqa: B006
        count[0] += 1
        frame.write.parquet(f"{tmp_path}/{count[0]}-{name}")
        return spark.read.parquet(f"{tmp_path}/{count[0]}-{name}")

    def summarise(items):
        from tidewire.functions.models import Indexed

        if any("broken" in x["text"] for x in items):
            raise ConnectionError
        return [Indexed((k, {"summary": "About " + x["text"].split()[0], "primary_event_found": "rain" not in x["text"]})) for k, x in reversed([*enumerate(items)])]

    def align(preclusters):
        return [[{"id": i["id"], "decision": "SAME" if i["summary"] == p["anchors"][0]["summary"] else "DIFFERENT"} for i in p["items"]] for p in preclusters]

    def judge(clusters):
        assert clusters[0]["company"] == "Company: Acme" and clusters[0]["summaries"]
        if clusters[0]["cluster_id"] == 3:
            raise TimeoutError
        return [{"impact": [0, 3, 1, 2], "urgency_basis": "other"} for _ in clusters]

    use = Models(summarise=summarise, align=align, judge=judge, company="Company: Acme", items=1, tries=2, wait=0.0)
    empty = Tables(*(spark.createDataFrame([], s) for s in (NEWS, STATE, RANKING)))
    facets = spark.createDataFrame([(1, "bridges", ["bridge"])], "facet_id int, semantic_query string, terms array<string>")
    batch = spark.createDataFrame([item(1, "Bridges open in spring"), item(2, "Bridges open again", 1), item(3, "Markets fall", 2), item(4, "broken text", 3), item(5, "Weather brings rain", 4)], NEWS)
    one = ingest_batch(empty, batch, facets, use, keep)
    assert {r.news_id: (r.summary, r.primary_event_found) for r in one.state.collect()} == {1: ("About Bridges", True), 2: ("About Bridges", True), 3: ("About Markets", True), 5: ("About Weather", False)}
    assert {r.news_id: r.event_cluster_id for r in one.state.collect()} == {1: 1, 2: 1, 3: 3, 5: 5}
    assert {r.cluster_id: r.member_count for r in one.ranking.collect()} == {1: 2, 5: 1}  # cluster 3 could not be judged
    mended = Models(summarise=lambda items: [{"summary": "Mended", "primary_event_found": True} for _ in items], align=align, judge=lambda c: [{"impact": [1], "urgency_basis": "other"} for _ in c], tries=1)
    two = ingest_batch(one, batch, facets, mended, keep)
    assert {r.news_id: r.summary for r in two.state.collect()}[4] == "Mended" and {r.cluster_id for r in two.ranking.collect()} == {1, 3, 4, 5}
