"""Upserts, guarded updates and deletes as next states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import merge as op
from tidewire.operators import registry as reg
from tidewire.plans.registry import query
from tidewire.sources import views
from tidewire.sources.views import NEWS_SQL, RANKING_SQL, RSS_LINK_SQL, SOURCE_SQL, STATE_SQL

NOW = "2024-06-01 00:00:00"
_N = f"WITH {NEWS_SQL}"
_S = f"WITH {STATE_SQL}"


def _stored(spark, sf):
    """Two thirds of the news are stored; half of all arrive (again)."""
    news = views.news(spark, sf)
    return news.where("id % 3 <> 0"), news.where("id % 2 = 0")


@query(f"{_N} SELECT id FROM news WHERE id % 3 <> 0 OR id % 2 = 0")
def insert_ignore(spark, sf):
    current, incoming = _stored(spark, sf)
    return op.insert_ignore(current.select("id", "url"), incoming.select("id", "url"), "url", F.col("id")).select("id")


@query(f"{_N} SELECT count(*) AS inserted, (SELECT count(*) FROM news WHERE id % 3 <> 0 AND id % 2 = 0) AS skipped FROM news WHERE id % 3 = 0 AND id % 2 = 0")
def ingest_counts(spark, sf):
    current, incoming = _stored(spark, sf)
    known = current.select("url").withColumn("known", F.lit(True))
    return incoming.join(known, "url", "left").agg(F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if("known").alias("skipped"))


@query(f"{_N} SELECT url FROM news WHERE id % 3 <> 0 AND id % 2 = 0")
def stored_urls(spark, sf):
    current, incoming = _stored(spark, sf)
    return current.select("url").join(incoming.select("url"), "url", "left_semi")


@query(f"{_N} SELECT id, url FROM news WHERE id % 3 = 0 AND id % 2 = 0")
def unstored_items(spark, sf):
    current, incoming = _stored(spark, sf)
    return incoming.select("id", "url").join(current.select("url"), "url", "left_anti").select("id", "url")


@query(f"{_N} SELECT id, url, CASE WHEN id % 3 = 0 THEN is_alert OR id % 5 = 0 WHEN id % 2 = 0 THEN is_alert OR id % 5 = 0 ELSE is_alert END AS is_alert FROM news WHERE id % 3 <> 0 OR id % 2 = 0")
def upsert_alert(spark, sf):
    current, incoming = _stored(spark, sf)
    flagged = incoming.withColumn("is_alert", F.col("is_alert") | (F.col("id") % 5 == 0))
    return op.upsert_alert(current.select("id", "url", "is_alert"), flagged.select("id", "url", "is_alert"))


@query(f"""{_S} SELECT news_id, CASE WHEN news_id % 2 = 0 AND summary IS NULL THEN 'new' ELSE summary END AS summary,
       CASE WHEN news_id % 2 = 0 AND summary IS NULL THEN true ELSE primary_event_found END AS primary_event_found,
       CASE WHEN news_id % 2 = 0 AND summary IS NULL THEN NULL ELSE event_cluster_id END AS event_cluster_id,
       embedding IS NOT NULL AND NOT (news_id % 2 = 0 AND summary IS NULL) AS has_embedding FROM event_state""")
def upsert_state(spark, sf):
    state = views.event_state(spark, sf)
    incoming = state.where("news_id % 2 = 0").select("news_id", F.lit("new").alias("summary"), F.lit(True).alias("primary_event_found"))
    return op.upsert_state(state, incoming).select("news_id", "summary", "primary_event_found", "event_cluster_id", F.col("embedding").isNotNull().alias("has_embedding"))


@query(f"""WITH {STATE_SQL},\n{RANKING_SQL} SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN 99.0 ELSE relevance_score END AS relevance_score,
       CASE WHEN cluster_id % 2 = 0 THEN 'x' ELSE category END AS category, CASE WHEN cluster_id % 2 = 0 THEN 0 ELSE member_count END AS member_count FROM ranking
UNION ALL SELECT -1, 99.0, 'x', 0""")
def upsert_ranking(spark, sf):
    current = views.ranking(spark, sf).select("cluster_id", "relevance_score", "category", "member_count")
    ids = current.where("cluster_id % 2 = 0").select("cluster_id").unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("cluster_id")))
    return op.upsert_ranking(current, ids.select("cluster_id", F.lit(99.0).alias("relevance_score"), F.lit("x").alias("category"), F.lit(0).cast("bigint").alias("member_count")))


@query(f"{_S} SELECT news_id, coalesce(embedding[1], CASE WHEN news_id % 2 = 0 THEN 0.5 END) AS first FROM event_state")
def set_embedding(spark, sf):
    state = views.event_state(spark, sf)
    incoming = state.where("news_id % 2 = 0").select("news_id", F.array(F.lit(0.5).cast("float")).alias("embedding"))
    return op.set_where_null(state, incoming, "news_id", "embedding").select("news_id", F.get("embedding", F.lit(0)).alias("first"))


@query(f"{_S} SELECT news_id, coalesce(event_cluster_id, CASE WHEN news_id % 2 = 0 THEN news_id END) AS event_cluster_id FROM event_state")
def set_cluster(spark, sf):
    state = views.event_state(spark, sf).select("news_id", "event_cluster_id")
    incoming = state.where("news_id % 2 = 0").select("news_id", F.col("news_id").alias("event_cluster_id"))
    return op.set_where_null(state, incoming, "news_id", "event_cluster_id")


@query(f"{_N} SELECT id, CASE WHEN id % 4 = 1 THEN NULL WHEN id % 4 = 0 THEN coalesce(dismissed_at, TIMESTAMP '{NOW}') ELSE dismissed_at END AS dismissed_at FROM news")
def dismiss_restore(spark, sf):
    news = views.news(spark, sf).select("id", "dismissed_at")
    after = op.dismiss(news, news.where("id % 4 = 0").select("id"), F.lit(NOW).cast("timestamp_ntz"))
    return op.restore(after, news.where("id % 4 = 1").select("id"))


@query(f"{_N} SELECT id, is_alert OR id % 10 = 0 AS is_alert, CASE WHEN id % 10 = 0 THEN url END AS act_url FROM news")
def escalate(spark, sf):
    # The flag and the act are one unit: an item is flagged only where its act was created.
    news = views.news(spark, sf)
    acts = news.where("id % 10 = 0").select("id", F.col("url").alias("act_url"), "title", "text", "published_at")
    return news.select("id", "is_alert").join(acts.select("id", "act_url"), "id", "left").select("id", (F.col("is_alert") | F.col("act_url").isNotNull()).alias("is_alert"), "act_url")


@query(f"""WITH {NEWS_SQL},\n{STATE_SQL},\n{SOURCE_SQL},\n{RSS_LINK_SQL}
SELECT 'source' AS name, count(*) AS rows FROM source WHERE id % 7 <> 0 UNION ALL SELECT 'news', count(*) FROM news WHERE source_id % 7 <> 0
UNION ALL SELECT 'state', count(*) FROM event_state s JOIN news n ON n.id = s.news_id WHERE n.source_id % 7 <> 0
UNION ALL SELECT 'rss_link', count(*) FROM rss_link WHERE source_id % 7 <> 0""")
def cascade_delete(spark, sf):
    sources = views.source(spark, sf)
    children = [
        ("news", views.news(spark, sf).select("id", "source_id"), "source_id", ""),
        ("state", views.event_state(spark, sf).select("news_id"), "news_id", "news"),
        ("rss_link", views.rss_link(spark, sf), "source_id", ""),
    ]
    left = op.cascade_delete(sources, sources.where("id % 7 = 0").select("id"), children, "id")
    out = None
    for name, frame in left.items():
        one = frame.agg(F.count("*").alias("rows")).select(F.lit(name or "source").alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {SOURCE_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 3 = 0 THEN NULL ELSE poll_interval_seconds END AS poll_interval_seconds FROM source")
def patch_update(spark, sf):
    sources = views.source(spark, sf).select("id", "name", "poll_interval_seconds")
    sent = F.map_from_entries(
        F.filter(
            F.array(
                F.when(F.col("id") % 2 == 0, F.struct(F.lit("name").alias("k"), F.lit("renamed").alias("v"))),
                F.when(F.col("id") % 3 == 0, F.struct(F.lit("poll_interval_seconds").alias("k"), F.lit(None).cast("string").alias("v"))),
            ),
            lambda e: e.isNotNull(),
        )
    )
    return op.patch(sources, sources.select("id", sent.alias("fields")), "id")


@query(f"WITH {NEWS_SQL} SELECT id, source_id FROM news WHERE source_id % 7 <> 0")
def drop_orphans(spark, sf):
    return reg.drop_orphans(views.news(spark, sf).select("id", "source_id"), views.source(spark, sf).where("id % 7 <> 0")).select("id", "source_id")


@query(f"""WITH {NEWS_SQL},\n{SOURCE_SQL} SELECT n.id, n.source_id, n.source_name FROM news n""")
def relink_update(spark, sf):
    sources = views.source(spark, sf)
    links = sources.select(F.col("id").alias("source_id"), F.col("link").alias("source_link"))
    items = views.news(spark, sf).select("id", "source_id").join(links, "source_id").select(
        "id", "source_link", F.when(F.col("id") % 3 != 0, F.col("source_id")).alias("source_id"), F.lit(None).cast("string").alias("source_name")
    )
    return reg.relink(items, sources).select("id", "source_id", "source_name")


@query("""SELECT event_id, coalesce(nullif(props ->> '$.title', ''), nullif(props ->> '$.k', ''), event_type) AS title, CAST(props ->> '$.k' AS BIGINT) AS k FROM events""")
def backfill_flat(spark, sf):
    rows = views.table(spark, sf, "events")
    value = lambda key: F.nullif(F.get_json_object("props", f"$.{key}"), F.lit(""))
    return rows.select("event_id", F.coalesce(value("title"), value("k"), "event_type").alias("title"), value("k").cast("bigint").alias("k"))
