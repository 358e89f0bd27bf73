"""Feed, point and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import feed as op
from tidewire.operators import ranking as rk
from tidewire.plans.registry import query
from tidewire.sources import views
from tidewire.sources.views import BASE_SQL, NEWS_SQL, RANKING_SQL, STATE_SQL

_COLUMNS = ["id", "source_name", "title", "published_at", "created_at", "is_alert", "category", "member_count"]
SINCE = "2024-01-10 00:00:00"


def _feed(spark, sf, **how):
    return op.feed(views.news(spark, sf), views.event_state(spark, sf), views.ranking(spark, sf), op.FeedQuery(**how)).select(*_COLUMNS)


def _sql(where: str, gate: bool = True) -> str:
    ranked = "AND r.category <> 'низкая релевантность'" if gate else ""
    return f"""{BASE_SQL}
SELECT n.id, n.source_name, n.title, n.published_at, n.created_at, n.is_alert, r.category, r.member_count
FROM news n LEFT JOIN event_state s ON s.news_id = n.id LEFT JOIN ranking r ON r.cluster_id = n.id
WHERE (s.event_cluster_id IS NULL OR s.event_cluster_id = n.id) {ranked} {where}
ORDER BY n.published_at DESC NULLS LAST, n.created_at DESC, n.id"""


@query(_sql("AND n.dismissed_at IS NULL"))
def feed_visible(spark, sf):
    return _feed(spark, sf)


@query(_sql("AND n.dismissed_at IS NOT NULL"))
def feed_dismissed(spark, sf):
    return _feed(spark, sf, visibility=op.DISMISSED)


@query(_sql(""))
def feed_all(spark, sf):
    return _feed(spark, sf, visibility=op.ALL)


@query(_sql(f"AND n.dismissed_at IS NULL AND coalesce(n.published_at, n.created_at) >= TIMESTAMP '{SINCE}'"))
def feed_since(spark, sf):
    return _feed(spark, sf, since=SINCE)


@query(_sql("AND n.dismissed_at IS NULL AND n.is_alert", gate=False))
def feed_alerts(spark, sf):
    return _feed(spark, sf, is_alert=True)


@query(_sql("AND n.dismissed_at IS NULL AND NOT n.is_alert"))
def feed_non_alerts(spark, sf):
    return _feed(spark, sf, is_alert=False)


@query(_sql("AND (n.title ILIKE '%the%' ESCAPE '\\' OR n.text ILIKE '%the%' ESCAPE '\\')"))
def feed_search(spark, sf):
    return _feed(spark, sf, q="the", visibility=op.ALL)


#: Texts that hold LIKE's wildcards as they are, and texts that only match where these count as wildcards.
_MARKED = ("at 100%_A\\ of it", "at 100 and xA\\ of it", "at 100%_A of it")
_MARKED_SQL = f"[{', '.join(repr(m).replace(chr(92) * 2, chr(92)) for m in _MARKED)}][n.id % 3 + 1]"


@query(_sql(rf"AND (n.title ILIKE '%100\%\_a\\%' ESCAPE '\' OR {_MARKED_SQL} ILIKE '%100\%\_a\\%' ESCAPE '\')"))
def feed_search_escape(spark, sf):
    news = views.news(spark, sf).withColumn("text", F.get(F.array(*map(F.lit, _MARKED)), (F.col("id") % 3).cast("int")))
    return op.feed(news, views.event_state(spark, sf), views.ranking(spark, sf), op.FeedQuery(q="100%_a\\", visibility=op.ALL)).select(*_COLUMNS)


@query(f"WITH {NEWS_SQL} SELECT id, url, source_name, title, created_at, published_at, is_alert FROM news WHERE id = 42")
def point_lookup(spark, sf):
    return views.news(spark, sf).where(F.col("id") == 42).limit(1).select("id", "url", "source_name", "title", "created_at", "published_at", "is_alert")


@query(f"""{BASE_SQL}
SELECT n.id, n.is_alert, s.primary_event_found, s.event_cluster_id = n.id AS is_head, r.relevance_score, r.category, r.member_count
FROM news n LEFT JOIN event_state s ON s.news_id = n.id LEFT JOIN ranking r ON r.cluster_id = coalesce(s.event_cluster_id, n.id)""")
def report_item(spark, sf):
    state = views.event_state(spark, sf).select(F.col("news_id").alias("id"), "primary_event_found", "event_cluster_id")
    joined = views.news(spark, sf).select("id", "is_alert").join(state, "id", "left").withColumn("cluster_id", F.coalesce("event_cluster_id", "id"))
    ranked = views.ranking(spark, sf).select("cluster_id", "relevance_score", "category", "member_count")
    return joined.join(ranked, "cluster_id", "left").select("id", "is_alert", "primary_event_found", (F.col("event_cluster_id") == F.col("id")).alias("is_head"), "relevance_score", "category", "member_count")


@query(f"""{BASE_SQL}
SELECT (SELECT count(*) FROM news) AS news, (SELECT count(*) FROM event_state WHERE summary IS NOT NULL) AS summarized,
       (SELECT count(*) FROM event_state WHERE embedding IS NOT NULL) AS embedded, (SELECT count(*) FROM event_state WHERE event_cluster_id IS NOT NULL) AS clustered,
       (SELECT count(*) FROM ranking) AS ranked, (SELECT count(*) FROM news WHERE is_alert) AS alerts""")
def progress_counts(spark, sf):
    return rk.progress(views.news(spark, sf), views.event_state(spark, sf), views.ranking(spark, sf))


@query(f"{BASE_SQL} SELECT category, count(*) AS clusters, round(avg(relevance_score)) AS avg_score FROM ranking GROUP BY category ORDER BY avg_score DESC, category")
def ranking_by_category(spark, sf):
    return rk.by_category(views.ranking(spark, sf))


@query(f"""{BASE_SQL}
SELECT r.cluster_id, r.member_count, r.category, round(r.relevance_score) AS score, n.title FROM ranking r JOIN news n ON n.id = r.cluster_id
WHERE r.member_count > 1 ORDER BY r.member_count DESC, r.relevance_score DESC, r.cluster_id LIMIT 15""")
def multi_member_clusters(spark, sf):
    return rk.multi_member(views.ranking(spark, sf), views.news(spark, sf))


@query(f"""{BASE_SQL}
SELECT r.cluster_id, round(r.relevance_score) AS score, r.category, n.source_name, n.title FROM ranking r JOIN news n ON n.id = r.cluster_id
ORDER BY r.relevance_score DESC, r.cluster_id LIMIT 10""")
def top_relevance(spark, sf):
    return rk.top_relevance(views.ranking(spark, sf), views.news(spark, sf))


@query(f"WITH {NEWS_SQL} SELECT id, source_name, published_at, title, url FROM news WHERE is_alert ORDER BY published_at DESC NULLS LAST, id LIMIT 30")
def alerts_report(spark, sf):
    return rk.alerts_report(views.news(spark, sf))


@query(f"""WITH {STATE_SQL}, {RANKING_SQL}
SELECT cluster_id AS id, 'within_3_days' AS urgency_basis, 'stand-in' AS urgency_reason,
       [impact, 0, 1, 2] AS scores, ['finance', 'reputation', 'technology', 'competition'] AS dimensions FROM ranking""")
def relevance_flatten(spark, sf):
    impact = F.struct(
        F.lit("within_3_days").alias("urgency_basis"), F.lit("stand-in").alias("urgency_reason"), F.col("impact").alias("finance_score"), F.lit(0).alias("reputation_score"),
        F.lit(1).alias("technology_score"), F.lit(2).alias("competition_score"), *(F.lit("").alias(f"{d}_reason") for d in ("finance", "reputation", "technology", "competition")),
    )
    details = views.ranking(spark, sf).select(F.col("cluster_id").alias("id"), F.struct(impact.alias("impact")).alias("details"))
    flat = op.flatten_relevance(details)
    return flat.select("id", "urgency_basis", "urgency_reason", F.col("impact.score").alias("scores"), F.col("impact.dimension").alias("dimensions"))


@query("""SELECT doc_id AS id, CASE WHEN length(trim(text)) > 160 THEN rtrim(substr(trim(text), 1, 160)) || '…' ELSE trim(text) END AS excerpt FROM documents""")
def excerpt_of(spark, sf):
    return views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.excerpt(F.lit(None).cast("string"), F.col("text")).alias("excerpt"))


@query("SELECT event_id, date_trunc('minute', ts - INTERVAL 24 HOUR) AS since_24, date_trunc('minute', ts - INTERVAL 72 HOUR) AS since_72 FROM events")
def since_floor(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id", *(F.date_trunc("MINUTE", F.expr(f"ts - INTERVAL '{h}' HOUR")).cast("timestamp_ntz").alias(f"since_{h}") for h in (24, 72))
    )
