"""The engine's logical tables as views over the test tables, with the same SELECTs as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reliability(number: Column) -> Column:
    return F.when(number % 3 == 0, "high").when(number % 3 == 1, "medium").otherwise("low")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    created = F.expr(f"{EPOCH} + id * INTERVAL '1' HOUR")
    number = F.expr("try_cast(substr(source, 4) AS int)")
    return docs.join(labels, "id", "left").select(
        "id",
        F.concat(F.lit("https://"), "source", F.lit(".example.test/"), F.col("id").cast("string")).alias("url"),
        F.col("source").alias("source_name"),
        number.alias("source_id"),
        reliability(number).alias("reliability"),
        F.substring("text", 1, 80).alias("title"),
        "text",
        created.alias("created_at"),
        F.when(F.col("id") % 7 != 0, F.expr(f"{EPOCH} + id * INTERVAL '1' HOUR - (id % 48) * INTERVAL '1' MINUTE")).alias("published_at"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_alert"),
        F.when(F.col("id") % 11 == 0, created).alias("dismissed_at"),
    )


NEWS_SQL = """news AS (
  SELECT d.doc_id AS id, 'https://' || d.source || '.example.test/' || CAST(d.doc_id AS VARCHAR) AS url, d.source AS source_name,
         TRY_CAST(substr(d.source, 4) AS INTEGER) AS source_id,
         CASE TRY_CAST(substr(d.source, 4) AS INTEGER) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS reliability,
         substr(d.text, 1, 80) AS title, d.text, TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS created_at,
         CASE WHEN d.doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(d.doc_id) - to_minutes(d.doc_id % 48) END AS published_at,
         coalesce(l.toxic = 1, false) AS is_alert,
         CASE WHEN d.doc_id % 11 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(d.doc_id) END AS dismissed_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "news_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("news_id"), F.left("text", F.lit(200)).alias("summary"))
    joined = vectors.join(docs, "news_id")
    heads = joined.groupBy("label").agg(F.min("news_id").alias("head"))
    return joined.join(heads, "label").select(
        "news_id",
        F.when(F.col("news_id") % 19 != 0, F.col("summary")).alias("summary"),
        (F.col("news_id") % 13 != 0).alias("primary_event_found"),
        F.when(F.col("news_id") % 23 != 0, F.col("embedding")).alias("embedding"),
        F.when(F.col("news_id") % 17 != 0, F.col("head")).alias("event_cluster_id"),
    )


STATE_SQL = """event_state AS (
  SELECT e.vec_id AS news_id, CASE WHEN e.vec_id % 19 <> 0 THEN substr(d.text, 1, 200) END AS summary, e.vec_id % 13 <> 0 AS primary_event_found,
         CASE WHEN e.vec_id % 23 <> 0 THEN e.embedding END AS embedding,
         CASE WHEN e.vec_id % 17 <> 0 THEN min(e.vec_id) OVER (PARTITION BY e.label) END AS event_cluster_id
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in ranking: impact and urgency are the cluster's number modulo 4, source 2, BM25 0."""
    from tidewire.functions.scoring import category, relevance

    cluster = F.coalesce("event_cluster_id", "news_id")
    counts = event_state(spark, sf_dir).groupBy(cluster.alias("cluster_id")).agg(F.count("*").alias("member_count"))
    grade = (F.col("cluster_id") % 4).cast("int")
    score = relevance(grade, grade, F.lit(2), F.lit(0.0))
    return counts.select("cluster_id", F.round(score, 6).alias("relevance_score"), category(score).alias("category"), "member_count", grade.alias("impact"))


RANKING_SQL = """ranking AS (
  SELECT cluster_id, round(score, 6) AS relevance_score,
         CASE WHEN score >= 75 THEN 'требует внимания' WHEN score >= 50 THEN 'важно' WHEN score >= 25 THEN 'релевантно' ELSE 'низкая релевантность' END AS category, member_count, impact
  FROM (SELECT *, least(100.0, greatest(0.0, (0.30 * impact + 0.0375 * CASE WHEN impact >= 2 THEN impact ELSE 0 END) / 0.39375 / 3.0 * 100.0)) AS score
        FROM (SELECT coalesce(event_cluster_id, news_id) AS cluster_id, CAST(coalesce(event_cluster_id, news_id) % 4 AS INTEGER) AS impact, count(*) AS member_count
              FROM event_state GROUP BY ALL)))"""

BASE_SQL = f"WITH {NEWS_SQL},\n{STATE_SQL},\n{RANKING_SQL}\n"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source registry, from the distinct sources of documents."""
    number = F.expr("try_cast(substr(source, 4) AS int)")
    kind = F.when(F.col("id") % 4 == 3, "telegram").when(F.col("id") % 4 == 2, "web").otherwise("rss")
    link = F.when(F.col("id") % 4 == 3, F.concat(F.lit("https://t.me/"), "name")).otherwise(F.concat(F.lit("HTTPS://WWW."), "name", F.lit(".example.test/?utm_source=x")))
    return (
        table(spark, sf_dir, "documents").select(number.alias("id"), F.col("source").alias("name")).distinct()
        .select(
            "id", "name", kind.alias("type"), link.alias("link"), reliability(F.col("id")).alias("reliability"), (F.col("id") % 2 == 0).alias("is_enabled"),
            (F.col("id") % 5 != 0).alias("is_relevant"), F.when((F.col("id") % 4 != 3) & (F.col("id") % 3 == 0), 900).alias("poll_interval_seconds"),
        )
    )


SOURCE_SQL = """source AS (
  SELECT id, name, CASE id % 4 WHEN 3 THEN 'telegram' WHEN 2 THEN 'web' ELSE 'rss' END AS type,
         CASE WHEN id % 4 = 3 THEN 'https://t.me/' || name ELSE 'HTTPS://WWW.' || name || '.example.test/?utm_source=x' END AS link,
         CASE id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS reliability, id % 2 = 0 AS is_enabled, id % 5 <> 0 AS is_relevant,
         CASE WHEN id % 4 <> 3 AND id % 3 = 0 THEN 900 END AS poll_interval_seconds
  FROM (SELECT DISTINCT TRY_CAST(substr(source, 4) AS INTEGER) AS id, source AS name FROM documents))"""


def rss_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of each source: as many as its number modulo 3."""
    return source(spark, sf_dir).where("id % 3 > 0").select(
        F.col("id").alias("source_id"), F.explode(F.sequence(F.lit(1), F.col("id") % 3)).alias("n"), "name"
    ).select("source_id", F.concat(F.lit("https://"), "name", F.lit(".example.test/feed"), F.col("n").cast("string")).alias("url"))


RSS_LINK_SQL = """rss_link AS (
  SELECT id AS source_id, 'https://' || name || '.example.test/feed' || CAST(n AS VARCHAR) AS url
  FROM (SELECT id, name, unnest(range(1, id % 3 + 1)) AS n FROM source WHERE id % 3 > 0))"""


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of acts, from conversations: an act per conversation, a version per turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("act_id"), F.col("turn").alias("version_id"), F.col("role").alias("stage_code"), "text",
        F.concat(F.lit("/download/"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") / 2).cast("bigint").cast("string")).alias("document_url"),
        F.expr(f"{EPOCH} + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' DAY").alias("source_updated_at"),
    )


ACTS_SQL = """acts AS (
  SELECT conv_id AS act_id, turn AS version_id, role AS stage_code, text, '/download/' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 2 AS VARCHAR) AS document_url,
         TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_days(CAST(turn AS INTEGER)) AS source_updated_at
  FROM conversations)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The act registry, from orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("1"), F.col("o_custkey").cast("string"), F.lit("-8")).alias("bill_number"),
        F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "tracking").otherwise("unsupported").alias("tracking_status"),
        F.when(F.col("o_orderkey") % 5 != 0, F.expr("o_orderdate + INTERVAL '3' DAY")).alias("source_updated_at"),
        F.expr("o_orderdate + INTERVAL '1' DAY").alias("updated_at"),
        F.when(F.col("o_orderkey") % 3 == 0, "change").when(F.col("o_orderkey") % 3 == 1, "initial").alias("summary_kind"),
    )


REGISTRY_SQL = """registry AS (
  SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderpriority AS title, '1' || CAST(o_custkey AS VARCHAR) || '-8' AS bill_number,
         CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'tracking' ELSE 'unsupported' END AS tracking_status,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 3 DAY END AS source_updated_at, o_orderdate + INTERVAL 1 DAY AS updated_at,
         CASE o_orderkey % 3 WHEN 0 THEN 'change' WHEN 1 THEN 'initial' END AS summary_kind
  FROM orders)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing cards, from pages: one hub per host, cards in page order, a date a day apart."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("pos"), "url", F.concat(F.lit("https://"), host, F.lit("/news")).alias("hub_url"),
        F.regexp_extract("html", r"<title>([^<]*)", 1).alias("title_hint"),
        F.when(F.col("page_id") % 4 != 0, F.expr(f"{EPOCH} - (page_id % 9) * INTERVAL '1' DAY")).alias("published_at"),
    )


CARDS_SQL = """cards AS (
  SELECT page_id AS pos, url, 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) || '/news' AS hub_url,
         regexp_extract(html, '<title>([^<]*)', 1) AS title_hint,
         CASE WHEN page_id % 4 <> 0 THEN TIMESTAMP '2024-01-01' - to_days(CAST(page_id % 9 AS INTEGER)) END AS published_at
  FROM pages)"""
