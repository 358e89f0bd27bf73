"""Ingest states, candidates, anchors, targets, BM25, relevance and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scoring
from tidewire.functions.text import tokens
from tidewire.operators import dedup as op
from tidewire.operators import ranking as rk
from tidewire.plans.registry import query
from tidewire.sources import views
from tidewire.sources.views import NEWS_SQL, RANKING_SQL, STATE_SQL

_BASE = f"WITH {NEWS_SQL},\n{STATE_SQL}"
_MEMBERS = """members AS (
  SELECT coalesce(s.event_cluster_id, s.news_id) AS cluster_id, s.news_id, s.summary, s.primary_event_found, coalesce(n.published_at, n.created_at) AS event_time,
         CASE n.reliability WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS source_score
  FROM event_state s JOIN news n ON n.id = s.news_id WHERE s.summary IS NOT NULL AND s.primary_event_found IS NOT NULL AND s.embedding IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY event_time, news_id) AS oldest_rank,
         row_number() OVER (PARTITION BY cluster_id ORDER BY event_time DESC, news_id DESC) AS newest_rank,
         count(*) OVER (PARTITION BY cluster_id) AS member_count, max(source_score) OVER (PARTITION BY cluster_id) AS best_source FROM members),
targets AS (
  SELECT cluster_id, list(summary ORDER BY oldest_rank) AS summaries, list(primary_event_found ORDER BY oldest_rank) AS primary_event_flags,
         max(event_time) AS published_at, max(best_source) AS source_score, max(member_count) AS member_count
  FROM ranked WHERE oldest_rank = 1 OR newest_rank = 1 GROUP BY cluster_id)"""
_CANDIDATES = """vec AS (
  SELECT s.news_id AS id, coalesce(n.published_at, n.created_at) AS t, CAST(s.embedding AS DOUBLE[]) AS e, s.event_cluster_id AS c
  FROM event_state s JOIN news n ON n.id = s.news_id WHERE s.embedding IS NOT NULL),
best AS (
  SELECT q.id AS query_id, p.c AS cluster_id, max(list_cosine_similarity(q.e, p.e)) AS score
  FROM vec q JOIN vec p ON p.id <> q.id AND p.c IS NOT NULL AND p.t BETWEEN q.t - INTERVAL 3 DAY AND q.t + INTERVAL 3 DAY
  GROUP BY ALL HAVING max(list_cosine_similarity(q.e, p.e)) >= 0.16),
candidates AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, cluster_id) AS rank FROM best QUALIFY rank <= 6)"""


def _news_state(spark, sf):
    return views.news(spark, sf), views.event_state(spark, sf)


@query(f"""{_BASE} SELECT n.id, coalesce(s.summary IS NOT NULL AND s.primary_event_found IS NOT NULL, false) AS has_summary,
       s.embedding IS NOT NULL AS has_embedding, s.event_cluster_id IS NOT NULL AS has_cluster FROM news n LEFT JOIN event_state s ON s.news_id = n.id""")
def ingest_states(spark, sf):
    return op.ingest_states(*_news_state(spark, sf))


@query(f"WITH {STATE_SQL} SELECT news_id, summary FROM event_state WHERE event_cluster_id IS NULL AND summary IS NOT NULL AND primary_event_found IS NOT NULL AND embedding IS NULL")
def unembedded(spark, sf):
    return op.unembedded(views.event_state(spark, sf)).select("news_id", "summary")


@query(f"""{_BASE} SELECT n.id, coalesce(n.published_at, n.created_at) AS event_time, s.primary_event_found FROM event_state s JOIN news n ON n.id = s.news_id
WHERE s.event_cluster_id IS NULL AND s.summary IS NOT NULL AND s.primary_event_found IS NOT NULL AND s.embedding IS NOT NULL""")
def pending(spark, sf):
    return op.pending(*_news_state(spark, sf)).select("id", "event_time", "primary_event_found")


def _scores(spark, sf):
    known = op.vectors(*_news_state(spark, sf))
    return op.cluster_scores(known, known.where("event_cluster_id IS NOT NULL"), top_k=op.TOP_K)


@query(f"{_BASE},\n{_CANDIDATES} SELECT query_id, cluster_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM candidates")
def candidate_scores(spark, sf):
    return op.top_clusters(_scores(spark, sf)).select("query_id", "cluster_id", F.round("score", 6).alias("score"), "rank")


@query(f"""{_BASE},\n{_CANDIDATES} SELECT query_id, cluster_id,
CASE WHEN score >= 0.30 THEN 'SAME' WHEN score < 0.25 THEN 'DIFFERENT' ELSE 'UNCERTAIN' END AS verdict FROM candidates""")
def pair_decisions(spark, sf):
    return op.top_clusters(_scores(spark, sf)).select("query_id", "cluster_id", op.stand_in_decision(F.col("score")).alias("verdict"))


@query(f"""{_BASE},\n{_CANDIDATES} SELECT query_id, CASE WHEN bool_and(score >= 0.30) THEN 'SAME' WHEN bool_or(score < 0.25) THEN 'DIFFERENT' ELSE 'UNCERTAIN' END AS decision
FROM candidates GROUP BY query_id""")
def combine_decisions(spark, sf):
    verdicts = op.top_clusters(_scores(spark, sf)).withColumn("verdict", op.stand_in_decision(F.col("score")))
    return verdicts.groupBy("query_id").agg(scoring.combine_decisions(F.col("verdict")).alias("decision"))


@query(f"{_BASE},\n{_MEMBERS} SELECT cluster_id, news_id, event_time, summary, primary_event_found FROM ranked WHERE oldest_rank = 1 OR newest_rank = 1")
def cluster_anchors(spark, sf):
    return op.cluster_anchors(op.cluster_members(*_news_state(spark, sf)))


def _targets(spark, sf):
    return op.cluster_targets(op.cluster_members(*_news_state(spark, sf)))


@query(f"{_BASE},\n{_MEMBERS} SELECT cluster_id, summaries, primary_event_flags, published_at, source_score, member_count FROM targets")
def cluster_targets(spark, sf):
    return _targets(spark, sf)


@query(f"{_BASE},\n{_MEMBERS} SELECT cluster_id AS doc_id, array_to_string(summaries, chr(10) || chr(10)) AS text FROM targets")
def cluster_documents(spark, sf):
    return rk.documents_of(_targets(spark, sf))


@query(f"""{_BASE} SELECT DISTINCT coalesce(s.event_cluster_id, n.id) AS cluster_id FROM news n LEFT JOIN event_state s ON s.news_id = n.id WHERE n.id % 5 = 0""")
def affected_clusters(spark, sf):
    news, state = _news_state(spark, sf)
    return op_affected(news, state)


def op_affected(news, state):
    return rk.affected_clusters(news, state, news.where("id % 5 = 0").select("url"))


_TOKEN = "[0-9A-Za-zА-Яа-яЁё][0-9A-Za-zА-Яа-яЁё_-]{1,}"


def _tok(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, '{_TOKEN}'), lambda w: lower(w))"


_BM25 = f"""corpus AS (SELECT cluster_id AS doc_id, {_tok("array_to_string(summaries, chr(10) || chr(10))")} AS t FROM targets),
facets AS (SELECT item_id, {_tok("text")} AS t FROM benchmark),
asked AS (
  SELECT item_id, 1.0 AS w, term, count(*) AS times FROM (SELECT item_id, unnest(t) AS term FROM facets) GROUP BY ALL
  UNION ALL SELECT item_id, 0.35, term, count(*) FROM (SELECT item_id, unnest(t[1:8]) AS term FROM facets WHERE item_id % 2 = 0) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM corpus) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
total AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM corpus),
facet_score AS (
  SELECT tf.doc_id, a.item_id,
         sum(a.w * a.times * ln(1.0 + (total.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (1.0 - 0.75 + 0.75 * tf.size / total.mean))) AS score
  FROM asked a JOIN df USING (term) JOIN tf USING (term), total GROUP BY ALL),
bm25 AS (SELECT c.doc_id, coalesce(max(f.score), 0.0) AS bm25 FROM corpus c LEFT JOIN facet_score f USING (doc_id) GROUP BY c.doc_id)"""


def facets(spark, sf):
    """Facets from the benchmark table; every second one has terms (its first eight tokens)."""
    items = views.table(spark, sf, "benchmark")
    return items.select(
        F.col("item_id").alias("facet_id"), F.col("text").alias("semantic_query"), F.when(F.col("item_id") % 2 == 0, F.slice(tokens(F.col("text")), 1, 8)).alias("terms")
    )


@query(f"{_BASE},\n{_MEMBERS},\n{_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm25")
def bm25_scores(spark, sf):
    return rk.facet_scores(rk.documents_of(_targets(spark, sf)), facets(spark, sf)).select("doc_id", F.round("bm25", 6).alias("bm25"))


_RELEVANCE = """relevance AS (
  SELECT t.cluster_id, t.member_count, least(100.0, greatest(0.0, (0.30 * (t.cluster_id % 4) + 0.05625 * (3.0 * b.bm25 / (b.bm25 + 10.0))
         + 0.0375 * CASE WHEN t.cluster_id % 4 >= 2 THEN t.cluster_id % 4 ELSE 0 END + 0.015 * (t.source_score - 2)) / 0.39375 / 3.0 * 100.0)) AS score
  FROM targets t JOIN bm25 b ON b.doc_id = t.cluster_id)"""


def _ranked(spark, sf):
    grade = (F.col("cluster_id") % 4).cast("int")
    return rk.rank(_targets(spark, sf), facets(spark, sf), grade, grade)


@query(f"{_BASE},\n{_MEMBERS},\n{_BM25},\n{_RELEVANCE} SELECT cluster_id, round(score, 6) AS relevance_score, member_count FROM relevance")
def relevance_score(spark, sf):
    return _ranked(spark, sf).select("cluster_id", F.round("relevance_score", 6).alias("relevance_score"), "member_count")


@query(f"""{_BASE},\n{_MEMBERS},\n{_BM25},\n{_RELEVANCE} SELECT
CASE WHEN score >= 75 THEN 'требует внимания' WHEN score >= 50 THEN 'важно' WHEN score >= 25 THEN 'релевантно' ELSE 'низкая релевантность' END AS category, count(*) AS clusters
FROM relevance GROUP BY ALL""")
def relevance_category(spark, sf):
    return _ranked(spark, sf).groupBy("category").agg(F.count("*").alias("clusters"))


@query(f"SELECT doc_id, {_tok('text')} AS tokens FROM documents")
def bm25_tokens(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))


@query("""SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 6)) AS unit
FROM embeddings""")
def embedding_normalize(spark, sf):
    unit = scoring.l2_quotients(F.col("embedding"))
    return views.table(spark, sf, "embeddings").select("vec_id", F.transform(unit, lambda x: scoring.round_half_away(x, 6)).alias("unit"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR role = 'x' THEN 'DIFFERENT' WHEN role = 'user' AND turn % 5 <> 0 THEN 'SAME' ELSE 'UNCERTAIN' END AS decision FROM conversations""")
def normalize_decision(spark, sf):
    rows = views.table(spark, sf, "conversations")
    conflicts = F.when(F.col("turn") % 3 == 0, F.array(F.lit("date"))).otherwise(F.array().cast("array<string>"))
    unknowns = F.when(F.col("turn") % 5 == 0, F.array(F.lit("place")))
    verdict = F.when(F.col("role") == "user", "SAME").otherwise(F.lit(None).cast("string"))
    return rows.select("conv_id", "turn", scoring.normalize_decision(verdict, conflicts, unknowns).alias("decision"))


@query("SELECT event_id, user_id % 2 = 0 AND value > 10 AND event_type <> 'view' AS is_alert FROM events")
def regulatory_alert(spark, sf):
    flags = (F.col("user_id") % 2 == 0, F.col("value") > 10, F.col("event_type") != "view")
    return views.table(spark, sf, "events").select("event_id", scoring.regulatory_alert(*flags).alias("is_alert"))


_GREEDY = """p AS (
  SELECT s.news_id AS id, coalesce(n.published_at, n.created_at) AS t, CAST(s.embedding AS DOUBLE[]) AS e, s.event_cluster_id AS c, s.primary_event_found AS asks,
         s.event_cluster_id IS NULL AND s.summary IS NOT NULL AND s.primary_event_found IS NOT NULL AS waits, s.summary IS NOT NULL AND s.primary_event_found IS NOT NULL AS complete
  FROM event_state s JOIN news n ON n.id = s.news_id WHERE s.embedding IS NOT NULL),
met AS (
  SELECT q.id, coalesce(x.c, x.id) AS cluster, max(list_cosine_similarity(q.e, x.e)) AS score
  FROM p q JOIN p x ON x.id <> q.id AND x.t BETWEEN q.t - INTERVAL 3 DAY AND q.t + INTERVAL 3 DAY AND (x.c IS NOT NULL OR (x.waits AND (x.t, x.id) < (q.t, q.id)))
  WHERE q.waits AND q.asks GROUP BY ALL HAVING max(list_cosine_similarity(q.e, x.e)) >= 0.16),
top AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, cluster) <= 6),
lists AS (
  SELECT id, list({'c': cluster, 'v': CASE WHEN score >= 0.30 THEN 'SAME' WHEN score < 0.25 THEN 'DIFFERENT' ELSE 'UNCERTAIN' END}) AS cs
  FROM top WHERE cluster IN (SELECT coalesce(c, id) FROM p WHERE complete) GROUP BY id),
plan AS (
  SELECT p.id, coalesce(cs, []) AS cs, row_number() OVER (ORDER BY p.t, p.id) AS k FROM p LEFT JOIN lists ON lists.id = p.id WHERE p.waits)"""
_CHOICE = """(WITH m AS (SELECT list_transform(plan.cs, lambda x: {'c': coalesce(f.clusters[list_position(f.ids, x.c)], x.c), 'v': x.v}) AS cs),
  g AS (SELECT list_transform(list_distinct(list_transform(cs, lambda x: x.c)), lambda c: {'c': c, 'v': list_distinct(list_transform(list_filter(cs, lambda y: y.c = c), lambda y: y.v))}) AS gs FROM m),
  d AS (SELECT list_filter(gs, lambda x: x.v = ['SAME']) AS same, list_filter(gs, lambda x: NOT list_contains(x.v, 'DIFFERENT') AND x.v <> ['SAME']) AS unsure FROM g)
  SELECT CASE WHEN len(same) = 1 AND len(unsure) = 0 THEN same[1].c ELSE plan.id END FROM d)"""


@query(f"""{_BASE.replace("WITH", "WITH RECURSIVE", 1)},\n{_GREEDY},
fold AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS ids, []::BIGINT[] AS clusters
  UNION ALL SELECT plan.k, list_append(f.ids, plan.id), list_append(f.clusters, {_CHOICE}) FROM fold f JOIN plan ON plan.k = f.k + 1)
SELECT unnest(ids) AS id, unnest(clusters) AS cluster_id FROM (SELECT * FROM fold ORDER BY k DESC LIMIT 1)""")
def greedy_clusters(spark, sf):
    return op.greedy_clusters(*_news_state(spark, sf))


@query(f"""WITH {STATE_SQL},\n{RANKING_SQL} SELECT cluster_id, to_json({{'cluster_id': cluster_id, 'impact': impact, 'members': member_count}}) AS payload FROM ranking""")
def model_payload(spark, sf):
    return views.ranking(spark, sf).select("cluster_id", F.to_json(F.struct("cluster_id", "impact", F.col("member_count").alias("members"))).alias("payload"))
