"""BM25 over the clusters of a batch, relevance, and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import scoring
from tidewire.functions.text import tokens


def bm25(corpus: DataFrame, queries: DataFrame, k1: float = scoring.BM25_K1, b: float = scoring.BM25_B) -> DataFrame:
    """``query_id, doc_id, score`` of pairs that share a term. ``corpus``: doc_id, text; ``queries``: query_id, text.

    Statistics cover the given corpus only; a repeated query term counts repeatedly.
    """
    words = corpus.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("length"), F.explode_outer("t").alias("term"))
    lengths = corpus.select(F.size(tokens(F.col("text"))).alias("length"))
    totals = lengths.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"))  # one row
    tf = words.where("term IS NOT NULL").groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    ratio = F.coalesce(F.try_divide("length", "mean"), F.lit(0.0))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * ratio))
    df = df.join(F.broadcast(totals))  # one row for every term
    return asked.join(df, "term").join(tf, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def facet_scores(corpus: DataFrame, facets: DataFrame) -> DataFrame:
    """``doc_id, bm25``: the best facet of every document. ``facets``: facet_id, semantic_query, terms (array, may be null)."""
    asked = facets.select(F.concat(F.lit("d"), F.col("facet_id").cast("string")).alias("query_id"), F.col("semantic_query").alias("text")).unionByName(
        facets.where("size(terms) > 0").select(F.concat(F.lit("t"), F.col("facet_id").cast("string")).alias("query_id"), F.array_join("terms", " ").alias("text"))
    )
    weight = F.when(F.startswith("query_id", F.lit("t")), scoring.BM25_TERMS_WEIGHT).otherwise(1.0)
    per_facet = bm25(corpus, asked).groupBy("doc_id", F.substring("query_id", 2, 100).alias("facet")).agg(F.sum(weight * F.col("score")).alias("score"))
    best = per_facet.groupBy("doc_id").agg(F.max("score").alias("bm25"))
    return corpus.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def documents_of(targets: DataFrame) -> DataFrame:
    """One text per cluster: its anchors' summaries, oldest first, a blank line between."""
    return targets.select(F.col("cluster_id").alias("doc_id"), F.array_join("summaries", "\n\n").alias("text"))


def rank(targets: DataFrame, facets: DataFrame, impact: Column, urgency: Column) -> DataFrame:
    """``cluster_id, relevance_score, category, member_count, bm25`` of every cluster."""
    scored = targets.join(facet_scores(documents_of(targets), facets).withColumnRenamed("doc_id", "cluster_id"), "cluster_id")
    value = scoring.relevance(impact, urgency, F.col("source_score"), F.col("bm25"))
    return scored.select("cluster_id", value.alias("relevance_score"), scoring.category(value).alias("category"), "member_count", "bm25")


def affected_clusters(news: DataFrame, state: DataFrame, urls: DataFrame) -> DataFrame:
    known = news.join(urls.select("url").distinct(), "url", "left_semi").select("id")
    return known.join(state.withColumnRenamed("news_id", "id"), "id", "left").select(F.coalesce("event_cluster_id", "id").alias("cluster_id")).distinct()


def progress(news: DataFrame, state: DataFrame, ranking: DataFrame) -> DataFrame:
    """Six counters in one row, one pass per table."""
    a = news.agg(F.count("*").alias("news"), F.count_if("is_alert").alias("alerts"))
    b = state.agg(F.count("summary").alias("summarized"), F.count("embedding").alias("embedded"), F.count("event_cluster_id").alias("clustered"))
    c = ranking.agg(F.count("*").alias("ranked"))
    return a.join(b, F.lit(True)).join(c, F.lit(True)).select("news", "summarized", "embedded", "clustered", "ranked", "alerts")  # one row each


def by_category(ranking: DataFrame) -> DataFrame:
    return ranking.groupBy("category").agg(F.count("*").alias("clusters"), F.round(F.avg("relevance_score")).alias("avg_score")).orderBy(F.desc("avg_score"), "category")


def multi_member(ranking: DataFrame, news: DataFrame, limit: int = 15) -> DataFrame:
    titles = news.select(F.col("id").alias("cluster_id"), "title")
    return (
        ranking.where("member_count > 1").join(titles, "cluster_id")
        .select("cluster_id", "member_count", "category", F.round("relevance_score").alias("score"), "title", "relevance_score")
        .orderBy(F.desc("member_count"), F.desc("relevance_score"), "cluster_id").limit(limit).drop("relevance_score")
    )


def top_relevance(ranking: DataFrame, news: DataFrame, limit: int = 10) -> DataFrame:
    titles = news.select(F.col("id").alias("cluster_id"), "source_name", "title")
    return (
        ranking.join(titles, "cluster_id").orderBy(F.desc("relevance_score"), "cluster_id").limit(limit)
        .select("cluster_id", F.round("relevance_score").alias("score"), "category", "source_name", "title")
    )


def alerts_report(news: DataFrame, limit: int = 30) -> DataFrame:
    return news.where("is_alert").orderBy(F.desc_nulls_last("published_at"), "id").limit(limit).select("id", "source_name", "published_at", "title", "url")
