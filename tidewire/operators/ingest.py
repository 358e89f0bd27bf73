"""One micro-batch from arrival to ranking, as next states of the three tables.

Every stage reads what is still missing (no summary, no vector, no cluster), so a
batch that is run again, or resumed after a failure, changes nothing that is done.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import models, scoring
from tidewire.operators import dedup, merge, ranking


@dataclass(frozen=True)
class Tables:
    """``news`` (id, url, ..., is_alert), ``state`` (one row per news at most), ``ranking`` (one row per cluster)."""

    news: DataFrame
    state: DataFrame
    ranking: DataFrame


#: What a port of structs answers: summaries of items, and judgements of clusters.
SUMMARY, JUDGEMENT = "summary string, primary_event_found boolean", "impact array<int>, urgency_basis string"
Port = Callable[[list[dict]], list]


@dataclass(frozen=True)
class Models:
    """Column functions, or ports in their place (see ``functions.models.answers``: answers in order, or by index).

    ``summarise`` gets items (``id, title, text``) and answers ``summary`` and
    ``primary_event_found``; ``judge`` gets clusters (``cluster_id, summaries, primary_event_flags, published_at, source_score, member_count, company``)
    and answers the impact scores and the ``urgency_basis``. Rows whose calls fail stay
    as they are: the next batch asks for them again.
    """

    summary: Callable[[Column], Column] = models.summary
    has_primary_event: Callable[[Column], Column] = models.has_primary_event
    embedding: Callable[[Column], Column] = models.embedding
    decide: Callable[[Column], Column] = dedup.stand_in_decision
    align: Callable[[list[dict]], list[list[dict]]] | None = None  # asked in place of ``decide``, once a cluster
    impact: Callable[[Column], Column] = models.grade
    urgency: Callable[[Column], Column] = models.grade
    summarise: Port | None = None
    judge: Port | None = None
    company: str = ""
    items: int = models.CALL_ITEMS
    tries: int = 3
    wait: float = 1.0
    at_once: int = 20


def store_news(tables: Tables, batch: DataFrame) -> Tables:
    """New items are added; of known ones only the alert flag may turn on."""
    once = merge.first_by(batch, ["url"], F.col("id"))
    return replace(tables, news=merge.upsert_alert(tables.news, once.select(*tables.news.columns)))


def summarise(tables: Tables, use: Models) -> Tables:
    done = tables.state.where("summary IS NOT NULL AND primary_event_found IS NOT NULL").select(F.col("news_id").alias("id"))
    missing = tables.news.join(done, "id", "left_anti")
    if use.summarise is None:
        found = missing.select(F.col("id").alias("news_id"), use.summary(F.col("text")).alias("summary"))
        found = found.withColumn("primary_event_found", use.has_primary_event(F.col("summary")))
    else:
        said = models.answers(missing.select("id", "title", "text"), ["id", "title", "text"], use.summarise, SUMMARY, use.items, use.tries, use.wait, use.at_once)
        found = said.where(~F.col("failed") & F.col("answer.summary").isNotNull()).select(F.col("id").alias("news_id"), "answer.summary", "answer.primary_event_found")
    return replace(tables, state=merge.upsert_state(tables.state, found))


def embed(tables: Tables, use: Models) -> Tables:
    vectors = dedup.unembedded(tables.state).select("news_id", use.embedding(F.col("summary")).alias("embedding"))
    return replace(tables, state=merge.set_where_null(tables.state, vectors, "news_id", "embedding"))


def assign(tables: Tables, use: Models) -> Tables:
    chosen = dedup.greedy_clusters(tables.news, tables.state, use.align, use.decide).select(F.col("id").alias("news_id"), F.col("cluster_id").alias("event_cluster_id"))
    return replace(tables, state=merge.set_where_null(tables.state, chosen, "news_id", "event_cluster_id"))


def rank(tables: Tables, batch: DataFrame, facets: DataFrame, use: Models) -> Tables:
    """Ranks the clusters that the batch's items belong to; BM25 statistics cover these clusters only."""
    touched = ranking.affected_clusters(tables.news, tables.state, batch)
    members = dedup.cluster_members(tables.news, tables.state).join(touched, "cluster_id", "left_semi")
    targets = dedup.cluster_targets(members)
    impact, urgency = use.impact(F.col("cluster_id")), use.urgency(F.col("cluster_id"))
    if use.judge is not None:
        asked = targets.withColumn("company", F.lit(use.company))
        said = models.answers(asked, asked.columns, use.judge, JUDGEMENT, 1, use.tries, use.wait, use.at_once)
        targets = said.where(~F.col("failed") & (F.size("answer.impact") > 0))
        impact, urgency = F.array_max("answer.impact"), scoring.urgency_grade(F.col("answer.urgency_basis"))
    ranked = ranking.rank(targets, facets, impact, urgency)
    return replace(tables, ranking=merge.upsert_ranking(tables.ranking, ranked.select(*tables.ranking.columns)))


def ingest_batch(tables: Tables, batch: DataFrame, facets: DataFrame, use: Models | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda frame, name: frame) -> Tables:
    """All stages in turn. ``keep(frame, name)`` may store each stage's table and return it read back."""
    use = use or Models()
    tables = store_news(tables, batch)
    tables = replace(tables, news=keep(tables.news, "news"))
    for stage in (summarise, embed, assign):
        tables = stage(tables, use)
        tables = replace(tables, state=keep(tables.state, f"state-{stage.__name__}"))
    return rank(tables, batch, facets, use)
