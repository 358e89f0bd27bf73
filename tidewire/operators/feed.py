"""The feed: one row per event, filters, escaped search, three visibility modes, a total order."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scoring import LOW
from tidewire.functions.text import contains_ci

VISIBLE, DISMISSED, ALL = "visible", "dismissed", "all"
Q_MAX = 200


@dataclass(frozen=True)
class FeedQuery:
    q: str | None = None
    since: datetime | str | None = None
    visibility: str = VISIBLE
    is_alert: bool | None = None

    def __post_init__(self) -> None:
        if self.visibility not in (VISIBLE, DISMISSED, ALL):
            raise ValueError(f"visibility must be {VISIBLE}, {DISMISSED} or {ALL}")
        if self.q is not None and not 1 <= len(self.q) <= Q_MAX:
            raise ValueError(f"q must have 1 to {Q_MAX} characters")


def event_time() -> Column:
    return F.coalesce("published_at", "created_at")


def joined(news: DataFrame, state: DataFrame, ranking: DataFrame) -> DataFrame:
    """News with its dedup state and, on cluster heads only, its ranking."""
    of_state = state.select(F.col("news_id").alias("id"), "event_cluster_id")
    of_rank = ranking.select(F.col("cluster_id").alias("id"), "relevance_score", "category", "member_count")
    return news.join(of_state, "id", "left").join(of_rank, "id", "left")


def is_head() -> Column:
    return F.col("event_cluster_id").isNull() | (F.col("event_cluster_id") == F.col("id"))


def conditions(query: FeedQuery) -> list[Column]:
    out: list[Column] = [is_head()]
    if query.is_alert is not True:  # an alert shows whatever the ranker made of it
        out.append(F.col("category").isNotNull() & (F.col("category") != LOW))
    if query.visibility == VISIBLE:
        out.append(F.col("dismissed_at").isNull())
    elif query.visibility == DISMISSED:
        out.append(F.col("dismissed_at").isNotNull())
    if query.since is not None:
        out.append(event_time() >= F.lit(str(query.since)).cast("timestamp_ntz"))
    if query.is_alert is not None:
        out.append(F.col("is_alert").eqNullSafe(F.lit(query.is_alert)))
    if query.q:
        out.append(contains_ci(F.col("title"), query.q) | contains_ci(F.col("text"), query.q))
    return out


def feed(news: DataFrame, state: DataFrame, ranking: DataFrame, query: FeedQuery | None = None, ordered: bool = True) -> DataFrame:
    found = joined(news, state, ranking)
    for c in conditions(query or FeedQuery()):
        found = found.where(c)
    return found.orderBy(F.desc_nulls_last("published_at"), F.desc("created_at"), "id") if ordered else found


def flatten_relevance(details: DataFrame) -> DataFrame:
    """``id, urgency, impact``: the four judged dimensions in their fixed order."""
    fields = ["finance", "reputation", "technology", "competition"]
    impact = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"details.impact.{d}_score").alias("score"), F.col(f"details.impact.{d}_reason").alias("reason")) for d in fields))
    return details.select("id", F.col("details.impact.urgency_basis").alias("urgency_basis"), F.col("details.impact.urgency_reason").alias("urgency_reason"), impact.alias("impact"))


#: What a reader gets of an item, in this order.
CARD = (
    "id", "schema_version", "source_id", "source_link", "source_name", "source_type", "source_reliability", "source_tags", "url", "title", "text", "excerpt", "published_at", "updated_at",
    "summary", "event_cluster_id", "relevance", "dismissed_at", "is_alert", "created_at",
)


def news_out(news: DataFrame, state: DataFrame, ranked: DataFrame) -> DataFrame:
    """Items as feed cards: the item's fields with the pipeline's results, null until their stage has reached it; columns that a table lacks are null."""
    results = state.select(F.col("news_id").alias("id"), "summary", "event_cluster_id")
    of_cluster = ranked.select(F.col("cluster_id").alias("__cluster"), F.struct("*").alias("relevance"))
    own = news.withColumnRenamed("reliability", "source_reliability") if "reliability" in news.columns and "source_reliability" not in news.columns else news
    kept = [c for c in CARD if c in own.columns and c not in ("summary", "event_cluster_id", "relevance")]
    joined = own.select(*kept).join(results, "id", "left").join(of_cluster, F.coalesce("event_cluster_id", "id") == F.col("__cluster"), "left")
    tags = F.array().cast("array<string>")
    return joined.select(*(F.col(c) if c in joined.columns else (tags if c == "source_tags" else F.lit(None).cast("string")).alias(c) for c in CARD))
