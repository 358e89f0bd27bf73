"""The source registry: types, address changes, feeds, schedules, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.operators.merge import first_by

POLL_SECONDS, FEEDS_MAX = 300, 10


def source_type(link: Column, has_feed: Column) -> Column:
    return F.when(urls.is_telegram(link), "telegram").when(has_feed, "rss").otherwise("web")


def with_feeds(sources: DataFrame, feeds: DataFrame) -> DataFrame:
    """Sources by link with their feed urls in order."""
    lists = feeds.groupBy(F.col("source_id").alias("id")).agg(F.sort_array(F.collect_list("url")).alias("feeds"))
    return sources.join(lists, "id", "left").withColumn("feeds", F.coalesce("feeds", F.array().cast("array<string>"))).orderBy("link", "id")


def first_feed(feeds: DataFrame) -> DataFrame:
    return feeds.groupBy("source_id").agg(F.min("url").alias("url"))


def cap_feeds(found: DataFrame, limit: int = FEEDS_MAX) -> DataFrame:
    """Found feeds of an RSS version, best score first, a url once, at most ``limit`` per source."""
    once = first_by(found.where(F.startswith(F.lower("version"), F.lit("rss"))), ["source_id", "url"], F.desc("score"), F.col("url"))
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "url"))
    return once.withColumn("rank", n).where(F.col("rank") <= limit)


def reconcile(wanted: DataFrame, running: DataFrame) -> DataFrame:
    """The action per source that brings the running schedules to the wanted state.

    ``wanted``: sources; ``running``: id, seconds.
    """
    push = F.col("type") == "telegram"
    seconds = F.when(~push, F.coalesce(F.nullif("poll_interval_seconds", F.lit(0)), F.lit(POLL_SECONDS)))
    now = running.select("id", F.col("seconds").alias("__now")).withColumn("__there", F.lit(True))
    joined = wanted.select("id", "type", "is_enabled", seconds.alias("seconds")).join(now, "id", "full_outer")
    there, on = F.col("__there").isNotNull(), F.coalesce("is_enabled", F.lit(False))
    action = (
        F.when(on & push & ~there, "subscribe").when(on & push, "keep").when(~on & push, F.when(there, "unsubscribe").otherwise("none"))
        .when(on & ~there, "schedule").when(on & (F.col("seconds") != F.col("__now")), "reschedule").when(on, "keep").when(there, "unschedule").otherwise("none")
    )
    return joined.select("id", action.alias("action"), F.when(on, F.col("seconds")).alias("seconds"))


def update_addresses(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Sources after address changes ``(id, new_link, has_feed)``.

    Only a different identity counts: type and interval follow the new address, the
    relevance verdict is dropped, and a source that the verdict had switched off
    comes back on.
    """
    joined = sources.join(changes, "id", "left")
    moved = F.coalesce(urls.source_identity(F.col("new_link")) != urls.source_identity(F.col("link")), F.lit(False))
    kind = source_type(F.col("new_link"), F.coalesce("has_feed", F.lit(False)))
    interval = F.when(kind == "telegram", F.lit(None)).otherwise(F.coalesce(F.nullif("poll_interval_seconds", F.lit(0)), F.lit(POLL_SECONDS)))

    def after(new: Column, old: str) -> Column:
        return F.when(moved, new).otherwise(F.col(old)).alias(old)

    rest = [c for c in sources.columns if c not in ("link", "type", "poll_interval_seconds", "is_relevant", "is_enabled")]
    return joined.select(
        *rest, after(F.col("new_link"), "link"), after(kind, "type"), after(interval, "poll_interval_seconds"),
        after(F.col("is_enabled") | ~F.col("is_relevant"), "is_enabled"), after(F.lit(True), "is_relevant"),
    )


def drop_orphans(items: DataFrame, sources: DataFrame) -> DataFrame:
    return items.join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")


def feed_violations(feeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Feeds whose parent is missing or no RSS source."""
    return feeds.join(sources.where("type = 'rss'").select(F.col("id").alias("source_id")), "source_id", "left_anti")


def constraint_checks(sources: DataFrame) -> DataFrame:
    """Violations by constraint, in one row."""
    same = sources.groupBy(urls.source_identity(F.col("link")).alias("k")).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_links"))
    rules = sources.agg(
        F.count_if(~F.col("is_relevant") & F.col("is_enabled")).alias("enabled_irrelevant"), F.count_if((F.col("type") == "telegram") & F.col("poll_interval_seconds").isNotNull()).alias("scheduled_push")
    )
    return same.join(rules, F.lit(True))  # one row each


def relink(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items without a known source take the source of their link; names follow."""
    by_link = sources.select(F.col("link").alias("source_link"), F.col("id").alias("__id"), F.col("name").alias("__name"))
    joined = items.join(by_link, "source_link", "left")
    return joined.withColumns({"source_id": F.coalesce("source_id", "__id"), "source_name": F.coalesce("source_name", "__name")}).drop("__id", "__name")
