"""Crawl analytics: cards, frontier, duplicate merge, freshness cut-offs, stale streaks, judgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import dates, scoring, urls
from tidewire.operators.merge import first_by

CARD_SCORE, HUB_LINK_SCORE, LISTING_CONFIDENCE = 0.18, 0.35, 0.75
CANDIDATES_MAX, PAGES_MAX, DEPTH_MAX = 50, 60, 3
HARVEST_BATCH, STALE_BATCHES, MIN_DATES, MIN_WORDS, DATE_CONFIDENCE = 10, 2, 5, 80, 0.65


def merge_duplicates(articles: DataFrame) -> DataFrame:
    """One article per identity (canonical url, else url): the newest, the earlier row at equal dates; newest first."""
    identity = urls.normalize_url(F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("url")))
    kept = first_by(articles.withColumn("identity", identity), ["identity"], F.desc("published_at"), F.col("pos"))
    return kept.orderBy(F.desc("published_at"), "pos")


def dedupe_cards(cards: DataFrame, cap: int = CANDIDATES_MAX) -> DataFrame:
    """The first card of each url, and of these the first ``cap`` per site (0: all)."""
    first = first_by(cards, ["url"], F.col("pos"))
    if not cap:
        return first
    return first.withColumn("__n", F.row_number().over(Window.partitionBy("hub_url").orderBy("pos"))).where(F.col("__n") <= cap).drop("__n")


def cards_not_hubs(cards: DataFrame, hubs: DataFrame) -> DataFrame:
    known = hubs.select(urls.listing_identity(F.col("hub_url")).alias("__identity")).distinct()
    return cards.withColumn("__identity", urls.listing_identity(F.col("url"))).join(known, "__identity", "left_anti").drop("__identity")


def cards_until_old(cards: DataFrame, now: Column, days: int = dates.FRESH_DAYS) -> DataFrame:
    """Of each hub page, the cards before the first one dated before the window."""
    old = F.coalesce(dates.is_old(F.col("published_at"), now, days), F.lit(False))
    seen = F.max(old.cast("int")).over(Window.partitionBy("hub_url").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return cards.withColumn("__old", seen).where("__old = 0").drop("__old")


def stale_streak(articles: DataFrame, now: Column, batch: int = HARVEST_BATCH, stop_after: int = STALE_BATCHES, min_dates: int = MIN_DATES, days: int = dates.FRESH_DAYS) -> DataFrame:
    """Per hub, each batch of articles with its run length of stale batches and whether it is still read.

    A batch is stale if at least ``min_dates`` of its articles are dated and all
    dates are before the window; a fresh batch resets the run.
    """
    numbered = articles.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("hub_url").orderBy("pos")) - 1) / batch))
    old = dates.is_old(F.col("published_at"), now, days)
    batches = numbered.groupBy("hub_url", "batch").agg(F.count("*").alias("articles"), F.count("published_at").alias("dated"), F.bool_and(old).alias("all_old"))
    batches = batches.withColumn("stale", (F.col("dated") >= min_dates) & F.coalesce("all_old", F.lit(False)))
    order = Window.partitionBy("hub_url").orderBy("batch")
    islands = batches.withColumn("island", F.sum((~F.col("stale")).cast("int")).over(order))
    runs = islands.withColumn("streak", F.sum(F.col("stale").cast("bigint")).over(Window.partitionBy("hub_url", "island").orderBy("batch")))
    stops = F.min(F.when(F.col("streak") >= stop_after, F.col("batch"))).over(Window.partitionBy("hub_url"))
    return runs.withColumn("read", F.coalesce(F.col("batch") <= stops, F.lit(True))).select("hub_url", "batch", "articles", "dated", "stale", "streak", "read")


def judge(articles: DataFrame, now: Column, days: int = dates.FRESH_DAYS) -> DataFrame:
    """Dated articles become accepted or rejected with a reason; all others pass through."""
    dated = F.col("status") == "dated"
    fresh = F.coalesce(dates.is_fresh(F.col("published_at"), now, days), F.lit(False))
    titled = F.coalesce(F.col("title") != "", F.lit(False))
    reason = F.when(dated & ~fresh, "out_of_window").when(dated & ~titled, "no_title").otherwise(F.col("rejection"))
    status = F.when(dated & fresh & titled, "accepted").when(dated, "rejected").otherwise(F.col("status"))
    return articles.withColumns({"rejection": reason, "status": status})


def resolve_dates(articles: DataFrame, min_confidence: float = DATE_CONFIDENCE) -> DataFrame:
    """Fetched articles after the model's date guess ``(is_article, published_at, confidence)``; null: no answer."""
    asked = F.col("status") == "fetched"
    guess = F.col("guess")
    usable = F.coalesce((guess["confidence"] >= min_confidence) & guess["published_at"].isNotNull(), F.lit(False))
    reason = (
        F.when(asked & guess.isNull(), "no_date").when(asked & ~F.coalesce(guess["is_article"], F.lit(False)), "not_article")
        .when(asked & ~usable, "no_date").otherwise(F.col("rejection"))
    )
    dated = asked & F.coalesce(guess["is_article"], F.lit(False)) & usable
    return articles.withColumns(
        {"published_at": F.when(dated, guess["published_at"]).otherwise(F.col("published_at")), "status": F.when(dated, "dated").when(asked, "rejected").otherwise(F.col("status")), "rejection": reason}
    )


def fetch_outcome(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Articles with their fetched page; a missing page is a rejection."""
    got = pages.select("url", F.col("html").alias("__html")).withColumn("__there", F.lit(True))
    there = F.col("__there").isNotNull()
    return articles.join(got, "url", "left").withColumns(
        {"status": F.when(there, "fetched").otherwise("rejected"), "rejection": F.when(~there, "fetch_failed"), "html": F.col("__html")}
    ).drop("__html", "__there")


def listing_verdicts(pages: DataFrame, budget: int, min_confidence: float = LISTING_CONFIDENCE) -> DataFrame:
    """Pages that the site's call budget affords (0: all), with whether each is a hub and whether its links are followed.

    ``verdict``: ``(is_listing, may_contain_listings, confidence)``, null where the model failed.
    """
    n = F.row_number().over(Window.partitionBy("site").orderBy("pos"))
    paid = pages.withColumn("__n", n).where((F.col("__n") <= budget) | F.lit(budget == 0)).drop("__n")
    v = F.col("verdict")
    listing = F.coalesce(v["is_listing"] & (v["confidence"] >= min_confidence), F.lit(False))
    follow = v.isNull() | (~F.coalesce(v["is_listing"], F.lit(False)) & F.coalesce(v["may_contain_listings"], F.lit(False)))
    return paid.withColumns({"accepted": listing, "expand": follow})


def expandable_links(links: DataFrame, max_score: float = HUB_LINK_SCORE) -> DataFrame:
    """Links worth following: resolvable, on the same site, no pagination, not article-like."""
    scored = scoring.score(scoring.article_rules(F.col("url"), F.col("title_hint")))["value"]
    return (
        links.where(urls.normalize_url(F.col("url")) != "").where(urls.host_matches(F.col("url"), [], F.col("site")))
        .where(~urls.is_pagination(F.col("url"))).withColumn("score", F.round(scored, 6)).where(F.col("score") < max_score)
    )


def take_frontier(seen: DataFrame, links: DataFrame, room: int) -> DataFrame:
    """New identities in order, the first ``room`` per site (0: all): what a crawl step visits next."""
    known = seen.select("site", urls.listing_identity(F.col("url")).alias("identity")).distinct()
    new = first_by(links.withColumn("identity", urls.listing_identity(F.col("url"))).where("identity != ''"), ["site", "identity"], F.col("pos")).join(known, ["site", "identity"], "left_anti")
    if not room:
        return new
    return new.withColumn("__n", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).where(F.col("__n") <= room).drop("__n")


def reach(seeds: DataFrame, links: DataFrame, max_depth: int = DEPTH_MAX) -> DataFrame:
    """``node, depth`` of everything within ``max_depth`` hops, at its smallest depth.

    ``seeds``: node; ``links``: source, target. A bounded loop of a join and an anti-join.
    """
    found = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    edge = found
    for depth in range(1, max_depth + 1):
        step = edge.join(links, edge.node == links.source).select(F.col("target").alias("node")).distinct()
        edge = step.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        found = found.unionByName(edge)
    return found


def rank_hubs(hubs: DataFrame, limit: int = 0) -> DataFrame:
    """Hubs by score, the earlier one first at equal scores; ``limit`` 0: all."""
    ordered = hubs.orderBy(F.desc("score"), "pos")
    return ordered.limit(limit) if limit else ordered


def crawl_stats(articles: DataFrame) -> DataFrame:
    return articles.groupBy("status", "rejection").agg(F.count("*").alias("articles"))


def call_budget(items: DataFrame, max_calls: int, *order: Column) -> DataFrame:
    """The items a budget of model calls covers, in order (0: no limit)."""
    return items.orderBy(*order).limit(max_calls) if max_calls else items


def article_to_news(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Accepted articles as flat news records with their source's columns."""
    of = sources.select(F.col("id").alias("source_id"), F.col("link").alias("source_link"), F.col("name").alias("source_name"), F.col("type").alias("source_type"), F.col("reliability").alias("source_reliability"))
    return articles.where("status = 'accepted'").join(of, "source_id").select(
        F.lit(1).alias("schema_version"), "source_id", "source_link", "source_name", "source_type", "source_reliability", "url", "title", "text", "published_at"
    )


def mark_irrelevant(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """A web source whose crawl found no candidate is not relevant and goes off."""
    counts = candidates.groupBy("source_id").agg(F.count("*").alias("__found")).withColumnRenamed("source_id", "id")
    none = (F.col("type") == "web") & F.col("__found").isNull()
    return sources.join(counts, "id", "left").withColumns({"is_relevant": F.col("is_relevant") & ~none, "is_enabled": F.col("is_enabled") & ~none}).select(*sources.columns)
