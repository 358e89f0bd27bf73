"""The two loops of a site crawl over all sites at once: finding listing pages, and reading them page by page.

Sites advance side by side, one join per step. What a site has seen, fetched and
spent is kept in narrow tables between steps (written, so no step repeats another).
Pages come from ``fetch`` and verdicts from ``classify``, functions from frame to
frame: a table of crawled pages, a data source, a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import dates, scoring, urls
from tidewire.operators.crawl import CANDIDATES_MAX, DEPTH_MAX, HUB_LINK_SCORE, LISTING_CONFIDENCE, PAGES_MAX, expandable_links
from tidewire.sources.shared import Scratch

Step = Callable[[DataFrame], DataFrame]


def _first_of_site(rows: DataFrame, room: int, used: DataFrame) -> DataFrame:
    """The first rows of each site, by ``pos``, as many as ``room`` leaves after ``used`` (site, used); room 0: all."""
    if not room:
        return rows
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).where(F.col("__n") <= room)
    return ranked.join(used, "site", "left").where(F.col("__n") + F.coalesce("used", F.lit(0)) <= room).drop("__n", "used")


def take(links: DataFrame, seen: DataFrame, room: int) -> DataFrame:
    """``site, pos, url, identity``: what a step fetches of ``links`` (site, pos, url).

    Identities that are new to their site, at their first link, while the site has
    fetched fewer than ``room`` pages in all.
    """
    named = links.withColumn("identity", urls.listing_identity(F.col("url"))).where("identity != ''")
    first = named.groupBy("site", "identity").agg(F.min(F.struct("pos", "url")).alias("first")).select("site", "first.pos", "first.url", "identity")
    new = first.join(seen, ["site", "identity"], "left_anti")
    return _first_of_site(new, room, seen.groupBy("site").agg(F.count("*").alias("used"))).select("site", "pos", "url", "identity")


def child_links(pages: DataFrame, max_score: float = HUB_LINK_SCORE) -> DataFrame:
    """``site, pos, url`` of the links of ``pages`` that may lead to listings, in the order of pages and of links in them."""
    each = pages.select("site", F.col("pos").alias("of"), F.posexplode("links").alias("k", "link"))
    links = each.select("site", F.concat("of", F.array("k")).alias("pos"), urls.normalize_url(F.col("link.url")).alias("url"), F.nullif(F.trim("link.label"), F.lit("")).alias("title_hint"))
    return expandable_links(links, max_score).select("site", "pos", "url")


def discover(sites: DataFrame, fetch: Step, classify: Step, max_depth: int = DEPTH_MAX, max_pages: int = PAGES_MAX, max_calls: int = PAGES_MAX, max_hubs: int = 0, min_confidence: float = LISTING_CONFIDENCE, max_score: float = HUB_LINK_SCORE) -> DataFrame:
    """``site, rank, url, origin, depth, score, title, next_page``: each site's listing pages, best first.

    ``sites``: site (its home page), name. ``fetch`` adds ``title, text, links`` (of url and
    label) to the pages it gets and leaves failed ones out; ``classify`` adds ``verdict``
    (is_listing, may_contain_listings, confidence; null where it failed) and ``next_page``.

    The home page is fetched and its links are followed; pages that the verdict sees
    one step before listings, or that got none, are followed further, at most
    ``max_depth`` steps. A site fetches ``max_pages`` pages and asks for ``max_calls``
    verdicts in all (0: no limit), no identity twice. With ``max_depth`` 0 the home page
    itself is judged. A site without a listing has its home page.
    """
    scratch = Scratch(sites.sparkSession, "discovery")
    seed = sites.select("site", F.array(F.lit(0)).alias("pos"), F.col("site").alias("url"), urls.listing_identity(F.col("site")).alias("identity"))
    seen = scratch.keep(seed.dropDuplicates(["site"]), "taken")
    pages = scratch.keep(fetch(seen.select("site", "pos", "url")), "pages")
    spent = pages.select("site").limit(0).withColumn("used", F.lit(0).cast("bigint"))
    accepted = []
    for depth in range(min(1, max_depth), max_depth + 1):
        if depth:
            batch = scratch.keep(take(child_links(pages, max_score), seen.select("site", "identity"), max_pages), "taken")
            seen = seen.unionByName(batch)
            pages = scratch.keep(fetch(batch.select("site", "pos", "url")), "pages")
        judged = scratch.keep(classify(_first_of_site(pages, max_calls, spent)), "judged")
        spent = scratch.keep(spent.unionByName(judged.select("site", F.lit(1).cast("bigint").alias("used"))).groupBy("site").agg(F.sum("used").alias("used")), "spent")
        v = F.col("verdict")
        is_listing = F.coalesce(v["is_listing"], F.lit(False))
        accepted.append(judged.where(is_listing & F.coalesce(v["confidence"] >= min_confidence, F.lit(False))).withColumn("depth", F.lit(depth)))
        pages = judged.where(v.isNull() | (~is_listing & F.coalesce(v["may_contain_listings"], F.lit(False))))
        if pages.isEmpty():
            break
    hubs = accepted[0]
    for more in accepted[1:]:
        hubs = hubs.unionByName(more)
    own = F.coalesce(F.nullif(urls.normalize_url(F.col("url")), F.lit("")), F.col("url"))
    found = hubs.select("site", "pos", own.alias("url"), F.lit("listing").alias("origin"), "depth", "title", "text", "next_page")
    empty = F.lit(None).cast("string")
    home = sites.join(found.select("site").distinct(), "site", "left_anti").select("site", F.array(F.lit(0)).alias("pos"), F.col("site").alias("url"), F.lit("seed").alias("origin"), F.lit(0).alias("depth"), F.col("name").alias("title"), empty.alias("text"), empty.alias("next_page"))
    scored = found.unionByName(home).withColumn("score", scoring.score(scoring.hub_rules(F.col("url"), F.col("title"), F.col("text")))["value"])
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "depth", "pos"))
    ranked = scored.withColumn("rank", rank).select("site", "rank", "url", "origin", "depth", "score", "title", "next_page")
    return ranked.where(F.col("rank") <= max_hubs) if max_hubs else ranked


def traverse(hubs: DataFrame, fetch: Step, now: Column, max_pages: int = 0, days: int = dates.FRESH_DAYS) -> tuple[DataFrame, DataFrame]:
    """Reads every hub's listing from page to page: its cards, and where and why it stopped.

    ``hubs``: site, rank, url, next_page (a hint for the first step only). ``fetch`` gets
    ``site, rank, hub, page, url`` and adds ``cards`` (an array of url, title, published_at
    in page order) and ``next`` (the page's own next link).

    Cards: ``site, rank, hub, page, pos, url, title, published_at``; a card that is one of
    the site's hubs is passed over, and the first one dated before the window ends its hub.
    Stops: ``site, hub, pages, reason``: ``old``, ``seen`` (the next page was read), ``cap``
    (``max_pages``, 0: none), ``missing`` (a page that failed) or ``end``.
    """
    scratch = Scratch(hubs.sparkSession, "traversal")
    at = scratch.keep(hubs.select("site", "rank", F.col("url").alias("hub"), F.lit(1).alias("page"), "url", F.col("next_page").alias("hint")), "at")
    known = scratch.keep(hubs.select("site", urls.listing_identity(F.col("url")).alias("identity")).distinct(), "hubs")
    key = ["site", "hub"]
    read = at.select(*key, "url")
    cards, stops = [], []
    while not at.isEmpty():
        pages = scratch.keep(fetch(at.drop("hint")).select(*key, "cards", "next"), "pages")
        each = at.join(pages, key).select("site", "rank", "hub", "page", F.posexplode("cards").alias("pos", "card"))
        named = each.withColumn("identity", urls.listing_identity(F.col("card.url"))).join(known, ["site", "identity"], "left_anti")
        old = F.coalesce(dates.is_old(F.col("card.published_at"), now, days), F.lit(False))
        named = scratch.keep(named.withColumn("old", old), "cards")
        ends = named.where("old").groupBy(*key).agg(F.min("pos").alias("end"))
        cards.append(named.join(ends, key, "left").where(F.col("end").isNull() | (F.col("pos") < F.col("end"))))
        step = at.join(pages.select(*key, "next").withColumn("there", F.lit(True)), key, "left").join(ends, key, "left")
        then = F.nullif(F.coalesce(F.nullif("hint", F.lit("")), F.col("next")), F.lit(""))
        met = read.select(*key, F.col("url").alias("then")).distinct().withColumn("met", F.lit(True))
        step = step.withColumn("then", then).join(met, [*key, "then"], "left")
        capped = F.lit(bool(max_pages)) & (F.col("page") >= max_pages)
        reason = F.when(F.col("there").isNull(), "missing").when(F.col("end").isNotNull(), "old").when(F.col("then").isNull(), "end").when(F.col("met"), "seen").when(capped, "cap")
        step = scratch.keep(step.select("site", "rank", "hub", "page", "then", reason.alias("reason")), "step")
        stops.append(step.where("reason IS NOT NULL").select(*key, (F.col("page") - F.when(F.col("reason") == "missing", 1).otherwise(0)).alias("pages"), "reason"))
        on = step.where("reason IS NULL")
        at = on.select("site", "rank", "hub", (F.col("page") + 1).alias("page"), F.col("then").alias("url"), F.lit(None).cast("string").alias("hint"))
        read = read.unionByName(at.select(*key, "url"))
    all_stops = stops[0] if stops else at.select(*key, F.col("page").alias("pages"), F.lit("").alias("reason"))
    for more in stops[1:]:
        all_stops = all_stops.unionByName(more)
    if not cards:
        return at.select("site", "rank", "hub", "page", F.lit(0).alias("pos"), "url", F.lit("").alias("title"), F.lit(None).cast("timestamp").alias("published_at")), all_stops
    found = cards[0]
    for more in cards[1:]:
        found = found.unionByName(more)
    return found.select("site", "rank", "hub", "page", "pos", "card.url", "card.title", "card.published_at"), all_stops


def first_cards(cards: DataFrame, cap: int = CANDIDATES_MAX) -> DataFrame:
    """A site's cards, each url once where it is seen first (hub after hub, page after page), the first ``cap`` (0: all)."""
    order = F.struct("rank", "page", "pos")
    once = cards.groupBy("site", "url").agg(F.min(F.struct(order.alias("pos"), "hub", "title", "published_at")).alias("first"))
    flat = once.select("site", "url", "first.pos", "first.hub", "first.title", "first.published_at")
    none = flat.select("site").limit(0).withColumn("used", F.lit(0).cast("bigint"))
    return _first_of_site(flat, cap, none).select("site", F.col("pos.rank").alias("rank"), "hub", F.col("pos.page").alias("page"), F.col("pos.pos").alias("pos"), "url", "title", "published_at")
