"""Crawl, act and source-registry queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import dates, urls
from tidewire.operators import acts as act
from tidewire.operators import crawl as op
from tidewire.operators import registry as reg
from tidewire.operators.merge import first_by
from tidewire.plans.registry import query
from tidewire.plans.url_queries import _HINT, _KEPT, _LISTED, _NORMAL, _PAGING, _PARTS, ARTICLE_SQL
from tidewire.sources import views
from tidewire.sources.views import ACTS_SQL, CARDS_SQL, REGISTRY_SQL, RSS_LINK_SQL, SOURCE_SQL

_C = f"WITH {CARDS_SQL}"
NOW_SQL = "TIMESTAMP '2024-01-01'"


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def _cards(spark, sf):
    return views.cards(spark, sf)


@query(f"WITH {_PARTS}, k AS (SELECT page_id, {_NORMAL} AS identity, page_id % 50 AS day FROM clean) SELECT page_id AS pos FROM k QUALIFY row_number() OVER (PARTITION BY identity ORDER BY day DESC, page_id) = 1")
def merge_duplicates(spark, sf):
    rows = views.table(spark, sf, "pages").select(F.col("page_id").alias("pos"), "url", F.lit("").alias("canonical_url"), (F.col("page_id") % 50).alias("published_at"))
    return op.merge_duplicates(rows).select("pos")


@query("SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def unique_by_url(spark, sf):
    return first_by(views.table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.col("event_id")).select("event_id")


@query(f"{_C}, f AS (SELECT *, row_number() OVER (PARTITION BY hub_url ORDER BY pos) AS n FROM (SELECT * FROM cards QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1)) SELECT pos, hub_url FROM f WHERE n <= 50")
def card_dedupe(spark, sf):
    return op.dedupe_cards(_cards(spark, sf)).select("pos", "hub_url")


@query(f"WITH {_PARTS}, l AS (SELECT page_id, scheme || '://' || netloc || p || CASE WHEN len({_LISTED}) > 0 THEN '?' || array_to_string({_LISTED}, '&') ELSE '' END AS identity FROM clean) SELECT page_id AS pos FROM l WHERE identity NOT IN (SELECT identity FROM l WHERE page_id % 10 = 0)")
def cards_not_hubs(spark, sf):
    cards = _cards(spark, sf)
    return op.cards_not_hubs(cards, cards.where("pos % 10 = 0").select(F.col("url").alias("hub_url"))).select("pos")


@query(f"{_C} SELECT pos FROM (SELECT pos, max(coalesce(published_at < {NOW_SQL} - INTERVAL 3 DAY, false)) OVER (PARTITION BY hub_url ORDER BY pos) AS old FROM cards) WHERE NOT old")
def cards_until_old(spark, sf):
    return op.cards_until_old(_cards(spark, sf), now()).select("pos")


#: A site's hub: the last two labels of its host.
_SITE = r"^[A-Za-z]+://(?:[^/]*\.)?([^./]+\.[^./]+)(?:/|$)"


@query(f"""{_C}, s AS (SELECT *, regexp_extract(hub_url, '{_SITE}', 1) AS hub FROM cards), n AS (SELECT *, (row_number() OVER (PARTITION BY hub ORDER BY pos) - 1) // 10 AS batch FROM s),
b AS (SELECT hub, batch, count(*) AS articles, count(published_at) AS dated, count(published_at) >= 5 AND coalesce(bool_and(published_at < {NOW_SQL} - INTERVAL 1 DAY), false) AS stale FROM n GROUP BY ALL),
i AS (SELECT *, sum(CASE WHEN stale THEN 0 ELSE 1 END) OVER (PARTITION BY hub ORDER BY batch) AS island FROM b),
r AS (SELECT *, sum(CASE WHEN stale THEN 1 ELSE 0 END) OVER (PARTITION BY hub, island ORDER BY batch) AS streak FROM i)
SELECT hub AS hub_url, batch, articles, dated, stale, CAST(streak AS BIGINT) AS streak, coalesce(batch <= min(CASE WHEN streak >= 2 THEN batch END) OVER (PARTITION BY hub), true) AS read FROM r""")
def stale_streak(spark, sf):
    cards = _cards(spark, sf).withColumn("hub_url", F.regexp_extract("hub_url", _SITE, 1))
    return op.stale_streak(cards, now(), days=1)


def _judged(spark, sf):
    articles = _cards(spark, sf).select("pos", "hub_url", "published_at", F.when(F.col("pos") % 6 != 0, F.col("title_hint")).otherwise("").alias("title")).withColumns(
        {"status": F.when(F.col("published_at").isNotNull(), "dated").otherwise("fetched"), "rejection": F.lit(None).cast("string")}
    )
    return op.judge(articles, now())


_JUDGED = f"""judged AS (SELECT pos, CASE WHEN published_at IS NULL THEN 'fetched' WHEN published_at BETWEEN {NOW_SQL} - INTERVAL 3 DAY AND {NOW_SQL} + INTERVAL 12 HOUR AND title <> '' THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN published_at IS NULL THEN NULL WHEN NOT (published_at BETWEEN {NOW_SQL} - INTERVAL 3 DAY AND {NOW_SQL} + INTERVAL 12 HOUR) THEN 'out_of_window' WHEN title = '' THEN 'no_title' END AS rejection
  FROM (SELECT *, CASE WHEN pos % 6 <> 0 THEN title_hint ELSE '' END AS title FROM cards))"""


@query(f"{_C},\n{_JUDGED} SELECT pos, status, rejection FROM judged")
def judgement(spark, sf):
    return _judged(spark, sf).select("pos", "status", "rejection")


@query(f"{_C},\n{_JUDGED} SELECT status, rejection, count(*) AS articles FROM judged GROUP BY ALL")
def crawl_stats(spark, sf):
    return op.crawl_stats(_judged(spark, sf))


@query(f"""{_C} SELECT pos, CASE WHEN published_at IS NOT NULL THEN 'dated' WHEN pos % 8 = 0 THEN 'rejected' WHEN pos % 3 = 0 THEN 'rejected' ELSE 'dated' END AS status,
CASE WHEN published_at IS NOT NULL THEN NULL WHEN pos % 8 = 0 THEN 'not_article' WHEN pos % 3 = 0 THEN 'no_date' END AS rejection FROM cards""")
def date_resolution(spark, sf):
    guess = F.struct((F.col("pos") % 8 != 0).alias("is_article"), now().alias("published_at"), F.when(F.col("pos") % 3 == 0, 0.5).otherwise(0.9).alias("confidence"))
    rows = _cards(spark, sf).withColumns({"status": F.when(F.col("published_at").isNotNull(), "dated").otherwise("fetched"), "rejection": F.lit(None).cast("string"), "guess": guess})
    return op.resolve_dates(rows).select("pos", "status", "rejection")


@query("SELECT page_id AS pos, CASE WHEN page_id % 5 <> 0 THEN 'fetched' ELSE 'rejected' END AS status, CASE WHEN page_id % 5 = 0 THEN 'fetch_failed' END AS rejection FROM pages")
def fetch_outcome(spark, sf):
    pages = views.table(spark, sf, "pages")
    found = pages.where("page_id % 5 <> 0").groupBy("url").agg(F.min("html").alias("html"))
    wanted = pages.select(F.col("page_id").alias("pos"), F.when(F.col("page_id") % 5 != 0, F.col("url")).otherwise(F.concat(F.lit("missing:"), "url")).alias("url"), F.lit(None).cast("string").alias("html"))
    return op.fetch_outcome(wanted.drop("html"), found).select("pos", "status", "rejection")


@query(f"""{_C}, n AS (SELECT pos, hub_url, row_number() OVER (PARTITION BY hub_url ORDER BY pos) AS n FROM cards)
SELECT pos, pos % 3 = 0 AND pos % 2 = 0 AS accepted, pos % 7 = 0 OR (pos % 3 <> 0 AND pos % 5 = 0) AS expand FROM n WHERE n <= 20 AND pos % 7 <> 0
UNION ALL SELECT pos, false, true FROM n WHERE n <= 20 AND pos % 7 = 0""")
def listing_verdicts(spark, sf):
    verdict = F.when(F.col("pos") % 7 != 0, F.struct((F.col("pos") % 3 == 0).alias("is_listing"), (F.col("pos") % 5 == 0).alias("may_contain_listings"), F.when(F.col("pos") % 2 == 0, 0.8).otherwise(0.5).alias("confidence")))
    pages = _cards(spark, sf).select("pos", F.col("hub_url").alias("site"), verdict.alias("verdict"))
    return op.listing_verdicts(pages, 20).select("pos", "accepted", "expand")


@query(f"WITH {_PARTS},\n{ARTICLE_SQL} SELECT page_id AS pos, round(score, 6) AS score FROM scored WHERE len(list_filter(pairs, lambda x: lower(split_part(x, '=', 1)) IN ({_PAGING}))) = 0 AND score < 0.35")
def expandable_links(spark, sf):
    links = _cards(spark, sf).withColumn("site", F.col("hub_url"))
    return op.expandable_links(links).select("pos", "score")


@query(f"""WITH {_PARTS}, l AS (SELECT page_id, netloc, scheme || '://' || netloc || p || CASE WHEN len({_LISTED}) > 0 THEN '?' || array_to_string({_LISTED}, '&') ELSE '' END AS identity FROM clean),
f AS (SELECT * FROM l WHERE page_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY netloc, identity ORDER BY page_id) = 1),
u AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM l s WHERE s.page_id % 5 = 0 AND s.netloc = f.netloc AND s.identity = f.identity))
SELECT page_id AS pos FROM u QUALIFY row_number() OVER (PARTITION BY netloc ORDER BY page_id) <= 3""")
def frontier_take(spark, sf):
    links = views.table(spark, sf, "pages").select(F.col("page_id").alias("pos"), "url", urls.netloc(F.col("url")).alias("site"))
    return op.take_frontier(links.where("pos % 5 = 0"), links.where("pos % 5 <> 0"), 3).select("pos")


def event_links(events):
    """A link graph over all events; targets lie among as many ids as there are events."""
    n = max(1, events.count())
    return events.select(F.col("event_id").alias("source"), (F.col("event_id") * 3 % n).alias("target")).unionByName(
        events.where("event_id % 4 = 0").select(F.col("event_id").alias("source"), (F.col("event_id") + 1).alias("target"))
    )


@query("""WITH RECURSIVE l AS (SELECT event_id AS s, event_id * 3 % (SELECT greatest(1, count(*)) FROM events) AS t FROM events UNION SELECT event_id, event_id + 1 FROM events WHERE event_id % 4 = 0),
r(node, depth) AS (SELECT event_id, 0 FROM events WHERE event_id % 97 = 5 UNION SELECT l.t, r.depth + 1 FROM r JOIN l ON l.s = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def link_bfs(spark, sf):
    links = event_links(views.table(spark, sf, "events"))
    return op.reach(views.table(spark, sf, "events").where("event_id % 97 = 5").select(F.col("event_id").alias("node")), links)


@query(f"{_C} SELECT pos, round(CAST(pos * 37 % 101 AS DOUBLE) / 100, 2) AS score FROM cards ORDER BY score DESC, pos LIMIT 20")
def hub_rank(spark, sf):
    return op.rank_hubs(_cards(spark, sf).select("pos", F.round((F.col("pos") * 37 % 101) / 100, 2).alias("score")), 20)


@query(f"{_C} SELECT pos FROM cards ORDER BY pos LIMIT 50")
def call_budget(spark, sf):
    return op.call_budget(_cards(spark, sf), 50, F.col("pos")).select("pos")


@query(f"{_C} SELECT pos, published_at BETWEEN {NOW_SQL} - INTERVAL 3 DAY AND {NOW_SQL} + INTERVAL 12 HOUR AS fresh, published_at < {NOW_SQL} - INTERVAL 3 DAY AS old FROM cards")
def freshness(spark, sf):
    at = F.col("published_at")
    return _cards(spark, sf).select("pos", dates.is_fresh(at, now()).alias("fresh"), dates.is_old(at, now()).alias("old"))


@query(f"""WITH {SOURCE_SQL}, n AS (SELECT doc_id, TRY_CAST(substr(source, 4) AS INTEGER) AS source_id FROM documents WHERE doc_id % 2 = 0)
SELECT n.doc_id, s.name AS source_name, s.type AS source_type, s.reliability AS source_reliability FROM n JOIN source s ON s.id = n.source_id""")
def article_to_news(spark, sf):
    docs = views.table(spark, sf, "documents")
    articles = docs.select(
        F.col("doc_id").cast("string").alias("url"), F.expr("try_cast(substr(source, 4) AS int)").alias("source_id"), F.left("text", F.lit(80)).alias("title"), "text",
        now().alias("published_at"), F.when(F.col("doc_id") % 2 == 0, "accepted").otherwise("rejected").alias("status"),
    )
    return op.article_to_news(articles, views.source(spark, sf)).select(F.col("url").cast("bigint").alias("doc_id"), "source_name", "source_type", "source_reliability")


@query(f"WITH {SOURCE_SQL} SELECT id, is_relevant AND NOT (type = 'web' AND id % 5 <> 1) AS is_relevant, is_enabled AND NOT (type = 'web' AND id % 5 <> 1) AS is_enabled FROM source")
def mark_irrelevant(spark, sf):
    sources = views.source(spark, sf)
    return op.mark_irrelevant(sources, sources.where("id % 5 = 1").select(F.col("id").alias("source_id"))).select("id", "is_relevant", "is_enabled")


# Acts.


@query(f"WITH {ACTS_SQL} SELECT act_id, min(version_id) AS version_id FROM acts GROUP BY act_id")
def npa_first_version(spark, sf):
    return act.first_versions(views.acts(spark, sf)).select("act_id", "version_id")


@query(f"""WITH {ACTS_SQL}, p AS (SELECT *, lag(stage_code) OVER w AS s, lag(document_url) OVER w AS d, lag(text) OVER w AS t, row_number() OVER w AS n FROM acts WINDOW w AS (PARTITION BY act_id ORDER BY version_id)),
k AS (SELECT *, CASE WHEN n = 1 THEN 'first' WHEN stage_code IS DISTINCT FROM s OR document_url IS DISTINCT FROM d THEN 'changed' ELSE 'unchanged' END AS kind FROM p)
SELECT act_id, version_id, kind, kind = 'changed' AND text IS DISTINCT FROM t AS needs_summary, CASE WHEN kind = 'changed' AND text IS NOT DISTINCT FROM t THEN '{act.NO_TEXT_CHANGE}' END AS message FROM k""")
def npa_changes(spark, sf):
    return act.changes(views.acts(spark, sf))


@query(f"""WITH {ACTS_SQL}, m AS (SELECT *, stage_code = 'assistant' AND version_id >= 2 AS pub FROM acts)
SELECT act_id, version_id, CASE WHEN max(pub) OVER (PARTITION BY act_id ORDER BY version_id) THEN 'published' ELSE 'tracking' END AS status,
       NOT coalesce(max(pub) OVER (PARTITION BY act_id ORDER BY version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS checked FROM m""")
def npa_state(spark, sf):
    return act.states(views.acts(spark, sf), (F.col("stage_code") == "assistant") & (F.col("version_id") >= 2))


@query(f"WITH {ACTS_SQL} SELECT act_id, count(*) AS n_versions, list(stage_code ORDER BY source_updated_at DESC, version_id DESC) AS stages FROM acts GROUP BY act_id")
def npa_detail(spark, sf):
    return act.detail(views.acts(spark, sf))


@query(f"WITH {ACTS_SQL} SELECT version_id, stage_code, source_updated_at FROM acts WHERE act_id = 3 ORDER BY source_updated_at DESC, version_id")
def npa_versions(spark, sf):
    return act.versions(views.acts(spark, sf), 3).select("version_id", "stage_code", "source_updated_at")


@query(f"WITH {ACTS_SQL} SELECT a.act_id, a.version_id, a.stage_code, a.document_url, c.n AS n_versions FROM acts a JOIN (SELECT act_id, max(version_id) AS v, count(*) AS n FROM acts GROUP BY act_id) c ON a.act_id = c.act_id AND a.version_id = c.v")
def npa_apply(spark, sf):
    return act.apply_updates(views.acts(spark, sf)).select("act_id", "version_id", "stage_code", "document_url", "n_versions")


@query(f"WITH {ACTS_SQL} SELECT act_id, version_id, CASE WHEN version_id = min(version_id) OVER (PARTITION BY act_id) THEN substr(text, 1, 50) END AS summary, CASE WHEN version_id = min(version_id) OVER (PARTITION BY act_id) THEN 'initial' END AS summary_kind FROM acts")
def npa_initial_summary(spark, sf):
    return act.initial_summaries(views.acts(spark, sf), F.left("text", F.lit(50)))


@query(f"WITH {ACTS_SQL} SELECT act_id, version_id, 'tracking' AS tracking_status FROM acts WHERE version_id = 0 AND act_id % 3 <> 0")
def npa_register(spark, sf):
    rows = views.acts(spark, sf).where("version_id = 0").withColumn("url", F.concat(F.lit("https://sozd.duma.gov.ru/bill/"), F.col("act_id").cast("string"), F.lit("-8")))
    return act.register(rows.where("act_id % 3 = 0"), rows).select("act_id", "version_id", "tracking_status")


@query(f"WITH {ACTS_SQL} SELECT act_id, arg_max(document_url, version_id // 2 * 1000 - version_id) AS document_url FROM acts GROUP BY act_id")
def latest_document(spark, sf):
    rows = views.acts(spark, sf).select("act_id", "document_url", F.floor(F.col("version_id") / 2).alias("stage_index"), F.lit(0).alias("event_date"), F.col("version_id").alias("pos"))
    return act.latest_document(rows)


@query(f"WITH {REGISTRY_SQL} SELECT id, created_at, title FROM registry ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def npa_page(spark, sf):
    return act.page(views.registry(spark, sf), 50, 100).select("id", "created_at", "title")


@query(f"WITH {REGISTRY_SQL} SELECT id, bill_number FROM registry WHERE contains(lower(title || ' ' || bill_number || ' ' || tracking_status), 'urgent 11') ORDER BY coalesce(source_updated_at, updated_at) DESC, id")
def npa_search(spark, sf):
    return act.search(views.registry(spark, sf).withColumn("stage", F.col("tracking_status")), " URGENT 11").select("id", "bill_number")


@query(f"WITH {REGISTRY_SQL} SELECT id, coalesce(summary_kind = 'change', false) OR id % 7 = 0 AS has_changes FROM registry")
def npa_has_changes(spark, sf):
    article_changes = F.when(F.col("id") % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return views.registry(spark, sf).select("id", (F.coalesce(F.col("summary_kind") == "change", F.lit(False)) | (F.size(article_changes) > 0)).alias("has_changes"))


@query(f"WITH {REGISTRY_SQL} SELECT id, bill_number FROM registry WHERE tracking_status = 'tracking'")
def npa_tracking(spark, sf):
    return views.registry(spark, sf).where("tracking_status = 'tracking'").select("id", "bill_number")


# Sources.

_SRC = f"WITH {SOURCE_SQL}"


@query(f"{_SRC} SELECT id, name, type, link FROM source ORDER BY link, id")
def sources_list(spark, sf):
    return views.source(spark, sf).select("id", "name", "type", "link").orderBy("link", "id")


@query(f"{_SRC} SELECT id, name FROM source WHERE is_enabled AND type = 'rss'")
def sources_enabled(spark, sf):
    return views.source(spark, sf).where("is_enabled AND type = 'rss'").select("id", "name")


@query(f"{_SRC} SELECT count(*) AS total, count(*) FILTER (WHERE is_enabled) AS tracked FROM source")
def sources_tracked(spark, sf):
    return views.source(spark, sf).agg(F.count("*").alias("total"), F.count_if("is_enabled").alias("tracked"))


@query(f"{_SRC}, {RSS_LINK_SQL} SELECT s.id, coalesce(list(r.url ORDER BY r.url) FILTER (WHERE r.url IS NOT NULL), []) AS feeds FROM source s LEFT JOIN rss_link r ON r.source_id = s.id GROUP BY s.id")
def source_feeds(spark, sf):
    return reg.with_feeds(views.source(spark, sf), views.rss_link(spark, sf)).select("id", "feeds")


@query(f"{_SRC}, {RSS_LINK_SQL} SELECT source_id, min(url) AS url FROM rss_link GROUP BY source_id")
def first_feed(spark, sf):
    return reg.first_feed(views.rss_link(spark, sf))


@query(f"{_SRC}, {RSS_LINK_SQL} SELECT source_id, url FROM rss_link WHERE source_id NOT IN (SELECT id FROM source WHERE type = 'rss')")
def rss_link_violations(spark, sf):
    return reg.feed_violations(views.rss_link(spark, sf), views.source(spark, sf))


@query(f"{_SRC} SELECT id, CASE WHEN id % 4 = 3 THEN 'telegram' WHEN id % 4 = 2 THEN 'web' ELSE 'rss' END AS type FROM source")
def source_type(spark, sf):
    return views.source(spark, sf).select("id", reg.source_type(F.col("link"), F.col("id") % 4 != 2).alias("type"))


@query(f"""{_SRC} SELECT id, CASE WHEN type = 'telegram' THEN CASE WHEN is_enabled AND id % 3 = 0 THEN 'keep' WHEN is_enabled THEN 'subscribe' WHEN id % 3 = 0 THEN 'unsubscribe' ELSE 'none' END
  WHEN is_enabled AND id % 3 <> 0 THEN 'schedule' WHEN is_enabled AND coalesce(poll_interval_seconds, 300) <> 300 THEN 'reschedule' WHEN is_enabled THEN 'keep' WHEN id % 3 = 0 THEN 'unschedule' ELSE 'none' END AS action,
  CASE WHEN is_enabled AND type <> 'telegram' THEN coalesce(poll_interval_seconds, 300) END AS seconds FROM source""")
def reconcile_actions(spark, sf):
    sources = views.source(spark, sf)
    return reg.reconcile(sources, sources.where("id % 3 = 0").select("id", F.lit(300).alias("seconds")))


@query(f"""{_SRC} SELECT id, CASE WHEN id % 2 = 0 THEN 'https://new.example.test/' || CAST(id AS VARCHAR) ELSE link END AS link, CASE WHEN id % 2 = 0 THEN 'web' ELSE type END AS type,
  CASE WHEN id % 2 = 0 THEN coalesce(poll_interval_seconds, 300) ELSE poll_interval_seconds END AS poll_interval_seconds,
  CASE WHEN id % 2 = 0 THEN is_enabled OR NOT is_relevant ELSE is_enabled END AS is_enabled, CASE WHEN id % 2 = 0 THEN true ELSE is_relevant END AS is_relevant FROM source""")
def source_update(spark, sf):
    sources = views.source(spark, sf)
    changes = sources.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://new.example.test/"), F.col("id").cast("string"))).otherwise(F.lower("link")).alias("new_link"), F.lit(False).alias("has_feed"))
    return reg.update_addresses(sources, changes).select("id", "link", "type", "poll_interval_seconds", "is_enabled", "is_relevant")


@query(f"{_SRC} SELECT (SELECT count(*) FROM (SELECT lower(link) FROM source GROUP BY 1 HAVING count(*) > 1)) AS duplicate_links, count(*) FILTER (WHERE NOT is_relevant AND is_enabled) AS enabled_irrelevant, count(*) FILTER (WHERE type = 'telegram' AND poll_interval_seconds IS NOT NULL) AS scheduled_push FROM source")
def constraint_checks(spark, sf):
    return reg.constraint_checks(views.source(spark, sf))


@query("""WITH f AS (SELECT user_id AS source_id, 'feed' || CAST(event_id % 7 AS VARCHAR) AS url, max(value) AS score FROM events WHERE event_type <> 'view' GROUP BY ALL)
SELECT source_id, url FROM f QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, url) <= 3""")
def feed_cap(spark, sf):
    found = views.table(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.concat(F.lit("feed"), (F.col("event_id") % 7).cast("string")).alias("url"), F.col("value").alias("score"), F.when(F.col("event_type") != "view", "rss20").otherwise("atom10").alias("version"))
    return reg.cap_feeds(found, 3).select("source_id", "url")


@query("SELECT min(event_id) AS event_id FROM events GROUP BY user_id, props")
def feed_merge(spark, sf):
    # An entry of several feeds counts where it stands first: by feed, then by place in the feed.
    entries = views.table(spark, sf, "events").select(F.struct("user_id", "props").alias("url"), (F.col("event_id") / 100).cast("int").alias("feed_pos"), F.col("event_id").alias("entry_pos"))
    w = Window.partitionBy("url").orderBy("feed_pos", "entry_pos")
    return entries.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("entry_pos").alias("event_id"))
