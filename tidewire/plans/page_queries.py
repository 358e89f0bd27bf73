"""Page reading, feeds, channels, bus and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import dates, html, scoring
from tidewire.operators.crawl import CARD_SCORE
from tidewire.plans.registry import query
from tidewire.sources import bus, feeds, views


def _pages(spark, sf):
    return views.table(spark, sf, "pages")


def _with(spark, sf, before: str, piece):
    """Pages with a piece of markup put before their first ``before``."""
    return _pages(spark, sf).withColumn("html", F.replace("html", F.lit(before), F.concat(F.coalesce(piece, F.lit("")), F.lit(before))))


def _text(*parts) -> F.Column:
    return F.concat(*(F.col("page_id").cast("string") if p == "id" else F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0") if p == "day" else F.lit(p) for p in parts))


@query("""SELECT page_id, 'Headline ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'Told in ' || page_id END AS description, 'A. Writer, B. Editor' AS author, 'Section ' || page_id % 7 AS section,
regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language, 'https://img.test/' || page_id AS image_url, 'https://c.test/' || page_id AS canonical_url, 'NewsArticle' AS schema_type FROM pages""")
def html_metadata(spark, sf):
    tags = _text('<meta property="og:title" content="Headline ', "id", '"><link rel="canonical" href="https://c.test/', "id", '">')
    described = F.when(F.col("page_id") % 2 == 0, _text('<meta name="description" content=" Told in ', "id", '">')).otherwise(F.lit('<meta name="description" content="">'))
    work = F.concat(
        _text('<script type="application/ld+json">[{"@graph": [{"@type": "Person", "name": "x"}, {"@type": ["Thing", "NewsArticle"], "headline": "Other", "image": [{"url": "https://img.test/', "id", '"}], '),
        F.lit('"author": [{"name": "A. Writer"}, "B. Editor"], "articleSection": "Section '), (F.col("page_id") % 7).cast("string"), F.lit('"}]}]</script>'),
    )
    said = _with(spark, sf, "</head>", F.concat(tags, described, work)).select("page_id", html.html_metadata(F.col("html")).alias("m"))
    names = ("title", "description", "author", "section", "language", "image_url", "canonical_url", "schema_type")
    return said.select("page_id", *(F.try_element_at("m", F.lit(n)).alias(n) for n in names))


@query("""SELECT page_id, CASE page_id % 6 WHEN 4 THEN (page_id % 28 + 1) || ' мая 2024' WHEN 5 THEN NULL ELSE '2024-05-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS value,
['json_ld', 'open_graph', 'meta', 'time_element', 'visible_dom', NULL][page_id % 6 + 1] AS source, [0.99, 0.98, 0.93, 0.88, 0.94, 0.0][page_id % 6 + 1]::DOUBLE AS confidence FROM pages""")
def date_cascade(spark, sf):
    pieces = [
        _text('<script type="application/ld+json">{"@type": "Article", "datePublished": "2024-05-', "day", '"}</script><meta property="article:published_time" content="2020-01-01">'),
        _text('<meta property="article:published_time" content="2024-05-', "day", '"><meta name="pubdate" content="2020-01-01">'),
        _text('<meta itemprop="datePublished" content="2024-05-', "day", '"><time datetime="2020-01-01">x</time>'),
        _text("<time>no date</time><time datetime='2024-05-", "day", "'>x</time>"),
        F.concat(F.lit("<article><header><h1>T</h1><span class='date'>"), (F.col("page_id") % 28 + 1).cast("string"), F.lit(" мая 2024</span></header></article><div class='related'><span class='date'>1 мая 2020</span></div>")),
    ]
    chosen = F.coalesce(*(F.when(F.col("page_id") % 6 == k, piece) for k, piece in enumerate(pieces)))
    found = _with(spark, sf, "<nav>", chosen).select("page_id", html.publication_date(F.col("html")).alias("d"))
    return found.select("page_id", "d.value", "d.source", "d.confidence")


@query()
def article_body(spark, sf):
    with_best = _pages(spark, sf).select("page_id", "html", html.text_container(F.col("html")).alias("c"))
    return with_best.select("page_id", "c.selector", html.article_body(F.col("html"), F.col("c.selector"), F.lit("")).alias("body"))


@query()
def extract_text(spark, sf):
    return _pages(spark, sf).select("page_id", html.extract_article(F.col("html")).alias("a")).select("page_id", "a.title", "a.text", "a.published")


_HOST = "lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1))"


@query(f"""SELECT page_id, 0 AS pos, {_HOST} || '/news/' || page_id AS url, 'A long enough headline ' || page_id AS title, make_timestamp(2024, 3, page_id % 28 + 1, 7, 5, 0) AS published_at FROM pages
UNION ALL SELECT page_id, 1, {_HOST} || '/x/promo-2024', 'A headline that is long enough for a card ' || page_id, CASE WHEN page_id % 2 = 0 THEN make_timestamp(2024, 5, 3, 21, 0, 0) ELSE make_timestamp(2024, 3, page_id % 28 + 1, 7, 5, 0) END FROM pages
UNION ALL SELECT page_id, 2, 'https://other.test/article/' || page_id, 'The second one, told in brief', NULL FROM pages""")
def listing_cards(spark, sf):
    """A url met again, a url whose first label scores too low, labels too short, dates near, in a time element, and too far."""
    time = F.when(F.col("page_id") % 2 == 0, F.lit('<time datetime="2024-05-04">may</time>')).otherwise(F.lit(""))
    cards = F.concat(
        _text('<div><a href="/x/promo-2024">Short label here</a></div><div><a href="/news/', "id", '/">A long enough headline ', "id", "</a><span>", "day", '.03.2024 10:05</span></div><div><p><a href="/news/', "id", '">The same url once more</a></p></div><div><a href="#x">short</a></div>'),
        F.concat(F.lit("<div>"), time), _text('<a href="/x/promo-2024">A headline that is long enough for a card ', "id", "</a></div>"),
        _text('<section><div><div><div><div><div><div><a href="https://Other.test/article/', "id", '?utm_source=x">The second one, told in brief</a></div></div></div></div></div></div></section>'),
    )
    found = _with(spark, sf, "<nav>", cards).select("page_id", F.posexplode(html.listing_cards(F.col("html"), F.col("url"), CARD_SCORE)).alias("pos", "c"))
    return found.select("page_id", "pos", "c.url", "c.title", F.col("c.published_at").cast("timestamp_ntz").alias("published_at"))


@query(f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN {_HOST} || '/list?page=2' WHEN 1 THEN {_HOST} || '/archive?page=3' END AS next FROM pages")
def next_page(spark, sf):
    piece = F.when(F.col("page_id") % 3 == 0, F.lit('<a href="/list?page=9">9</a><a rel="nofollow next" href="/list/?page=2&amp;utm_medium=y">more</a>')).when(
        F.col("page_id") % 3 == 1, F.lit('<a rel="next" href="mailto:x@y.test">x</a><a href="/archive/?page=3"> Далее </a>')
    )
    return _with(spark, sf, "<nav>", piece).select("page_id", html.next_listing_page(F.col("html"), F.col("url")).alias("next"))


@query()
def listing_snapshot(spark, sf):
    shot = _pages(spark, sf).select("page_id", html.listing_snapshot(F.col("html"), F.col("url")).alias("s"))
    return shot.select("page_id", "s.title", "s.h1", F.length("s.page_text").alias("text_chars"), F.size("s.cards").alias("cards"), F.try_element_at("s.pagination", F.lit(1))["url"].alias("first_page"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'no bill card' WHEN 3 THEN 'no dated stage' END AS error, CASE WHEN page_id % 4 IN (1, 2) THEN page_id || '-8' END AS bill_number,
CASE WHEN page_id % 4 IN (1, 2) THEN 'On matter ' || page_id || ' (in part)' END AS title, CASE page_id % 4 WHEN 1 THEN 'First reading' WHEN 2 THEN 'Published' END AS stage,
CASE page_id % 4 WHEN 1 THEN 'arrh_d4' WHEN 2 THEN 'arrh_d11' END AS stage_code, CASE page_id % 4 WHEN 1 THEN 'https://bills.test/download/1' WHEN 2 THEN 'https://bills.test/download/2' END AS document_url,
CASE page_id % 4 WHEN 1 THEN make_timestamp(2024, 2, page_id % 28 + 1, 9, 0, 0) WHEN 2 THEN make_timestamp(2024, 5, page_id % 28 + 1, 20, 59, 59) END AS updated_at,
CASE page_id % 4 WHEN 2 THEN make_timestamp(2024, 5, page_id % 28 + 1, 20, 59, 59) END AS published_at FROM pages""")
def bill_page(spark, sf):
    def stage(code: str, name: str, event) -> F.Column:
        return F.concat(F.lit(f'<div class="root-stage" id="{code}"><div class="ttl"><a class="lnk">{name}</a></div>'), event, F.lit("</div>"))

    def event(date, text: str, link: str) -> F.Column:
        return F.concat(F.lit('<div class="oz_event" data-eventdate="'), date, F.lit(f'"><a class="a_event_files" href="{link}">{text}<i class="format-pdf"></i></a></div>'))

    first = stage("arrh_d4", "First reading", event(_text("2024-02-", "day", "T12:00:00"), "Текст внесенного законопроекта", "/download/1"))
    last = stage("arrh_d11", "Published", event(_text("2024-05-", "day", "T23:59:59+03:00"), "Текст федерального закона", "/download/2"))
    bare = F.lit('<div class="root-stage" id="arrh_d1"><div class="ttl"><a class="lnk">None</a></div></div>')
    kind = F.col("page_id") % 4
    stages = F.when(kind == 1, first).when(kind == 2, F.concat(first, last)).otherwise(bare)
    head = _text('<span id="number_oz_id">№ ', "id", '-8</span><div id="oz_name">On matter ', "id", '</div><div id="oz_name_comment">(in part)</div><div id="bh_histras"><div id="oz_stages">')
    page = F.when(kind != 0, F.concat(head, stages, F.lit("</div></div>"))).otherwise(F.col("html"))
    read = _pages(spark, sf).select("page_id", html.bill_page(page, F.lit("https://bills.test/bill/1")).alias("b"))
    moments = (F.col(f"b.{c}").cast("timestamp_ntz").alias(c) for c in ("updated_at", "published_at"))
    return read.select("page_id", "b.error", "b.bill_number", "b.title", "b.stage", "b.stage_code", "b.document_url", *moments)


@query("SELECT o_orderkey AS id, o_orderdate AS parsed FROM orders")
def parse_date(spark, sf):
    orders = views.table(spark, sf, "orders")
    printed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy HH:mm:ss"))
    return orders.select(F.col("o_orderkey").alias("id"), dates.parse_date(printed, "UTC").cast("timestamp_ntz").alias("parsed"))


@query("SELECT doc_id AS source_id, 'https://x.test/' || CAST(doc_id AS VARCHAR) AS url, 'T ' || lang AS title FROM documents")
def feed_entries(spark, sf):
    body = F.concat(
        F.lit("<rss><channel><item><title>&lt;b&gt;T&lt;/b&gt; "), "lang", F.lit("</title><link>https://x.test/"), F.col("doc_id").cast("string"),
        F.lit("</link><category>a</category><category>a</category></item><item><title>no link</title></item></channel></rss>"),
    )
    return feeds.feed_entries(views.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), body.alias("body"))).select("source_id", "url", "title")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'https://t.me/ch' || CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR)
ELSE 'https://t.me/c/' || CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR) END AS url, event_type AS title FROM events""")
def channel_project(spark, sf):
    events = views.table(spark, sf, "events")
    messages = events.select(
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("ch"), F.col("user_id").cast("string"))).alias("channel"), F.concat(F.lit("-100"), F.col("user_id").cast("string")).alias("channel_id"),
        F.col("event_id").alias("message_id"), F.lit("").alias("caption"), F.concat("event_type", F.lit("\nmore")).alias("text"), F.col("ts").alias("date"), F.lit(None).cast("timestamp").alias("edit_date"),
    )
    return feeds.channel_messages(messages).select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("event_id"), "url", "title")


@query("SELECT event_id, 'news.raw.' || event_type AS routing_key, '{\"event_id\":' || CAST(event_id AS VARCHAR) || ',\"user_id\":' || CAST(user_id AS VARCHAR) || ',\"event_type\":\"' || event_type || '\"}' AS body FROM events")
def wire_json(spark, sf):
    sent = bus.wire(views.table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_type")
    return sent.select(F.get_json_object("body", "$.event_id").cast("bigint").alias("event_id"), "routing_key", "body")


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, event_id % 10 <> 0 AS valid FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 10 = 0")
def parse_reject(spark, sf):
    body = F.when(F.col("event_id") % 20 == 0, F.lit("{broken")).when(F.col("event_id") % 10 == 0, F.lit("{}")).otherwise(F.col("props"))
    messages = views.table(spark, sf, "events").select("event_id", body.alias("body"))
    valid, dead = bus.parse(messages, T.StructType([T.StructField("k", T.LongType())]), ["k"])
    return valid.select("event_id", "k", F.lit(True).alias("valid")).unionByName(dead.select("event_id", F.lit(None).cast("bigint").alias("k"), F.lit(False).alias("valid")))


@query()
def micro_batches(spark, sf):
    return bus.micro_batches(views.table(spark, sf, "events"), "user_id", "ts", "event_id", seconds=86_400)
