"""URL, text and rule-score queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scoring, text, urls
from tidewire.plans.registry import query
from tidewire.sources import views

_PARTS = """parts AS (
  SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS netloc,
         regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
clean AS (
  SELECT *, CASE WHEN p1 = '/' THEN '/' ELSE regexp_replace(p1, '/+$', '') END AS p, list_filter(string_split(q, '&'), lambda x: x <> '') AS pairs
  FROM (SELECT *, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/{2,}', '/', 'g') AS p1 FROM parts))"""
_TRACKING = ", ".join(f"'{t}'" for t in urls.TRACKING_PARAMS)
_PAGING = ", ".join(f"'{t}'" for t in urls.PAGINATION_PARAMS)
_KEPT = f"list_filter(pairs, lambda x: lower(split_part(x, '=', 1)) NOT IN ({_TRACKING}))"
_NORMAL = f"scheme || '://' || netloc || p || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END"
_LISTED = f"list_filter({_KEPT}, lambda x: lower(split_part(x, '=', 1)) NOT IN ({_PAGING}))"


def _pages(spark, sf):
    return views.table(spark, sf, "pages")


def _page_column(spark, sf, name, column):
    return _pages(spark, sf).select("page_id", column.alias(name))


@query(f"WITH {_PARTS} SELECT page_id, {_NORMAL} AS normal FROM clean")
def normalize_url(spark, sf):
    return _page_column(spark, sf, "normal", urls.normalize_url(F.col("url")))


@query(f"WITH {_PARTS} SELECT page_id, regexp_replace({_NORMAL}, '^(https?://)www\\.', '\\1') AS identity FROM clean")
def source_identity(spark, sf):
    return _page_column(spark, sf, "identity", urls.source_identity(F.col("url")))


@query(f"WITH {_PARTS} SELECT page_id, scheme || '://' || netloc || p || CASE WHEN len({_LISTED}) > 0 THEN '?' || array_to_string({_LISTED}, '&') ELSE '' END AS identity FROM clean")
def listing_identity(spark, sf):
    return _page_column(spark, sf, "identity", urls.listing_identity(F.col("url")))


@query(f"WITH {_PARTS} SELECT page_id, len(list_filter(pairs, lambda x: lower(split_part(x, '=', 1)) IN ({_PAGING}))) > 0 AS paged FROM clean")
def is_pagination(spark, sf):
    return _page_column(spark, sf, "paged", urls.is_pagination(F.col("url")))


@query(f"WITH {_PARTS} SELECT page_id, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS depth FROM parts")
def path_depth(spark, sf):
    return _page_column(spark, sf, "depth", urls.path_depth(F.col("url")))


@query(f"WITH {_PARTS}, h AS (SELECT page_id, regexp_replace(netloc, '^www\\.', '') AS h FROM parts) SELECT page_id, h = 'example.com' OR ends_with(h, '.example.com') AS same FROM h")
def host_matches(spark, sf):
    return _page_column(spark, sf, "same", urls.host_matches(F.col("url"), ["Example.com"]))


@query("SELECT page_id, url LIKE '%://%' AS valid FROM pages")
def source_link_valid(spark, sf):
    return _page_column(spark, sf, "valid", urls.source_link_valid(F.col("url")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'https://sozd.duma.gov.ru/bill/' || CAST(o_custkey AS VARCHAR) || '-8' END AS bill_url FROM orders")
def bill_url_valid(spark, sf):
    number = F.col("o_custkey").cast("string")
    given = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("https://sozd.duma.gov.ru/bill/"), number, F.lit("-8/"))).when(
        F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" https://sozd.duma.gov.ru/bill/"), number, F.lit("-8"))
    ).otherwise(F.concat(F.lit("http://sozd.duma.gov.ru.evil.test/bill/"), number, F.lit("-8")))
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), urls.bill_url(given).alias("bill_url"))


_W = r"\p{L}\p{M}\p{N}\p{Pc}\x{200c}\x{200d}"


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[’''-]*[{_W}][{_W}’''-]*')) AS INTEGER) AS words FROM documents")
def word_count(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, nullif(trim(regexp_extract(text, '^\\s*[^.!?\\n]+[.!?]?', 0)), '') AS sentence FROM documents")
def first_sentence(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("SELECT doc_id, list_distinct(regexp_extract_all(text, '#([\\p{L}\\p{N}\\p{M}_]+)', 1)).list_sort() AS tags FROM documents")
def hashtags(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.array_sort(text.hashtags(F.col("text"))).alias("tags"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)', 1), ''), nullif(regexp_extract(html, '<h1>([^<]*)', 1), ''), url) AS title FROM pages")
def title_fallback(spark, sf):
    found = lambda tag: F.regexp_extract("html", f"<{tag}>([^<]*)", 1)
    return _page_column(spark, sf, "title", text.first_filled(found("title"), found("h1"), F.col("url")))


@query("SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 300) AS clean FROM documents")
def clean_text(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text"), 300).alias("clean"))


@query("SELECT event_id, props ->> '$.k' AS k FROM events")
def json_unfence(spark, sf):
    answer = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return views.table(spark, sf, "events").select("event_id", F.get_json_object(text.unfence_json(answer), "$.k").alias("k"))


@query()
def text_diff(spark, sf):
    acts = views.acts(spark, sf).withColumn("version_id", F.col("version_id"))
    after = acts.select("act_id", (F.col("version_id") - 1).alias("version_id"), F.col("text").alias("after"))
    return acts.join(after, ["act_id", "version_id"]).select("act_id", "version_id", text.text_diff(F.col("text"), F.col("after")).alias("diff"))


@query()
def strip_html(spark, sf):
    return _pages(spark, sf).select("page_id", text.strip_html(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)).alias("text"))


def _any(value: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({value}, '{t}')" for t in terms) + ")"


_HINT = "length(trim(regexp_extract(html, '<title>([^<]*)', 1)))"
_DEPTH = "len(list_filter(string_split(path, '/'), lambda x: x <> ''))"
ARTICLE_SQL = f"""scored AS (
  SELECT page_id, least(1.0, greatest(0.0,
      CASE WHEN {_any("lower(path)", scoring.JUNK_TERMS)} THEN -0.45 ELSE 0 END + CASE WHEN {_any("lower(path)", scoring.ARTICLE_PATH_TERMS)} THEN 0.24 ELSE 0 END
    + CASE WHEN regexp_matches(url, '{scoring.DATE_IN_PATH}') THEN 0.22 ELSE 0 END + CASE WHEN regexp_matches(lower(path), '{scoring.NUMERIC_ID}') THEN 0.18 ELSE 0 END
    + CASE WHEN regexp_matches(lower(path), '{scoring.LONG_SLUG}') THEN 0.16 ELSE 0 END + CASE WHEN {_DEPTH} >= 2 THEN 0.08 ELSE 0 END
    + CASE WHEN {_DEPTH} >= 3 THEN 0.05 ELSE 0 END + CASE WHEN {_HINT} >= 20 THEN 0.10 ELSE 0 END + CASE WHEN {_HINT} >= 30 THEN 0.04 ELSE 0 END)) AS score, url, netloc, pairs
  FROM clean)"""


def _article_score():
    return scoring.score(scoring.article_rules(F.col("url"), F.regexp_extract("html", "<title>([^<]*)", 1)))["value"]


@query(f"WITH {_PARTS},\n{ARTICLE_SQL} SELECT page_id, round(score, 6) AS score FROM scored")
def article_score(spark, sf):
    return _page_column(spark, sf, "score", F.round(_article_score(), 6))


@query(f"WITH {_PARTS},\n{ARTICLE_SQL} SELECT page_id FROM scored WHERE score >= 0.18")
def article_like(spark, sf):
    return _pages(spark, sf).where(F.round(_article_score(), 9) >= 0.18).select("page_id")


_TITLE = "lower(url || ' ' || regexp_extract(html, '<title>([^<]*)', 1))"


@query(f"""WITH {_PARTS} SELECT page_id, round(least(1.0, greatest(0.0,
      CASE WHEN {_any(_TITLE, scoring.HUB_TERMS)} THEN 0.55 ELSE 0 END + CASE WHEN {_DEPTH} <= 2 THEN 0.12 ELSE 0 END + CASE WHEN {_any(_TITLE, scoring.JUNK_TERMS)} THEN -0.55 ELSE 0 END
    + CASE WHEN regexp_matches(url, '{scoring.DATE_IN_PATH}') THEN -0.42 ELSE 0 END + CASE WHEN regexp_matches(lower(path), '{scoring.NUMERIC_ID}') THEN -0.30 ELSE 0 END
    + CASE WHEN regexp_matches(lower(path), '{scoring.LONG_SLUG}') AND {_DEPTH} >= 3 THEN -0.24 ELSE 0 END + CASE WHEN {_DEPTH} >= 5 THEN -0.10 ELSE 0 END
    + CASE WHEN len(regexp_extract_all(html, '{scoring.DATE_LIKE}')) >= 3 THEN 0.16 ELSE 0 END)), 6) AS score FROM clean""")
def hub_score(spark, sf):
    rules = scoring.hub_rules(F.col("url"), F.regexp_extract("html", "<title>([^<]*)", 1), F.col("html"))
    return _page_column(spark, sf, "score", F.round(scoring.score(rules)["value"], 6))


@query("""SELECT page_id, least(words, 2500) + 30 * p - 12 * a + 80 AS score FROM (
  SELECT page_id, len(string_split(html, ' ')) AS words, len(regexp_extract_all(html, '<p>')) AS p, len(regexp_extract_all(html, '<a ')) AS a FROM pages)""")
def container_score(spark, sf):
    count = lambda tag: F.size(F.split("html", tag, -1)) - 1
    return _page_column(spark, sf, "score", scoring.container_score(count(" ") + 1, count("<p>"), count("<a "), F.lit(True)))


@query("SELECT page_id, len(regexp_extract_all(html, '[\\p{L}]+')) >= 300 AS enough FROM pages")
def body_requirement(spark, sf):
    return _page_column(spark, sf, "enough", F.size(F.regexp_extract_all("html", F.lit(r"[\p{L}]+"), F.lit(0))) >= 300)
