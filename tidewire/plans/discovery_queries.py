"""Site discovery, listing traversal and first cards over a site graph laid over the pages of each host."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import discovery as op
from tidewire.plans.registry import query
from tidewire.sources import views

#: Bounds that the hosts of the test tables reach.
PAGES, CALLS, DEPTH, LISTING_PAGES, CARDS = 12, 9, 3, 4, 12
NOW = "TIMESTAMP_NTZ'2024-01-03 00:00:00'"


def _sites(spark, sf):
    """Every host's pages by number: page 0 is the home page; every eleventh page can't be fetched."""
    pages = views.table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://"), F.regexp_extract("url", r"^https?://([^/]+)", 1)).alias("site"))
    numbered = pages.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("page_id")) - 1)
    return numbered.withColumn("url", F.when(F.col("n") == 0, F.col("site")).otherwise(F.concat("site", F.lit("/c"), F.col("n").cast("string"))))


_SITES = """s AS (SELECT page_id, 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) AS site FROM pages),
p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS n FROM s),
name AS (SELECT *, CASE WHEN n = 0 THEN site ELSE site || '/c' || n END AS url FROM p)"""


def _linked(pages):
    """Page n links to its parent, the next page and three children; also to a second page, another host and an article."""
    to = lambda n: F.concat("site", F.lit("/c"), n.cast("string"))
    n = F.col("n")
    parent = F.floor((n - 1) / 3)
    links = [F.when(parent < 1, F.col("site")).otherwise(to(parent)), to(n + 1), to(3 * n + 1), F.concat(to(3 * n + 2), F.lit("?utm_source=x#top")), to(3 * n + 3), F.concat(to(3 * n + 1), F.lit("?page=2")), F.lit("https://elsewhere.example.test/c1"), F.concat("site", F.lit("/news/2024/01/02/a-long-headline-of-the-day-12345"))]
    return pages.withColumn("links", F.array(*(F.struct(x.alias("url"), F.lit("more").alias("label")) for x in links)))


def discovered(spark, sf):
    pages = _linked(_sites(spark, sf))
    there = pages.where("page_id % 11 <> 0").select("site", "url", "page_id", "links", F.lit("t").alias("title"), F.lit("").alias("text"))

    def classify(got):
        verdict = F.struct((F.col("page_id") % 3 == 0).alias("is_listing"), (F.col("page_id") % 4 != 0).alias("may_contain_listings"), F.when(F.col("page_id") % 5 != 0, 0.8).otherwise(0.5).alias("confidence"))
        return got.withColumn("verdict", F.when(F.col("page_id") % 7 != 0, verdict)).withColumn("next_page", F.lit(None).cast("string"))

    seeds = pages.where("n = 0").select("site", F.lit("home").alias("name"))
    return op.discover(seeds, lambda wanted: wanted.join(there, ["site", "url"]), classify, DEPTH, PAGES, CALLS)


def _level(d: int) -> str:
    """One step in SQL: links of the pages to follow, new ones within the pages left, fetched, judged within the calls left."""
    seen = " UNION ALL ".join(f"SELECT site, n FROM taken{k}" for k in range(d))
    spent = " UNION ALL ".join(f"SELECT site FROM judged{k}" for k in range(1, d)) or "SELECT site FROM p WHERE false"
    return f"""link{d} AS (SELECT site, unnest([{{'n': greatest(0, (n - 1) // 3), 'k': 0}}, {{'n': n + 1, 'k': 1}}, {{'n': 3 * n + 1, 'k': 2}}, {{'n': 3 * n + 2, 'k': 3}}, {{'n': 3 * n + 3, 'k': 4}}]) AS l, pos FROM follow{d - 1}),
seen{d} AS ({seen}),
new{d} AS (SELECT site, l.n AS n, min(list_append(pos, l.k)) AS pos FROM link{d} WHERE (site, l.n) NOT IN (SELECT (site, n) FROM seen{d}) GROUP BY ALL),
taken{d} AS (
  SELECT site, n, pos FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pos) AS r FROM new{d}) x
  WHERE r + (SELECT count(*) FROM seen{d} y WHERE y.site = x.site) <= {PAGES}),
spent{d} AS ({spent}),
got{d} AS (SELECT t.*, p.page_id, row_number() OVER (PARTITION BY t.site ORDER BY pos) AS r FROM taken{d} t JOIN p USING (site, n) WHERE page_id % 11 <> 0),
judged{d} AS (SELECT * FROM got{d} x WHERE r + (SELECT count(*) FROM spent{d} y WHERE y.site = x.site) <= {CALLS}),
follow{d} AS (SELECT site, n, pos FROM judged{d} WHERE page_id % 7 = 0 OR (page_id % 3 <> 0 AND page_id % 4 <> 0))"""


_LISTINGS = " UNION ALL ".join(f"SELECT site, n, {d} AS depth FROM judged{d} WHERE page_id % 7 <> 0 AND page_id % 3 = 0 AND page_id % 5 <> 0" for d in range(1, DEPTH + 1))


@query(f"""WITH {_SITES},
taken0 AS (SELECT site, n FROM p WHERE n = 0), follow0 AS (SELECT site, n, [0] AS pos FROM p WHERE n = 0 AND page_id % 11 <> 0),
{", ".join(_level(d) for d in range(1, DEPTH + 1))},
hubs AS ({_LISTINGS})
SELECT site, CASE WHEN n = 0 THEN site || '/' ELSE site || '/c' || n END AS url, 'listing' AS origin, depth FROM hubs
UNION ALL SELECT site, site, 'seed', 0 FROM taken0 WHERE site NOT IN (SELECT site FROM hubs)""")
def hub_discovery(spark, sf):
    return discovered(spark, sf).select("site", "url", "origin", "depth")


def _listing_pages(spark, sf):
    """A page's cards overlap with those of the next; some cards are old, some are the hub itself; some pages lead back or nowhere."""
    n, page = F.col("n"), F.col("page_id")
    fresh = F.expr(f"{NOW} - (page_id % 30) * INTERVAL '1' HOUR").cast("timestamp")
    old = F.expr(f"{NOW} - INTERVAL '40' DAY").cast("timestamp")

    def card(k):
        url = F.when((page % 17 == 0) & (F.lit(k) == 0), F.concat("site", F.lit("?page=3"))).otherwise(F.concat("site", F.lit("/a"), (2 * n + k).cast("string")))
        at = F.when((page % 13 == 12) & (F.lit(k) == 1), old).when((page + k) % 5 == 0, F.lit(None).cast("timestamp")).otherwise(fresh)
        return F.struct(url.alias("url"), F.lit("t").alias("title"), at.alias("published_at"))

    ahead = F.concat("site", F.lit("/c"), (n + 1).cast("string"))
    back = F.when(n <= 1, F.col("site")).otherwise(F.concat("site", F.lit("/c"), (n - 1).cast("string")))
    then = F.when(page % 9 == 4, F.lit(None)).when((page % 5 == 0) & (n > 0), back).otherwise(ahead)
    return _sites(spark, sf).where("page_id % 11 <> 0").select("site", "url", F.array(*(card(k) for k in range(3))).alias("cards"), then.alias("next"))


def traversed(spark, sf):
    pages = _listing_pages(spark, sf)
    hubs = _sites(spark, sf).where("n = 0").select("site", F.lit(1).alias("rank"), F.col("site").alias("url"), F.lit(None).cast("string").alias("next_page"))
    return op.traverse(hubs, lambda at: at.join(pages, ["site", "url"]), F.expr(NOW), LISTING_PAGES)


_WALK = f"""{_SITES},
step AS (SELECT *, page_id % 11 <> 0 AS there, page_id % 13 = 12 AS old, CASE WHEN page_id % 9 = 4 THEN NULL WHEN page_id % 5 = 0 AND n > 0 THEN n - 1 ELSE n + 1 END AS nxt FROM p),
walk AS (
  SELECT site, 1 AS page, 0::BIGINT AS n, []::BIGINT[] AS met FROM p WHERE n = 0
  UNION ALL
  SELECT w.site, w.page + 1, s.nxt, list_append(w.met, w.n) FROM walk w JOIN step s ON s.site = w.site AND s.n = w.n
  WHERE s.there AND NOT s.old AND s.nxt IS NOT NULL AND w.page < {LISTING_PAGES} AND NOT list_contains(list_append(w.met, w.n), s.nxt)),
visit AS (SELECT w.site, w.page, w.met, w.n AS n, s.page_id, coalesce(s.there, false) AS there, s.old, s.nxt FROM walk w LEFT JOIN step s ON s.site = w.site AND s.n = w.n)"""


@query(f"""WITH RECURSIVE {_WALK},
last AS (SELECT * FROM visit QUALIFY row_number() OVER (PARTITION BY site ORDER BY page DESC) = 1)
SELECT site, site AS hub, CASE WHEN there THEN page ELSE page - 1 END AS pages,
  CASE WHEN NOT there THEN 'missing' WHEN old THEN 'old' WHEN nxt IS NULL THEN 'end' WHEN list_contains(list_append(met, n), nxt) THEN 'seen' ELSE 'cap' END AS reason FROM last""")
def listing_stops(spark, sf):
    return traversed(spark, sf)[1]


_CARDS = f"""{_WALK},
card AS (
  SELECT site, page, page_id, k AS pos, CASE WHEN page_id % 17 = 0 AND k = 0 THEN NULL ELSE site || '/a' || (2 * n + k) END AS url,
         CASE WHEN (page_id + k) % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-03' - to_hours(page_id % 30) END AS published_at
  FROM visit, (VALUES (0), (1), (2)) k(k) WHERE there AND NOT (old AND k >= 1))"""


@query(f"WITH RECURSIVE {_CARDS} SELECT site, site AS hub, page, pos, url, published_at FROM card WHERE url IS NOT NULL")
def listing_traversal(spark, sf):
    return traversed(spark, sf)[0].select("site", "hub", "page", "pos", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query(f"""WITH RECURSIVE {_CARDS}, once AS (SELECT * FROM card WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY page, pos) = 1)
SELECT site, page, pos, url FROM once QUALIFY row_number() OVER (PARTITION BY site ORDER BY page, pos) <= {CARDS}""")
def site_cards(spark, sf):
    return op.first_cards(traversed(spark, sf)[0], CARDS).select("site", "page", "pos", "url")
