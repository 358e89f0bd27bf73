"""The crawl loops on sites made by hand; the queries' SQL covers the rest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewire.operators import discovery
from tidewire.plans.catalog import QUERIES

SITE = "https://a.test"
PAGE = "site string, url string, title string, text string, links array<struct<url:string,label:string>>, listing boolean, leads boolean, confidence double"


def site(spark, pages, name="seed"):
    """``pages``: path -> (links, listing, leads, confidence); listing None: the verdict fails."""
    rows = [(SITE, SITE + p, p or "home", "", [(x if "://" in x else SITE + x, "go") for x in links], *said) for p, (links, *said) in pages.items()]
    return spark.createDataFrame([(SITE, name)], "site string, name string"), spark.createDataFrame(rows, PAGE)


def run(spark, pages, **how):
    asked = []
    seeds, there = site(spark, pages)

    def fetch(wanted):
        asked.append(sorted(r.url for r in wanted.collect()))
        return wanted.join(there, ["site", "url"])

    def classify(got):
        verdict = F.struct(F.col("listing").alias("is_listing"), F.col("leads").alias("may_contain_listings"), "confidence")
        return got.withColumn("verdict", F.when(F.col("listing").isNotNull(), verdict)).withColumn("next_page", F.lit(None).cast("string"))

    found = discovery.discover(seeds, fetch, classify, **how)
    return [(r.url.removeprefix(SITE), r.origin, r.depth) for r in found.orderBy("rank").collect()], [[u.removeprefix(SITE) for u in step] for step in asked]


TREE = {
    "": (["/one", "/two", "/one?page=3", "/three", "https://b.test/x"], True, False, 0.9),
    "/one": (["/four", "/two"], False, True, 0.9),
    "/two": (["/five"], False, False, 0.9),
    "/three": (["/six", "/four"], None, None, None),
    "/four": (["/seven"], True, True, 0.9),
    "/six": (["/eight"], True, False, 0.5),
    "/seven": ([], True, False, 0.9),
}


def test_only_undecided_pages_are_followed(spark):
    found, asked = run(spark, TREE)
    assert found == [("/four", "listing", 2)]  # the home page isn't judged; /six is not sure enough; /five and /seven are not reached
    assert asked == [[""], ["/one", "/three", "/two"], ["/four", "/six"]]


def test_depth_pages_and_calls_are_bounded(spark):
    assert run(spark, TREE, max_depth=0) == ([("/", "listing", 0)], [[""]])
    assert run(spark, TREE, max_depth=1) == ([("", "seed", 0)], [[""], ["/one", "/three", "/two"]])
    assert run(spark, TREE, max_pages=3) == ([("", "seed", 0)], [[""], ["/one", "/two"], []])
    found, asked = run(spark, TREE, max_calls=1)
    assert asked == [[""], ["/one", "/three", "/two"], ["/four"]] and found == [("", "seed", 0)]  # /one took the only call


def test_no_limits_and_best_hubs(spark):
    pages = {"": (["/news", "/other"], False, False, 0.9), "/news": ([], True, False, 0.9), "/other": ([], True, False, 0.9)}
    assert run(spark, pages, max_pages=0, max_calls=0)[0] == [("/news", "listing", 1), ("/other", "listing", 1)]
    assert run(spark, pages, max_hubs=1)[0] == [("/news", "listing", 1)]
    assert run(spark, {"/gone": ([], True, False, 0.9)})[0] == [("", "seed", 0)]  # the home page can't be fetched


def test_queries_reach_every_stop_and_depth(spark):
    sf = "/root/testdata/sf0.01"
    assert {r.reason for r in QUERIES["listing_stops"](spark, sf).collect()} == {"old", "seen", "cap", "missing", "end"}
    assert {(r.origin, r.depth) for r in QUERIES["hub_discovery"](spark, sf).collect()} >= {("seed", 0), ("listing", 1), ("listing", 2)}


def test_the_hint_serves_the_first_step_only(spark):
    day = datetime(2024, 1, 2)
    pages = {"": ("/p2", ["/a"]), "/hinted": (None, ["/b", "/a"]), "/p2": ("", ["/c"])}
    kind = "site string, url string, next string, cards array<struct<url:string,title:string,published_at:timestamp_ntz>>"
    there = spark.createDataFrame([(SITE, SITE + u, then and SITE + then, [(SITE + c, "t", day) for c in cards]) for u, (then, cards) in pages.items()], kind)
    hubs = spark.createDataFrame([(SITE, 1, SITE, SITE + "/hinted"), (SITE, 2, SITE + "/p2", None)], "site string, rank int, url string, next_page string")
    cards, stops = discovery.traverse(hubs, lambda at: at.join(there, ["site", "url"]), F.lit(datetime(2024, 1, 3)))
    assert {(r.hub, r.pages, r.reason) for r in stops.collect()} == {(SITE, 2, "end"), (SITE + "/p2", 1, "end")}
    assert [(r.url.removeprefix(SITE), r.rank, r.page, r.pos) for r in discovery.first_cards(cards, 2).orderBy("rank", "page", "pos").collect()] == [("/a", 1, 1, 0), ("/b", 1, 2, 0)]
    none, stopped = discovery.traverse(hubs.limit(0), lambda at: at.join(there, ["site", "url"]), F.lit(datetime(2024, 1, 3)))
    assert none.count() == stopped.count() == discovery.first_cards(none).count() == 0
