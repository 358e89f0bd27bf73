"""Page fetches through the data source: a fake fetcher, and a server on this machine."""

from __future__ import annotations

import fcntl
import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidewire.operators import discovery
from tidewire.sources import web
from tidewire.sources.shared import Scratch

FAKE = "tests.test_web:fake"


def fake(url: str, timeout: float):
    """Pages of any host; those with "gone" fail. Hosts write down what they get, in a folder named in the url."""
    if "gone" in url:
        raise TimeoutError
    host, _, folder = url.removeprefix("https://").partition("/log")
    if folder:
        folder = folder.split("?")[0]
        path = f"{folder}/{host}"
        with open(path, "a") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.write("+")
        time.sleep(0.05)
        with open(path, "a") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.write("-")
    return 200, url, f"<title>{url}</title>"


def table(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_failures_are_null(spark):
    urls = [f"https://h{k % 3}.test/{'gone' if k % 4 == 0 else 'p'}{k}" for k in range(40)]
    got = web.fetch_pages(table(spark, [*urls, urls[1], None, "no address"]), FAKE).collect()
    assert sorted(r.url for r in got) == sorted({*urls, "no address"})
    for r in got:
        lost = "gone" in r.url
        assert (r.html is None, r.status, r.error) == ((True, None, "TimeoutError") if lost else (False, 200, None))
    assert web.fetch_pages(table(spark, []), FAKE).collect() == []


@pytest.mark.parametrize("at_once", [1, 3])
def test_a_host_gets_no_more_than_its_requests_at_once(spark, tmp_path, at_once):
    urls = [f"https://h{k % 2}.test/log{tmp_path}?{k}" for k in range(30)]
    assert web.fetch_pages(table(spark, urls), FAKE, at_once=at_once).where("html IS NOT NULL").count() == 30
    for host in ("h0.test", "h1.test"):
        now, most = 0, 0
        for c in (tmp_path / host).read_text():
            now += 1 if c == "+" else -1
            most = max(most, now)
        assert most <= at_once and (at_once == 1 or most > 1)


def test_a_large_host_is_dealt_to_several_files(spark):
    path = web.deal(table(spark, [f"https://one.test/{k}" for k in range(400)]), Scratch(spark, "test"), at_once=4, tasks=8)
    laid = spark.read.parquet(path).withColumn("file", F.input_file_name())
    assert laid.select("lane", "file").distinct().groupBy("lane").count().where("count > 1").count() == 0
    assert laid.select("file").distinct().count() > 1


class Site(http.server.BaseHTTPRequestHandler):
    pages = {
        "/": '<title>Home</title><a href="/news">News of the day</a><a href="/lost">Lost</a><a href="https://b.test/">away</a>',
        "/news": '<title>All news</title><a href="/news/2024/01/02/a-long-headline-of-the-day-12345">A long headline of the day</a>',
    }

    def do_GET(self):  # noqa: N802
        page = self.pages.get(self.path)
        self.send_response(200 if page else 404)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write((page or "").encode())

    def log_message(self, *_):
        pass


def test_discovery_over_http(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    home = f"http://127.0.0.1:{server.server_port}"
    try:
        got = {r.url.removeprefix(home): r for r in web.fetch_pages(table(spark, [f"{home}/", f"{home}/lost", "ftp://x.test/"])).collect()}
        assert got["/"].status == 200 and "Home" in got["/"].html
        assert got["/lost"].status == 404 and got["/lost"].html is None and got["ftp://x.test/"].error == "not an http address"

        def classify(pages):
            verdict = F.struct(F.col("url").endswith("/news").alias("is_listing"), F.lit(False).alias("may_contain_listings"), F.lit(0.9).alias("confidence"))
            return pages.withColumn("verdict", verdict).withColumn("next_page", F.lit(None).cast("string"))

        sites = spark.createDataFrame([(f"{home}/", "site")], "site string, name string")
        found = discovery.discover(sites, web.crawl_step(), classify).collect()
        assert [(r.url, r.origin, r.depth, r.title) for r in found] == [(f"{home}/news", "listing", 1, "All news")]
    finally:
        server.shutdown()
