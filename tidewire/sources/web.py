"""Pages from the web as a Spark data source, with a pluggable fetcher.

The urls to fetch are a table, dealt to lanes: a host has ``at_once`` lanes, and a lane's
urls are fetched one after the other by one task, so no host gets more requests at a
time, while a host with very many urls is still spread over as many tasks. A task
works on its lanes side by side (``threads``) and hands pages on as they come.

A fetcher is named by ``module:function``, which workers import: it takes a url and
the time limit in seconds and returns ``(status, final url, html)``; what it raises
is the page's ``error``. A fetch never fails a job.
"""

from __future__ import annotations

import importlib
import queue
import re
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewire.functions import html, urls
from tidewire.sources.shared import Scratch

FORMAT = "tidewire_pages"
HTTP = "tidewire.sources.web:http_get"
AT_ONCE, THREADS, TIMEOUT, MAX_BYTES = 4, 32, 45.0, 12 << 20
#: Pages that leave a task together.
TOGETHER = 32
PAGES = "url string, status int, final_url string, html string, error string"

Fetched = tuple[int, str, str]


def http_get(url: str, timeout: float) -> Fetched:
    """One GET request over http(s), at most ``MAX_BYTES``; statuses from 400 are errors."""
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError("not an http address")
    asked = urllib.request.Request(url, headers={"User-Agent": "tidewire", "Accept": "text/html,*/*;q=0.5"})
    with urllib.request.urlopen(asked, timeout=timeout) as answer:
        body = answer.read(MAX_BYTES + 1)
        if len(body) > MAX_BYTES:
            raise ValueError("the page is too large")
        return answer.status, answer.url, body.decode(answer.headers.get_content_charset() or "utf-8", "replace")


class UrlFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.fetcher, self.columns = options["path"], options.get("fetcher", HTTP), columns
        self.threads, self.timeout = int(options.get("threads", THREADS)), float(options.get("timeout", TIMEOUT))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.path))

    def partitions(self) -> list[InputPartition]:
        store, at = self._store()
        found = [UrlFile(f.path) for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet") and f.size]
        return found or [UrlFile("")]

    def read(self, partition: UrlFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        module, name = self.fetcher.split(":")
        fetch: Callable[[str, float], Fetched] = getattr(importlib.import_module(module), name)
        lanes: dict[tuple[str, int], list[str]] = {}
        table = pq.read_table(partition.path, filesystem=self._store()[0], partitioning=None)
        for url, host, lane in zip(*(table[c].to_pylist() for c in ("url", "host", "lane")), strict=True):
            lanes.setdefault((host, lane), []).append(url)
        done: queue.Queue[dict] = queue.Queue(4 * TOGETHER)  # a full queue makes the lanes wait

        def work(lane: list[str]) -> None:
            for url in lane:
                try:
                    status, final, page = fetch(url, self.timeout)
                    done.put({"url": url, "status": status, "final_url": final, "html": page, "error": None})
                except Exception as error:  # the border to the web: a page that fails is an answer too
                    done.put({"url": url, "status": getattr(error, "code", None), "final_url": None, "html": None, "error": str(error)[:500] or type(error).__name__})

        kinds = {"url": pa.string(), "status": pa.int32(), "final_url": pa.string(), "html": pa.string(), "error": pa.string()}
        left = sum(map(len, lanes.values()))
        with ThreadPoolExecutor(self.threads) as pool:
            for lane in lanes.values():
                pool.submit(work, lane)
            while left:
                some = [done.get() for _ in range(min(TOGETHER, left))]
                left -= len(some)
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in some], kinds[c]) for c in self.columns], names=self.columns)


class PagesSource(DataSource):
    """Options: ``path`` (what :func:`deal` wrote), ``fetcher``, ``threads`` and ``timeout`` (seconds)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: T.StructType) -> PagesReader:
        return PagesReader(dict(self.options), schema.names)


def lane(url: Column, at_once: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(at_once)).cast("int")


def deal(wanted: DataFrame, scratch: Scratch, at_once: int = AT_ONCE, tasks: int | None = None) -> str:
    """Writes the distinct urls of ``wanted`` (url), a lane in one file; the folder's path."""
    tasks = tasks or int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = wanted.where(F.col("url").isNotNull()).select("url").distinct()
    laned = once.select("url", F.coalesce(urls.netloc(F.col("url")), F.lit("")).alias("host"), lane(F.col("url"), at_once).alias("lane"))
    return scratch.keep(laned.repartition(tasks, "host", "lane"), "urls")._scratch_path


def fetch_pages(wanted: DataFrame, fetcher: str = HTTP, at_once: int = AT_ONCE, threads: int = THREADS, timeout: float = TIMEOUT) -> DataFrame:
    """``url, status, final_url, html, error`` of every distinct url of ``wanted``; html is null where the fetch failed.

    The pages are fetched once and written: what is read later, or again, is one and the same.
    """
    spark: SparkSession = wanted.sparkSession
    scratch = Scratch(spark, "web")
    spark.dataSource.register(PagesSource)
    path = deal(wanted, scratch, at_once)
    reader = spark.read.format(FORMAT).option("path", path).option("fetcher", fetcher).option("threads", threads).option("timeout", timeout)
    return scratch.keep(reader.load(), "pages")


def crawl_step(fetcher: str = HTTP, **how) -> Callable[[DataFrame], DataFrame]:
    """A ``fetch`` step for ``operators.discovery``: adds ``html, title, text, links``; pages that failed are absent."""

    def fetch(wanted: DataFrame) -> DataFrame:
        pages = fetch_pages(wanted, fetcher, **how).where("html IS NOT NULL").select("url", "html", F.coalesce("final_url", "url").alias("__base"))
        read = pages.withColumn("__page", html.crawled_page(F.col("html"), F.col("__base")))
        return wanted.join(read.select("url", "html", "__page.title", "__page.text", "__page.links"), "url")

    return fetch
