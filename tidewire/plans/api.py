"""The facade: what the reference's routes and commands answer, as functions that return frames.

A :class:`NewsDesk` works on any frames with the columns of ``tidewire.sources.views``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.operators import acts, dedup, merge, ranking
from tidewire.operators import feed as feeds
from tidewire.operators import registry as sources
from tidewire.sources import views


@dataclass(frozen=True)
class NewsDesk:
    news: DataFrame
    state: DataFrame
    ranked: DataFrame

    @classmethod
    def over_test_tables(cls, spark: SparkSession, sf_dir: str) -> NewsDesk:
        return cls(views.news(spark, sf_dir), views.event_state(spark, sf_dir), views.ranking(spark, sf_dir))

    def list_news(self, q: str | None = None, since: str | None = None, visibility: str = feeds.VISIBLE, is_alert: bool | None = None) -> DataFrame:
        return feeds.feed(self.news, self.state, self.ranked, feeds.FeedQuery(q, since, visibility, is_alert))

    def get_news(self, news_id: int) -> DataFrame:
        """One item whatever the feed shows of it; an unknown id is an error."""
        return _one(self.news, news_id, "news item")

    def escalate(self, news_id: int, register) -> DataFrame:
        """The news with the item flagged, once ``register(item)`` has made an act of it; an error there leaves all as it was."""
        item = self.get_news(news_id)
        if item.first().is_alert:
            raise ConflictError(f"news item {news_id} is an act already")
        register(item)
        return self.news.withColumn("is_alert", F.col("is_alert") | (F.col("id") == news_id))

    def dismiss(self, ids: DataFrame, now: str) -> DataFrame:
        return merge.dismiss(self.news, ids, F.lit(now).cast("timestamp_ntz"))

    def restore(self, ids: DataFrame) -> DataFrame:
        return merge.restore(self.news, ids)

    def cards(self) -> DataFrame:
        """All items as readers get them."""
        return feeds.news_out(self.news, self.state, self.ranked)

    def progress(self) -> DataFrame:
        return ranking.progress(self.news, self.state, self.ranked)

    def assign_pending(self, **how) -> DataFrame:
        return dedup.greedy_clusters(self.news, self.state, **how)

    def reports(self) -> dict[str, DataFrame]:
        return {
            "alerts": ranking.alerts_report(self.news),
            "clusters with more than one member": ranking.multi_member(self.ranked, self.news),
            "ranking by category": ranking.by_category(self.ranked),
            "top relevance": ranking.top_relevance(self.ranked, self.news),
        }


class NotFoundError(LookupError):
    """No row has this id."""


class ConflictError(ValueError):
    """There is such a row already."""


def _one(table: DataFrame, key: int, what: str) -> DataFrame:
    found = table.where(F.col("id") == key).limit(1)
    if found.isEmpty():
        raise NotFoundError(f"{what} {key} not found")
    return found


@dataclass(frozen=True)
class SourceDesk:
    """Sources and their feeds. What changes a table answers with the tables' next states."""

    sources: DataFrame
    feeds: DataFrame

    def list(self) -> DataFrame:
        return sources.with_feeds(self.sources, self.feeds)

    def get(self, source_id: int) -> DataFrame:
        return _one(self.list(), source_id, "source")

    def create(self, new: DataFrame) -> SourceDesk:
        """``new``: rows of ``sources`` with ``has_feed``; an address that is no source link, or is known already, is refused."""
        bad = new.where(~F.coalesce(urls.source_link_valid(F.col("link")), F.lit(False)))
        if not bad.isEmpty():
            raise ValueError(f"not a source's address: {bad.first().link}")
        known = self.sources.select(urls.source_identity(F.col("link")).alias("__identity"))
        asked = new.withColumn("__identity", urls.source_identity(F.col("link")))
        twice = asked.groupBy("__identity").count().where("count > 1").select("__identity")
        clash = asked.join(known.unionByName(twice), "__identity", "left_semi")
        if not clash.isEmpty():
            raise ConflictError(f"there is a source for {clash.first().link}")
        typed = asked.withColumn("type", sources.source_type(F.col("link"), F.coalesce("has_feed", F.lit(False))))
        seconds = F.when(F.col("type") != "telegram", F.coalesce(F.nullif("poll_interval_seconds", F.lit(0)), F.lit(sources.POLL_SECONDS)))
        return replace(self, sources=self.sources.unionByName(typed.withColumn("poll_interval_seconds", seconds).select(*self.sources.columns)))

    def update(self, source_id: int, fields: dict[str, str | None], found_feeds: list[str] | None = None) -> SourceDesk:
        """Only the fields that were sent change, and what a new address implies.

        ``found_feeds``: the feeds that a finder saw at a new address, best first. A new
        address (by identity) must be a source's and no other source's; type, interval,
        feeds and relevance follow it unless they were sent. A source that was found not
        relevant can't be on.
        """
        strange = set(fields) - {"name", "link", "poll_interval_seconds", "is_enabled", "reliability"}
        if strange:
            raise ValueError(f"can't be set: {', '.join(sorted(strange))}")
        spark, row = self.sources.sparkSession, _one(self.sources, source_id, "source").first()
        after, after_feeds, relevant, enabled = self.sources, self.feeds, row.is_relevant, row.is_enabled
        if fields.get("link") is not None:
            link = spark.createDataFrame([(source_id, fields["link"], bool(found_feeds))], "id bigint, new_link string, has_feed boolean")
            asked = link.select(urls.source_link_valid(F.col("new_link")).alias("valid"), urls.source_identity(F.col("new_link")).alias("identity"), urls.source_identity(F.lit(row.link)).alias("own")).first()
            if not asked.valid:
                raise ValueError(f"not a source's address: {fields['link']}")
            if asked.identity != asked.own:
                others = self.sources.where((F.col("id") != source_id) & (urls.source_identity(F.col("link")) == asked.identity))
                if not others.isEmpty():
                    raise ConflictError(f"there is a source for {fields['link']}")
                after = sources.update_addresses(self.sources, link).select(*self.sources.columns)
                moved = after.where(F.col("id") == source_id).first()
                relevant, enabled = moved.is_relevant, moved.is_enabled
                kept = list(dict.fromkeys(found_feeds or []))[: sources.FEEDS_MAX] if moved.type == "rss" else []
                first = (self.feeds.agg(F.max("id")).first()[0] or 0) + 1
                rows = spark.createDataFrame([(first + k, source_id, u) for k, u in enumerate(kept)], "id bigint, source_id bigint, url string")
                gone = self.feeds.where(F.col("source_id") != source_id)
                after_feeds = gone.unionByName(rows.select(*(F.col(c).cast(t) for c, t in self.feeds.select("id", "source_id", "url").dtypes)), allowMissingColumns=True)
        if "is_enabled" in fields:
            enabled = fields["is_enabled"] == "true"
        if enabled and not relevant:
            raise ConflictError(f"source {source_id} was found not relevant")
        sent = spark.createDataFrame([(source_id, fields)], "id bigint, fields map<string,string>")
        return SourceDesk(merge.patch(after, sent, "id"), after_feeds)

    def delete(self, source_id: int, news: DataFrame) -> tuple[SourceDesk, DataFrame]:
        """Without the source, its feeds and its news."""
        gone = _one(self.sources, source_id, "source").select("id")
        left = merge.cascade_delete(self.sources, gone, [("feeds", self.feeds, "source_id", ""), ("news", news, "source_id", "")], "id")
        return SourceDesk(left[""], left["feeds"]), left["news"]


@dataclass(frozen=True)
class ActDesk:
    """Legislative acts: ``registry`` has the current rows, ``versions`` what they were."""

    registry: DataFrame
    versions: DataFrame

    def list(self, limit: int = acts.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
        return acts.page(self.registry, limit, offset)

    def get(self, act_id: int) -> DataFrame:
        """The act with its versions, latest first."""
        own = acts.versions(self.versions, act_id)
        history = F.sort_array(F.collect_list(F.struct("source_updated_at", "version_id", *(c for c in own.columns if c not in ("source_updated_at", "version_id", "act_id")))), asc=False)
        found = own.groupBy("act_id").agg(history.alias("versions")).withColumnRenamed("act_id", "id")
        return _one(self.registry, act_id, "act").join(found, "id", "left")

    def register(self, snapshots: DataFrame) -> DataFrame:
        """New acts with their status; a bill that is known is a conflict, another address is refused."""
        bad = snapshots.where(urls.bill_url(F.col("url")).isNull())
        if not bad.isEmpty():
            raise ValueError(f"not a bill's address: {bad.first().url}")
        named = snapshots.withColumn("url", urls.bill_url(F.col("url")))
        clash = named.join(self.registry.select("url"), "url", "left_semi")
        if not clash.isEmpty():
            raise ConflictError(f"there is an act for {clash.first().url}")
        return acts.register(self.registry, named)


def seed(table: DataFrame, rows: list[tuple]) -> DataFrame:
    """``table`` with seed rows (in its column order) that it lacks by id."""
    given = table.sparkSession.createDataFrame(rows, table.schema)
    return table.unionByName(given.join(table.select("id"), "id", "left_anti").select(*table.columns))


def dump(news: DataFrame, folder: str) -> None:
    """All news as JSON lines, newest first."""
    news.orderBy(F.desc_nulls_last("published_at"), F.desc("created_at"), "id").write.mode("overwrite").json(folder)


def load(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(folder)
