"""Event dedup: candidate clusters by cosine inside a time window, anchors, alignment, and ordered greedy assignment."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import models
from tidewire.functions.scoring import l2_normalize, normalize_decision, source_score
from tidewire.operators.components import components
from tidewire.sources.shared import Scratch

WINDOW_DAYS, TOP_K, MIN_SCORE, VETO_UNCERTAIN = 3, 6, 0.16, True
#: Stand-in for the pair model: borders of its verdicts on the cosine.
SAME_FROM, DIFFERENT_BELOW = 0.30, 0.25
#: Candidates of one cluster in an alignment call, calls of a task at once, tries and growing waits (seconds).
CALL_CANDIDATES, CALLS_AT_ONCE, CALL_TRIES, CALL_WAIT = 1000, 20, 3, 1.0
#: Items that one fold takes in order; larger components are first settled in parallel rounds, while a round settles a thousandth.
FOLD_ITEMS, LEAST_PROGRESS = 100_000, 1000
#: Rows of either side in one block of cosines.
BLOCK = 2048


def event_time() -> Column:
    return F.coalesce("published_at", "created_at")


def complete(state: DataFrame) -> DataFrame:
    return state.where("summary IS NOT NULL AND primary_event_found IS NOT NULL AND embedding IS NOT NULL")


def ingest_states(news: DataFrame, state: DataFrame) -> DataFrame:
    """``id, has_summary, has_embedding, has_cluster``: where a resumed run goes on."""
    joined = news.select("id").join(state.withColumnRenamed("news_id", "id"), "id", "left")
    return joined.select(
        "id",
        (F.col("summary").isNotNull() & F.col("primary_event_found").isNotNull()).alias("has_summary"),
        F.col("embedding").isNotNull().alias("has_embedding"),
        F.col("event_cluster_id").isNotNull().alias("has_cluster"),
    )


def unembedded(state: DataFrame) -> DataFrame:
    return state.where("event_cluster_id IS NULL AND summary IS NOT NULL AND primary_event_found IS NOT NULL AND embedding IS NULL")


def pending(news: DataFrame, state: DataFrame) -> DataFrame:
    """Items that wait for a cluster, with their event time."""
    return complete(state).where("event_cluster_id IS NULL").withColumnRenamed("news_id", "id").join(news.select("id", "published_at", "created_at"), "id").withColumn("event_time", event_time())


def vectors(news: DataFrame, state: DataFrame) -> DataFrame:
    """``id, event_time, unit vector, cluster`` of every item with an embedding."""
    times = news.select("id", event_time().alias("event_time"))
    known = state.where("embedding IS NOT NULL").select(F.col("news_id").alias("id"), l2_normalize(F.col("embedding")).alias("unit"), "event_cluster_id")
    return known.join(times, "id")


def cluster_scores(queries: DataFrame, pool: DataFrame, window_days: int = WINDOW_DAYS, block: int = BLOCK, top_k: int | None = None, min_score: float = MIN_SCORE, in_order: bool = False) -> DataFrame:
    """``query_id, cluster_id, score``: the best cosine of each query with a cluster's members inside the window.

    ``queries``: id, event_time, unit; ``pool``: also event_cluster_id. With ``top_k`` a
    block returns only a query's best clusters of at least ``min_score``; a cluster
    among a query's best overall is so in the block that holds its best member. With
    ``in_order`` a member without a cluster is seen by later items only. The time
    condition becomes an equality on windows-long buckets (each query meets its own
    and both neighbours). A bucket's rows are dealt to blocks by a hash, the pool's
    to as many as its size asks for, and each pair of blocks is one matrix product
    that returns the best score by query and cluster only: a hot day is many tasks of
    bounded size.
    """
    width = window_days * 86_400
    seconds = F.unix_micros(F.col("event_time").cast("timestamp"))
    bucket = F.floor(F.unix_timestamp(F.col("event_time").cast("timestamp")) / width)
    asked = queries.select("id", seconds.alias("at"), F.col("unit"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"), F.lit(None).cast("bigint").alias("cluster"), F.lit(False).alias("waits"))
    there = pool.select("id", seconds.alias("at"), "unit", bucket.alias("bucket"), F.coalesce("event_cluster_id", "id").cast("bigint").alias("cluster"), F.col("event_cluster_id").isNull().alias("waits"))
    blocks = lambda rows, name: rows.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    grid = blocks(asked, "rows").join(blocks(there, "columns"), "bucket")  # one row per window of time
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = asked.join(grid, "bucket").withColumn("i", own("rows")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    right = there.join(grid, "bucket").withColumn("j", own("columns")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    dealt = ["bucket", "i", "j", "id", "at", "cluster", "waits", "unit"]
    limit = width * 1_000_000

    def best(group: pa.Table) -> pa.Table:
        is_query = np.asarray(group["cluster"].is_null())
        unit = np.asarray(group["unit"].combine_chunks().flatten(), np.float64).reshape(group.num_rows, -1)
        ids, at = group["id"].to_numpy(), group["at"].to_numpy()
        q, p = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        names, cluster = np.unique(group["cluster"].drop_null().to_numpy(), return_inverse=True)
        order = np.argsort(cluster, kind="stable")
        starts = np.searchsorted(cluster[order], np.arange(len(names)))
        p = p[order]
        waits = group["waits"].to_numpy()[p] & in_order
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for from_ in range(0, len(q), 256) if len(p) else ():
            some = q[from_ : from_ + 256]
            score = unit[some] @ unit[p].T
            score[(np.abs(at[some, None] - at[None, p]) > limit) | (ids[some, None] == ids[None, p])] = -np.inf
            if waits.any():
                later = (at[p] > at[some, None]) | ((at[p] == at[some, None]) & (ids[p] > ids[some, None]))
                score[later & waits] = -np.inf
            top = np.maximum.reduceat(score, starts, axis=1)
            if top_k:
                best = np.argsort(-np.round(top, 9), axis=1, kind="stable")[:, :top_k]  # names ascend, so ties go to the smaller
                rows = np.repeat(np.arange(len(some)), best.shape[1])
                columns = best.ravel()
                good = top[rows, columns] >= min_score
                rows, columns = rows[good], columns[good]
            else:
                rows, columns = np.nonzero(np.isfinite(top))
            out.append((ids[some[rows]], names[columns], top[rows, columns]))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "cluster_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    both = left.select(*dealt).unionByName(right.select(*dealt)).withColumn("id", F.col("id").cast("bigint"))
    found = both.groupBy("bucket", "i", "j").applyInArrow(best, "query_id bigint, cluster_id bigint, score double")
    return found.groupBy("query_id", "cluster_id").agg(F.max("score").alias("score"))


def top_clusters(scores: DataFrame, top_k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """Best score per query and cluster, at least ``min_score``, the first ``top_k`` by score (then cluster)."""
    best = scores.groupBy("query_id", "cluster_id").agg(F.max("score").alias("score")).where(F.col("score") >= min_score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "cluster_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top_k)


def cluster_members(news: DataFrame, state: DataFrame) -> DataFrame:
    of_news = news.select(F.col("id").alias("news_id"), event_time().alias("event_time"), "reliability")
    return complete(state).join(of_news, "news_id").withColumn("cluster_id", F.coalesce("event_cluster_id", "news_id"))


def _extremes(members: DataFrame) -> DataFrame:
    row = F.struct("event_time", "news_id", "summary", "primary_event_found")
    return members.groupBy("cluster_id").agg(
        F.min(row).alias("oldest"), F.max(row).alias("newest"), F.count("*").alias("member_count"), F.max(source_score(F.col("reliability"))).alias("source_score")
    )


def cluster_anchors(members: DataFrame) -> DataFrame:
    """The oldest and the newest member of each cluster (one row where they are the same).

    Two ordered windows would say it too; min and max over ``(event_time, id)``
    combine on the map side, so a large cluster is no hot task.
    """
    both = _extremes(members).select("cluster_id", F.explode(F.array_distinct(F.array("oldest", "newest"))).alias("a"))
    return both.select("cluster_id", "a.news_id", "a.event_time", "a.summary", "a.primary_event_found")


def cluster_targets(members: DataFrame) -> DataFrame:
    """What ranking reads of a cluster: anchors' summaries and flags (oldest first), newest time, best source, size."""
    return _extremes(members).select(
        "cluster_id",
        F.transform(F.array_distinct(F.array("oldest", "newest")), lambda a: a["summary"]).alias("summaries"),
        F.transform(F.array_distinct(F.array("oldest", "newest")), lambda a: a["primary_event_found"]).alias("primary_event_flags"),
        F.col("newest.event_time").alias("published_at"),
        "source_score",
        "member_count",
    )


def stand_in_decision(score: Column) -> Column:
    return F.when(score >= SAME_FROM, "SAME").when(score < DIFFERENT_BELOW, "DIFFERENT").otherwise("UNCERTAIN")


def align(candidates: DataFrame, news: DataFrame, state: DataFrame, port: Callable[[list[dict]], list[list[dict]]], call_candidates: int = CALL_CANDIDATES, at_once: int = CALLS_AT_ONCE, tries: int = CALL_TRIES, wait: float = CALL_WAIT) -> DataFrame:
    """``query_id, cluster_id, verdict``: every candidate cluster is asked about once, with its anchors and all its candidates.

    ``port`` gets a list of one precluster (``cluster_id``, ``anchors``: oldest and
    newest member, ``items``: candidates in event order) and returns a list of one
    answer: ``id, decision, hard_conflicts, critical_unknowns`` of its items in any
    order. An item without an answer is uncertain; an unknown one, or an item twice, is
    an error. Calls run side by side, ``at_once`` a task. A cluster with more than
    ``call_candidates`` items is asked in several calls, with the same anchors. A call
    that fails ``tries`` times fails the batch.
    """
    summaries = state.select(F.col("news_id").alias("query_id"), "summary").join(news.select(F.col("id").alias("query_id"), event_time().alias("event_time")), "query_id")
    anchor = F.struct("event_time", "news_id", "summary", "primary_event_found")
    anchors = cluster_anchors(cluster_members(news, state)).groupBy("cluster_id").agg(F.array_sort(F.collect_list(anchor)).alias("anchors"))  # two at most
    share = candidates.groupBy("cluster_id").agg(F.ceil(F.count("*") / call_candidates).alias("calls"))
    asked = candidates.select("query_id", "cluster_id").join(share, "cluster_id").withColumn("call", F.pmod(F.xxhash64("query_id"), F.col("calls")))
    items = F.array_sort(F.collect_list(F.struct("event_time", F.col("query_id").alias("id"), "summary")))
    calls = asked.join(summaries, "query_id").groupBy("cluster_id", "call").agg(items.alias("items")).join(anchors, "cluster_id")

    def ask(preclusters: list[dict]) -> list[list[dict]]:
        answers = port(preclusters)
        for given, got in zip(preclusters, answers, strict=True):
            ids = [a["id"] for a in got]
            if len(set(ids)) < len(ids) or not set(ids) <= {x["id"] for x in given["items"]}:
                raise ValueError(f"an answer on cluster {given['cluster_id']} names an item twice, or one it was not asked about")
        return [[{"hard_conflicts": [], "critical_unknowns": []} | a for a in got] for got in answers]

    kind = "array<struct<id:bigint,decision:string,hard_conflicts:array<string>,critical_unknowns:array<string>>>"
    said = models.answers(calls, ["cluster_id", "anchors", "items"], ask, kind, items=1, tries=tries, wait=wait, at_once=at_once, must=True)
    each = said.select("cluster_id", F.explode("items").alias("item"), "answer")
    own = F.get(F.filter("answer", lambda a: a["id"] == F.col("item.id")), F.lit(0))
    verdict = F.coalesce(normalize_decision(own["decision"], own["hard_conflicts"], own["critical_unknowns"]), F.lit("UNCERTAIN"))
    return each.select(F.col("item.id").alias("query_id"), "cluster_id", F.when(own.isNull(), "UNCERTAIN").otherwise(verdict).alias("verdict"))


def choose_cluster(item: int, candidates: list[tuple[int, str]], veto: bool = VETO_UNCERTAIN) -> int:
    """The cluster of one item by its candidates' verdicts, where several may stand for one cluster."""
    verdicts: dict[int, list[str]] = {}
    for cluster, verdict in candidates:
        verdicts.setdefault(cluster, []).append(verdict)
    same = [c for c, v in verdicts.items() if set(v) == {"SAME"}]
    unsure = any("DIFFERENT" not in v and set(v) != {"SAME"} for v in verdicts.values())
    return same[0] if len(same) == 1 and not (veto and unsure) else item


def chosen_cluster(item: Column, candidates: Column, veto: bool = VETO_UNCERTAIN) -> Column:
    """:func:`choose_cluster` as an expression; ``candidates``: an array of (cluster, verdict, ...)."""
    clusters = F.array_distinct(F.transform(candidates, lambda c: c["cluster"]))
    said = lambda k: F.transform(F.filter(candidates, lambda c: c["cluster"] == k), lambda c: c["verdict"])
    same = F.filter(clusters, lambda k: F.forall(said(k), lambda v: v == "SAME"))
    unsure = F.exists(clusters, lambda k: ~F.array_contains(said(k), "DIFFERENT") & F.exists(said(k), lambda v: v != "SAME"))
    return F.when((F.size(same) == 1) & ~(F.lit(veto) & unsure), F.get(same, F.lit(0))).otherwise(item)


def choose_clusters(plans: list[tuple[int, list[tuple[int, str]]]], veto: bool = VETO_UNCERTAIN) -> dict[int, int]:
    """The cluster of each item, in order; an item's candidates may be items before it."""
    chosen: dict[int, int] = {}
    for item, candidates in plans:
        chosen[item] = choose_cluster(item, [(chosen.get(c, c), v) for c, v in candidates], veto)
    return chosen


def numbered_in_order(items: DataFrame) -> DataFrame:
    """``items`` with ``at``, their place by ``(event_time, id)`` from 0, no time first: places within ranges, and what comes before each range."""
    scratch = Scratch(items.sparkSession, "numbered")
    order = [F.col("event_time").asc_nulls_first(), F.col("id")]
    laid = scratch.keep(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__n", 33)
    before, start = 0, {}
    for r in sorted(laid.groupBy(part.alias("part")).count().collect(), key=lambda r: r.part):  # one row a range
        start[r.part], before = before, before + r["count"]
    first = F.element_at(F.create_map(*(F.lit(x) for pair in start.items() for x in pair)), part) if start else F.lit(0)
    return laid.withColumn("at", (first + F.col("__n").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("__n")


def greedy_candidates(news: DataFrame, state: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """``query_id, cluster_id, score, rank``: each pending item's best clusters, of assigned items and of pending ones before it.

    Items without a primary event ask for none; clusters without a complete member are passed over.
    """
    waiting = pending(news, state)
    unit = l2_normalize(F.col("embedding")).alias("unit")
    asked = waiting.where("primary_event_found").select("id", "event_time", unit)
    assigned = vectors(news, state).where("event_cluster_id IS NOT NULL").select("id", "event_time", "unit", "event_cluster_id")
    pool = assigned.unionByName(waiting.select("id", "event_time", unit, F.col("event_cluster_id")))
    best = top_clusters(cluster_scores(asked, pool, window_days, top_k=TOP_K, in_order=True))
    return best.join(cluster_members(news, state).select("cluster_id").distinct(), "cluster_id", "left_semi")


def greedy_clusters(news: DataFrame, state: DataFrame, port=None, decide=stand_in_decision, veto: bool = VETO_UNCERTAIN, window_days: int = WINDOW_DAYS, fold_items: int = FOLD_ITEMS) -> DataFrame:
    """``id, cluster_id`` of every pending item, as if decided one after the other in event order.

    Candidates and verdicts (by ``port``, see :func:`align`, else ``decide`` of the
    score) come in parallel. An item without a SAME verdict stands for itself whatever
    the others do. The rest depend on each other along their candidates only, so the
    connected components of these links are folded side by side, each in event order.
    A component of more than ``fold_items`` is first settled in rounds, each deciding
    all items whose candidates are decided (equal copies take a few rounds).
    """
    scratch = Scratch(news.sparkSession, "greedy")
    found = scratch.keep(greedy_candidates(news, state, window_days), "candidates")
    verdicts = found.withColumn("verdict", decide(F.col("score"))) if port is None else found.drop("verdict").join(align(found, news, state, port), ["query_id", "cluster_id"])
    verdicts = scratch.keep(verdicts.select("query_id", "cluster_id", "rank", "verdict"), "verdicts")
    unsettled = verdicts.groupBy("query_id").agg(F.bool_or(F.col("verdict") == "SAME").alias("same")).where("same").select(F.col("query_id").alias("id"))
    times = pending(news, state).select("id", F.unix_micros(F.col("event_time").cast("timestamp")).alias("at"))
    items = scratch.keep(times.join(unsettled.withColumn("open", F.lit(True)), "id", "left"), "items")
    open_items = items.where("open").select("id", "at")
    # A candidate that is an open item before this one waits for that item's own choice.
    other = open_items.select(F.col("id").alias("cluster_id"), F.col("at").alias("__at"))
    seen = verdicts.join(open_items, verdicts.query_id == open_items.id).join(other, "cluster_id", "left")
    waits = F.coalesce((F.col("__at") < F.col("at")) | ((F.col("__at") == F.col("at")) & (F.col("cluster_id") < F.col("id"))), F.lit(False))
    candidate = F.struct("rank", F.col("cluster_id").alias("cluster"), "verdict", waits.alias("waits"))
    plan = scratch.keep(seen.groupBy("id", "at").agg(F.array_sort(F.collect_list(candidate)).alias("candidates")), "plan")  # at most TOP_K
    decided = [items.where("open IS NULL").select("id", F.col("id").alias("cluster_id"))]

    for k in range(2):
        links = plan.select(F.col("id").alias("a"), F.explode(F.filter("candidates", lambda c: c["waits"])).alias("c")).select("a", F.col("c.cluster").alias("b"))
        parts = components(links, scratch)
        if k or (parts.groupBy("component").count().agg(F.max("count")).first()[0] or 0) <= fold_items:
            break
        plan, settled = _settle(plan, veto, scratch)
        decided += settled
    return _fold(plan, parts, veto, decided)


def _settle(plan: DataFrame, veto: bool, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Rounds that decide all items with nothing left to wait for, while they get on; the plan of the rest, and the decisions."""
    decided, left = [], plan.count()
    while left:
        ready = plan.where(~F.exists("candidates", lambda c: c["waits"]))
        now = scratch.keep(ready.select("id", chosen_cluster(F.col("id"), F.col("candidates"), veto).alias("cluster_id")), "settled")
        decided.append(now)
        got = now.count()
        if not got:
            break
        known = now.select(F.col("id").alias("__of"), F.col("cluster_id").alias("__now"))
        each = plan.join(now.select("id"), "id", "left_anti").select("id", "at", F.explode("candidates").alias("c"))
        met = each.join(known, F.col("c.waits") & (F.col("c.cluster") == F.col("__of")), "left")
        candidate = F.struct("c.rank", F.coalesce("__now", "c.cluster").alias("cluster"), "c.verdict", (F.col("c.waits") & F.col("__now").isNull()).alias("waits"))
        plan = scratch.keep(met.groupBy("id", "at").agg(F.array_sort(F.collect_list(candidate)).alias("candidates")), "plan")
        left -= got
        if got * LEAST_PROGRESS < left:
            break
    return plan, decided


def _fold(plan: DataFrame, parts: DataFrame, veto: bool, decided: list[DataFrame]) -> DataFrame:
    """The decisions of ``plan``'s items, component by component in event order, after those of ``decided``."""
    used = plan.select("at", F.explode("candidates").alias("c")).where("c.waits").groupBy(F.col("c.cluster").alias("id")).agg(F.max("at").alias("until"))
    of = parts.select(F.col("node").alias("id"), "component")
    rows = plan.join(of, "id", "left").join(used, "id", "left").select(F.coalesce("component", "id").alias("component"), "at", "id", "until", "candidates")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, chosen, ends = None, {}, []
        for batch in batches:
            ids, clusters = [], []
            for r in batch.to_pylist():
                if r["component"] != component:
                    component, chosen, ends = r["component"], {}, []
                while ends and ends[0][0] < r["at"]:  # nothing asks for these any more
                    chosen.pop(heapq.heappop(ends)[1])
                mapped = [(chosen[c["cluster"]] if c["waits"] else c["cluster"], c["verdict"]) for c in r["candidates"]]
                ids.append(r["id"])
                clusters.append(choose_cluster(r["id"], mapped, veto))
                if r["until"] is not None:
                    chosen[r["id"]] = clusters[-1]
                    heapq.heappush(ends, (r["until"], r["id"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(clusters, pa.int64())], names=["id", "cluster_id"])

    out = rows.repartition("component").sortWithinPartitions("component", "at", "id").mapInArrow(fold, "id bigint, cluster_id bigint")
    for more in decided:
        out = out.unionByName(more.select(F.col("id").cast("bigint").alias("id"), F.col("cluster_id").cast("bigint").alias("cluster_id")))
    return out
