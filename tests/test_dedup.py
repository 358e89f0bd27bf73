"""Ordered clustering against a fold over all items, alignment calls, model answers, components."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tidewire.functions import models
from tidewire.operators import dedup
from tidewire.operators.components import components
from tidewire.sources.shared import Scratch

NEWS = "id bigint, published_at timestamp_ntz, created_at timestamp_ntz, reliability string"
STATE = "news_id bigint, summary string, primary_event_found boolean, embedding array<double>, event_cluster_id bigint"
START = datetime(2024, 1, 1)


def sequential(times, x, asks, cluster, complete, veto=True, verdict=None):
    """The rule item by item: candidates are assigned items and pending ones before, within three days, best six clusters by cosine."""
    verdict = verdict or (lambda s, item, c: "SAME" if s >= 0.30 else "DIFFERENT" if s < 0.25 else "UNCERTAIN")
    waits = [k for k in range(len(x)) if cluster[k] is None and complete[k]]
    order = sorted(waits, key=lambda k: (times[k], k))
    known = {k if cluster[k] is None else cluster[k] for k in range(len(x)) if complete[k]}
    chosen = {}
    for n, k in enumerate(order):
        best = {}
        for j in [j for j in range(len(x)) if cluster[j] is not None] + order[:n] if asks[k] else []:
            if j != k and abs((times[j] - times[k]).total_seconds()) <= 3 * 86_400:
                c = j if cluster[j] is None else cluster[j]
                best[c] = max(best.get(c, -2), float(x[j] @ x[k]))
        top = sorted(((c, s) for c, s in best.items() if s >= 0.16), key=lambda p: (-round(p[1], 9), p[0]))[:6]
        said = {}
        for c, s in top:
            if c in known:
                said.setdefault(chosen.get(c, c), []).append(verdict(s, k, c))
        same = [c for c, v in said.items() if set(v) == {"SAME"}]
        unsure = any("DIFFERENT" not in v and set(v) != {"SAME"} for v in said.values())
        chosen[k] = same[0] if len(same) == 1 and not (veto and unsure) else k
    return chosen


def case(seed, n=90, dimensions=30, days=9):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dimensions))
    for k in range(0, n, 9):  # near copies, and a chain that drifts away
        x[k + 1 : k + 6] = x[k] + rng.normal(size=(5, dimensions)) * 0.15
    x[60:80] = np.cumsum(rng.normal(size=(20, dimensions)), axis=0) + 3 * x[60]
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    times = [START + timedelta(days=int(d), hours=int(h)) for d, h in zip(rng.integers(0, days, n), rng.integers(0, 4, n), strict=True)]
    # Clusters are often named by a member that itself waits, earlier or later than those that ask.
    cluster = [int(rng.integers(0, n)) if rng.random() < 0.1 else None for _ in range(n)]
    asks, complete = rng.random(n) < 0.9, rng.random(n) < 0.95
    return times, x, asks, cluster, complete


def frames(spark, times, x, asks, cluster, complete):
    news = spark.createDataFrame([(k, t if k % 4 else None, t, "high") for k, t in enumerate(times)], NEWS)
    state = spark.createDataFrame([(k, f"s{k}" if complete[k] else None, bool(asks[k]), x[k].tolist(), cluster[k]) for k in range(len(x))], STATE)
    return news, state


@pytest.mark.parametrize(("seed", "fold_items", "days"), [(1, dedup.FOLD_ITEMS, 9), (2, dedup.FOLD_ITEMS, 1), (3, 0, 2)])
def test_greedy_equals_the_sequential_fold(spark, seed, fold_items, days):
    of = case(seed, days=days)
    want = sequential(*of)
    got = {r.id: r.cluster_id for r in dedup.greedy_clusters(*frames(spark, *of), fold_items=fold_items).collect()}
    assert got == want
    assert any(k != c for k, c in got.items())


def test_equal_items_are_one_cluster(spark):
    n = 250
    of = ([START] * n, np.tile([1.0, 0.0], (n, 1)), [True] * n, [None] * n, [True] * n)
    for fold_items in (dedup.FOLD_ITEMS, 10):
        got = dedup.greedy_clusters(*frames(spark, *of), fold_items=fold_items).collect()
        assert {r.id for r in got} == set(range(n)) and {r.cluster_id for r in got} == {0}


def test_nothing_pending(spark):
    news, state = frames(spark, [START], np.ones((1, 2)), [True], [7], [True])
    assert dedup.greedy_clusters(news, state).collect() == []
    assert dedup.greedy_clusters(news.limit(0), state.limit(0)).collect() == []


def test_the_expression_and_the_function_choose_alike(spark):
    rng = random.Random(5)
    rows = [(k, [(rng.randrange(3), rng.choice(["SAME", "SAME", "UNCERTAIN", "DIFFERENT"])) for _ in range(rng.randrange(7))]) for k in range(10, 300)]
    frame = spark.createDataFrame(rows, "id bigint, c array<struct<cluster:bigint,verdict:string>>")
    for veto in (True, False):
        got = frame.select("id", dedup.chosen_cluster(F.col("id"), F.col("c"), veto).alias("to")).collect()
        assert {r.id: r.to for r in got} == {k: dedup.choose_cluster(k, c, veto) for k, c in rows}


def test_a_port_is_asked_once_a_cluster(spark, tmp_path):
    """The calls are told by files, as they happen in other processes."""
    of = case(6, days=3)
    news, state = frames(spark, *of)
    folder = str(tmp_path)

    def port(preclusters):
        (asked,) = preclusters
        with open(f"{folder}/{asked['cluster_id']}", "a") as f:
            f.write(" ".join(str(i["id"]) for i in asked["items"]) + "\n")
        assert 1 <= len(asked["anchors"]) <= 2 and all(a["summary"] for a in asked["anchors"])
        said = []
        for i in reversed(asked["items"]):
            if i["id"] % 5:
                said.append({"id": i["id"], "decision": "SAME", "hard_conflicts": ["date"] if i["id"] % 7 == 0 else [], "critical_unknowns": ["place"] if i["id"] % 11 == 0 else []})
        return [said]

    def verdict(score, item, cluster):
        return "UNCERTAIN" if item % 5 == 0 else "DIFFERENT" if item % 7 == 0 else "UNCERTAIN" if item % 11 == 0 else "SAME"

    got = {r.id: r.cluster_id for r in dedup.greedy_clusters(news, state, port).collect()}
    assert got == sequential(*of, verdict=verdict)
    candidates = {}
    for r in dedup.greedy_candidates(news, state).collect():
        candidates.setdefault(r.cluster_id, set()).add(r.query_id)
    for cluster, items in candidates.items():
        (line,) = (tmp_path / str(cluster)).read_text().splitlines()
        assert set(map(int, line.split())) == items
        assert [*map(int, line.split())] == sorted(items, key=lambda k: (of[0][k], k))
    assert {p.name for p in tmp_path.iterdir()} == set(map(str, candidates))


def test_a_port_that_answers_for_others_is_an_error(spark):
    news, state = frames(spark, [START] * 3, np.ones((3, 2)) / np.sqrt(2), [True] * 3, [0, None, None], [True] * 3)
    for answer in ([[{"id": 99, "decision": "SAME"}]], [], [[{"id": 1, "decision": "SAME"}] * 2]):
        with pytest.raises(PythonException):
            dedup.align(dedup.greedy_candidates(news, state), news, state, lambda p, answer=answer: answer, tries=1).collect()


def test_large_clusters_are_asked_in_parts(spark):
    news, state = frames(spark, [START] * 40, np.ones((40, 2)) / np.sqrt(2), [True] * 40, [0] + [None] * 39, [True] * 40)
    got = dedup.align(dedup.greedy_candidates(news, state), news, state, lambda p: [[{"id": i["id"], "decision": "SAME"} for i in x["items"]] for x in p], call_candidates=4).collect()
    assert {r.verdict for r in got} == {"SAME"} and len(got) == dedup.greedy_candidates(news, state).count()


# Answers of models.


def test_answers_come_in_any_order(spark):
    rows = spark.range(25).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))

    def call(some):
        from tidewire.functions.models import Indexed

        return [Indexed((k, {"n": x["id"] * 2, "said": x["text"]})) for k, x in reversed([*enumerate(some)])]

    got = models.answers(rows, ["id", "text"], call, "n bigint, said string", items=4, at_once=3).collect()
    assert {(r.id, r.answer.n, r.answer.said, r.failed, r.attempts) for r in got} == {(k, 2 * k, f"t{k}", False, 1) for k in range(25)}


def test_answers_that_fail_are_repeated_then_marked(spark, tmp_path):
    folder = str(tmp_path)

    def call(some):
        import os

        path = f"{folder}/{some[0]['id']}"
        n = os.path.getsize(path) if os.path.exists(path) else 0
        with open(path, "a") as f:
            f.write("x")
        if some[0]["id"] == 1 or n < 2:
            raise ConnectionError
        return [x["id"] for x in some]

    got = {r.id: r for r in models.answers(spark.range(3).coalesce(1), ["id"], call, "bigint", items=1, tries=3, wait=0.01).collect()}
    assert [(got[k].answer, got[k].failed, got[k].attempts) for k in range(3)] == [(0, False, 3), (None, True, 3), (2, False, 3)]
    with pytest.raises(PythonException):
        models.answers(spark.range(1), ["id"], lambda some: [], "bigint").collect()
    with pytest.raises(PythonException):
        models.answers(spark.range(1), ["id"], lambda some: 1 / 0, "bigint", must=True).collect()


def test_ordered_answers():
    one = models.Indexed
    assert models.ordered([one((1, "b")), one((0, "a"))], 2) == ["a", "b"] and models.ordered(["a", one((None, "b"))], 2) == ["a", "b"]
    for wrong in ([one((0, "a"))] * 2, [one((2, "a")), one((0, "b"))], ["a"]):
        with pytest.raises(ValueError):
            models.ordered(wrong, 2)


def test_embeddings_are_placed_by_their_index(spark):
    embed = models.embedding_function(lambda texts: [(k, [float(len(t)), 0.0]) for k, t in reversed([*enumerate(texts)])], dimensions=2, items=3)
    texts = spark.createDataFrame([("a" * k,) for k in range(1, 9)], "t string")
    assert {tuple(r.v) for r in texts.select(embed(F.col("t")).alias("v")).collect()} == {(1.0, 0.0)}


# Components.


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1120)] + [(5000, k) for k in range(6000, 6300)]
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([*edges, (7, 7), (None, 3)], "a bigint, b bigint")
    got = components(frame, Scratch(spark, "test"))
    assert {r.node: r.component for r in got.collect()} == {v: root(v) for v in list(parent)}
    assert components(frame.limit(0), Scratch(spark, "test")).count() == 0
