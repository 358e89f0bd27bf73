"""The trigram index: the same rows as a scan, and less of the table read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions.text import contains_ci
from tidewire.sources import textindex
from tidewire.sources.textindex import TextIndex

KIND = "id bigint, title string, text string"


def rows_of(n, seed=3):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ГАММА", "дельта", "100%_a\\", "x😀y", "ß", "İ", "\n", "of", "of the"]
    out = [(k, None if k % 11 == 0 else " ".join(rng.choices(words, k=rng.randrange(4))), None if k % 13 == 0 else " ".join(rng.choices(words, k=rng.randrange(30)))) for k in range(n)]
    out[n // 2] = (n // 2, "One needle", "in this haystack")
    return out


def scan(table, term):
    return sorted(r.id for r in table.where(contains_ci(F.col("title"), term) | contains_ci(F.col("text"), term)).collect())


@pytest.fixture
def indexed(spark, tmp_path):
    rows = rows_of(600)
    spark.createDataFrame(rows, KIND).repartitionByRange(6, "id").sortWithinPartitions("id").write.parquet(f"file://{tmp_path}/table")
    index = TextIndex(spark, f"file://{tmp_path}/index", [F.col("title"), F.col("text")])
    table = spark.read.parquet(f"file://{tmp_path}/table")
    index.add(table.where("id < 400"))
    index.add(table.where("id >= 400"))
    return index, table


def test_the_same_rows_as_a_scan(spark, indexed, monkeypatch):
    index, table = indexed
    terms = ["needle", "NEEDLE in", "гамма", "Дельта 100", "100%_A\\", "x😀Y", "😀", "alpha beta", "of the of", "no such text", "a\nb", "\n", "be", "b", "the  ", "ß İ"]
    for share in (2.0, textindex.SCAN_SHARE, 0.0):
        monkeypatch.setattr(textindex, "SCAN_SHARE", share)
        for term in terms:
            assert scan(index.prune(table, term), term) == scan(table, term), (term, share)
    assert scan(table, "needle") == [300]


def test_many_keys_meet_the_table_in_a_join(indexed, monkeypatch):
    index, table = indexed
    monkeypatch.setattr(textindex, "SCAN_SHARE", 2.0)
    monkeypatch.setattr(textindex, "MOST_KEYS", 20)
    assert scan(index.prune(table, "alpha"), "alpha") == scan(table, "alpha")


def rows_scanned(frame):
    """Rows that the scans of the table gave in the last run."""
    frame.collect()
    plan, out = frame._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.startswith("Scan parquet") and "text" in node.output().mkString(","):
            out.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        if name.endswith("QueryStage"):
            walk(node.plan())

    walk(plan)
    return sum(out)


def test_row_groups_are_skipped(spark, tmp_path):
    rows = [(k, "t", f"text number {k} " + "filler " * 20) for k in range(20_000)]
    rows[7777] = (7777, "t", "the only zyzzyva")
    spark.createDataFrame(rows, KIND).coalesce(1).sortWithinPartitions("id").write.option("parquet.block.size", 64 << 10).option("parquet.page.row.count.limit", 500).parquet(f"file://{tmp_path}/table")
    table = spark.read.parquet(f"file://{tmp_path}/table")
    index = TextIndex(spark, f"file://{tmp_path}/index", [F.col("title"), F.col("text")])
    index.add(table)
    whole = table.where(contains_ci(F.col("text"), "zyzzyva"))
    pruned = index.prune(table, "zyzzyva").where(contains_ci(F.col("text"), "zyzzyva"))
    assert [r.id for r in pruned.collect()] == [7777]
    assert rows_scanned(whole) == 20_000 and 0 < rows_scanned(pruned) <= 2_000


def test_ranges_hold_all_keys():
    rng = random.Random(1)
    for n in (1, 5, 63, 64, 65, 500):
        values = sorted(rng.sample(range(10_000), n))
        gaps = textindex._ranges(F.lit(0), values)
        assert str(gaps).count(">=") == min(n, textindex.RANGES)


def test_a_delta_that_died_is_not_read(spark, tmp_path, indexed):
    index, table = indexed
    (tmp_path / "index" / "delta=3" / "postings").mkdir(parents=True)
    assert scan(index.prune(table, "needle"), "needle") == [300]
    extra = spark.createDataFrame([(9000, "late", "needle again")], KIND)
    index.add(extra)
    assert (tmp_path / "index" / "delta=4").exists()
    assert scan(index.prune(table.unionByName(extra), "needle"), "needle") == [300, 9000]
