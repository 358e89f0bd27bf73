"""Findings of round 3: each test failed before its change."""

from __future__ import annotations

import math
import random
import struct

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import oracle_rows
from tidewire.functions import batches, text
from tidewire.plans.catalog import ORACLES, QUERIES
from tidewire.sources import textindex


def bits(v):
    """Values that differ in the sign of a zero differ here; all NaN are one."""
    return None if v is None else "nan" if math.isnan(v) else struct.pack("d", v)


def test_unit_vectors_are_those_of_the_sql_bit_by_bit(spark, tmp_path, sf):
    rows = [
        (1, [-1e-8, 1.0]), (2, [1e-8, -1.0]), (3, [-0.0, 2.0]), (4, [0.0, 0.0]), (5, [3.0, None, 4.0]), (6, [None]), (7, []), (8, None), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]),
        *((100 + k, [(k + 0.5) / 1e6, 1.0]) for k in range(0, 3000, 7)),
    ]
    folder = f"{tmp_path}/in"
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1).write.parquet(f"file://{tmp_path}/vectors")
    (tmp_path / "in" / "embeddings.parquet").symlink_to(next((tmp_path / "vectors").glob("*.parquet")))
    columns, found = oracle_rows(folder, ORACLES["embedding_normalize"])
    want = {r[columns.index("vec_id")]: r[columns.index("unit")] for r in found}
    got = {r.vec_id: r.unit for r in QUERIES["embedding_normalize"](spark, folder).collect()}
    as_bits = lambda unit: None if unit is None else [bits(x) for x in unit]
    assert {k: as_bits(v) for k, v in got.items()} == {k: as_bits(v) for k, v in want.items()}
    assert math.copysign(1, got[1][0]) == -1 and math.isnan(got[4][0]) and got[5] == [0.6, None, 0.8] and got[7] == []


def test_an_index_reads_its_texts_once_and_keeps_few_postings(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(k):
        seen.add(1)
        return f"Number {k} of the few words that every row holds"

    rows = spark.range(3000).select("id", read("id").alias("text"))
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index", [F.col("text")])
    index.add(rows)
    assert seen.value == 3000  # 6,000 where the texts were sampled for their ranges first
    kept = spark.read.parquet(f"file://{tmp_path}/index/delta=1/postings")
    held = kept.agg(F.sum("n").alias("n"), F.sum(F.size("keys")).alias("keys"), F.count("*").alias("rows")).first()
    assert held.n == held.keys > 100_000 and held.rows < 20_000
    assert sorted(r.key for r in index.keys("number 2999 OF").collect()) == [2999]


def test_postings_are_all_runs_of_all_rows():
    rng = random.Random(4)
    plain = [None if k % 7 == 0 else "".join(rng.choices("abc дж😀\n", k=rng.randrange(9))) for k in range(400)]
    wide = ["".join(chr(c) for c in range(k * 170 + 0xE000, k * 170 + 0xE000 + 172)) for k in range(1000)]  # so many letters that rows are halved
    long = ["xyz" * 400_000, "ab", None, "xy" * 700_000, "abc"]  # more than a chunk
    for kind, texts in (("plain", plain), ("wide", wide), ("long", long)):
        keys = [f"k{k}" for k in range(len(texts))]
        other = [None if t is None else t[:5] for t in texts]
        batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(other, pa.string()), pa.array(texts, pa.string())], ["key", "a", "b"])
        got = [(g, k) for b in textindex._postings([batch]) for g, n, ks in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) for k in ks if n == len(ks)]
        assert sorted(got) == sorted((g, k) for k, t in zip(keys, texts, strict=True) for g in textindex.trigrams(t or "")), kind


def test_texts_that_are_no_utf8_are_found(spark, tmp_path):
    rows = spark.range(60).select("id", F.when(F.col("id") % 9 == 0, F.unhex(F.lit("416263FF44C3")).cast("string")).otherwise(F.lit("nothing")).alias("text"))
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index", [F.col("text")])
    index.add(rows)
    for term in ("aBc", "\ufffdd", "c\ufffdd"):
        want = sorted(r.id for r in rows.where(text.contains_ci(F.col("text"), term)).collect())
        assert sorted(r.id for r in index.prune(rows, term).where(text.contains_ci(F.col("text"), term)).collect()) == want


def largest_batch(spark, folder):
    """Rows of the largest batch that a Python worker gets from one partition of 6,000 rows, and of one with long texts."""
    spark.range(6000, numPartitions=1).select(F.repeat(F.lit("x"), F.when(F.col("id") < 3000, 10).otherwise(40_000)).alias("text"), "id").write.parquet(folder)

    @F.pandas_udf("int")
    def size(values: pd.Series) -> pd.Series:
        return pd.Series([len(values)] * len(values))

    short, long = (spark.read.parquet(folder).where(w).select(size("text").alias("n")).agg(F.max("n")).first()[0] for w in ("id < 3000", "id >= 3000"))
    return short, long


@pytest.fixture
def wide_batches(spark):
    before = {k: spark.conf.get(k) for k in batches.SETTINGS}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["next_page", "html_metadata", "listing_cards", "extract_text", "text_diff", "strip_html", "feed_entries"])
def test_texts_reach_python_in_small_batches(spark, sf, tmp_path, wide_batches, name):
    QUERIES[name](spark, sf)
    short, long = largest_batch(spark, f"file://{tmp_path}/texts")
    assert short <= 1000 and long <= 250
