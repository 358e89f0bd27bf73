from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_pair_operators import brute_joins
from tests.llm.test_text_operators import DOCS, _levels, odd_rows
from tidewire.llm import lines, quality
from tidewire.llm.queries import tokenizer_path


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, labels=((2, 1, 0), (5, 1, 0))):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "mixing", "bpe"]

    good = stages["quality_classifier"](spark, docs, sf).cache()
    scored = quality.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scored.where("predicted = 1").collect())

    clean = stages["line_dedup"](spark, good, sf).cache()
    assert clean.schema == docs.schema
    want = lines.brute_force([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(map(tuple, lines.digest(lines.dedup_lines(good)).collect())) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    alone = stages["ngram_jaccard_join"](spark, clean, sf).cache()
    assert sorted(r.doc_id for r in alone.collect()) == sorted({c for _, c, _ in brute_joins([(r.doc_id, r.text) for r in clean.collect()])})

    mixed = stages["mixing"](spark, alone, sf)
    assert mixed.columns == [*docs.columns, "train_position", "train_copy"]
    rows = mixed.collect()
    assert [r.train_position for r in rows] == sorted(r.train_position for r in rows)
    plan = taken_by_hand([(r.doc_id, r.text, r.source) for r in alone.collect()])
    assert Counter((r.doc_id, r.train_copy) for r in rows) == Counter(plan)

    coded = stages["bpe"](spark, mixed, sf)
    assert coded.columns == ["doc_id", "train_position", "train_copy", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    own = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in rows:
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, r.train_copy, r.train_position, tuple(ids), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.train_copy, r.train_position, tuple(r.ids), r.decoded_sha256) for r in coded.collect()) == want


def taken_by_hand(rows):
    """(doc_id, copy) of the copies of which the mix takes half of the words or more: streams of words by source, cut at the target."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    sizes = [sum(size[i] for i, _, s in rows if s == name) for name in names]
    targets = _levels(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2)
    out = []
    for k, name in enumerate(names):
        left = math.floor(targets[k] + 0.5)
        for copy in range(2):
            for i in sorted((i for i, _, s in rows if s == name), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
                words = min(size[i], left)
                left -= words
                if words and 2 * words >= size[i]:
                    out.append((i, copy))
    return out


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "train_position", "train_copy", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert got.count() > 0 and all(r.n_tokens == len(r.ids) and 0 <= r.train_position <= 1 for r in got.collect())


def test_odd_rows_and_clashing_columns(spark, folder):
    path = folder(odd_rows())
    assert corpus_pipeline.run(spark, path).count() > 0
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 AS n_lines", "'x' AS size", "2 AS words", "3 AS rank", "4 AS position", "5 AS target", "6 AS id", "7 AS copies")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert [r for r in docs.selectExpr("n_lines", "size", "words", "rank", "position", "target", "id", "copies").distinct().collect()] in ([], [(1, "x", 2, 3, 4, 5, 6, 7)])


def test_no_rows(spark, folder):
    assert corpus_pipeline.run(spark, folder([], labels=())).count() == 0
