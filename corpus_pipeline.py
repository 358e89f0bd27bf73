"""The corpus pipeline: documents in, token ids out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet to the shared folder and read again as the next stage's
``docs``. All stages but the last return the columns of ``documents``; columns
beyond these are carried along where a stage doesn't replace them. Empty tables,
null texts and ids, very long texts and repeated rows pass through as the
operators' docstrings say:

1. quality classifier: rows predicted 0 go.
2. line dedup: ``text`` loses repeated lines, ``n_chars`` follows.
3. n-gram join: one document of each near-duplicate class stays.
4. mixing: one row per copy that the mix takes, range-sorted by training position
   (``train_position, train_copy``). The copy at the border of a source's target
   stays, whole, if half of its words are taken.
5. BPE: ``doc_id, train_position, train_copy, n_tokens, ids_sha256,
   decoded_sha256, ids``, so every result row says when it is trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, lines, mixing, ngrams, quality
from tidewire.llm._store import materialise, table
from tidewire.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # All other columns travel in one, so none of them meets the operator's own names.
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = lines.dedup_lines(docs.select("doc_id", "text", F.struct(*rest).alias("__row")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return out.select(*((new[c] if c in new else F.col("__row")[c]).alias(c) for c in docs.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngrams.keep_one(docs).select(*docs.columns)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_set(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    order = [c for c in ("train_position", "train_copy") if c in docs.columns]
    return bpe.encode_documents(docs, tokenizer_path(), keep=("doc_id", *order))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mixing_to_weights),
    ("bpe", bpe_encoding),
]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
