"""The opN queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, collocations, html, lines, mixing, ngrams, outliers, quality, records, spans, urls, vectors, whitening
from tidewire.llm._store import materialise, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.reject_outliers(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.filter_pages(table(spark, sf_dir, "pages"), rules)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["end"])), ";")
    return found.select("doc_id", "n_sentences", "n_removed", removed.alias("removed"), "text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialise(mixing.sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "tie"), "mix-sizes")
    placed = mixing.with_positions(mixing.mix(sizes))
    return placed.select("doc_id", "size", "source_size", "target", "taken", *(F.round(f"position_{k}", 9).alias(f"position_{k}") for k in (1, 2)))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.col("n_chars"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return found.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_ngram_jaccard_join, op2_bpe, op3_quality_classifier, op4_quality_rules, op5_embedding_near_dedup,
        op6_line_dedup, op7_url_filters, op8_substring_dedup, op9_mixing, op10_html_extraction,
        op11_collocations, op12_whitening, op13_records, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngrams.ORACLE,
        "op4_quality_rules": outliers.ORACLE,
        "op5_embedding_near_dedup": vectors.ORACLE,
        "op6_line_dedup": lines.ORACLE,
        "op7_url_filters": urls.ORACLE,
        "op8_substring_dedup": spans.ORACLE,
        "op9_mixing": mixing.ORACLE,
        "op11_collocations": collocations.ORACLE,
    }
