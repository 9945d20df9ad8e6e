"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexipress.llm import bpe, decontaminate, html_text, language, license_scan, lm_score, quality, resample, simhash, token_counts, token_files, topk, whitening
from lexipress.llm.tables import spread, table
from lexipress.storage import fresh_path


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.corpus_token_offsets(docs, fresh_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return resample.resample(docs, table(spark, sf_dir, "benchmark").select("text"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op11_importance_resampling": op11_importance_resampling,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_counts": op13_token_counts,
    "op4_lm_score": op4_lm_score,
    "op6_html_main_text": op6_html_main_text,
    "op2_exact_topk": op2_exact_topk,
    "op5_license_scan": op5_license_scan,
    "op3_language_id": op3_language_id,
    "op9_quality_classifier": op9_quality_classifier,
    "op1_decontaminate": op1_decontaminate,
    "op7_token_files": op7_token_files,
    "op8_simhash_near_dup": op8_simhash_near_dup,
    "op10_bpe_merge_replay": op10_bpe_merge_replay,
}

SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_exact_topk": topk.SQL,
    "op5_license_scan": license_scan.oracle(),
    "op11_importance_resampling": resample.SQL,
}
