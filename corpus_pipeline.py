"""A training-corpus pipeline: quality, language, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexipress.llm import bpe, decontaminate, language, quality, simhash
from lexipress.storage import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _spread(docs: DataFrame) -> DataFrame:
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null texts and texts without a word go; null ids, repeated rows and very long texts are judged by their whole texts;
    columns besides those of documents are dropped, whatever their names; an empty table gives an empty table."""
    some = _spread(docs.select(*COLUMNS))
    return quality.select_accepted(some, *quality.fit(some)).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, over half of which are of one learned language.

    Null texts and texts without a letter go; null ids, repeated rows, very long texts, other columns and empty tables as in
    the stage before."""
    some = _spread(docs.select(*COLUMNS))
    return language.select_single(some, language.fit(some)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Shingles of five words, 0.8 alike; null texts count as empty ones, and texts without a word are alike. A document is
    an id with a text: an id that comes with different texts is several documents, each judged by its own text, and of equal
    ones (id and text) the row of least lang, source and n_chars stays. Rows without an id can't be told apart by one and
    stay. Very long texts, other columns and empty tables as in the first stage."""
    docs = docs.select(*COLUMNS)
    kept = settle(simhash.representatives(_spread(docs), width=5, similarity=0.8), "representatives")
    out = docs.withColumn("text_md5", F.unhex(F.md5(F.coalesce("text", F.lit(""))))).join(kept.hint("shuffle_merge"), ["doc_id", "text_md5"], "left_semi")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
        out = out.groupBy("doc_id", "text_md5").agg(F.first("text", ignorenulls=True).alias("text"), F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*")
    return out.select(*COLUMNS).unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none and stay, as do null ids and repeated rows without an item; very long texts are
    searched whole; other columns and empty tables as in the first stage."""
    return decontaminate.select_clean(_spread(docs.select(*COLUMNS)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, as digests: a row for each row.

    Null texts count as empty (no ids), null ids and repeated rows keep their rows, very long texts are encoded whole, other
    columns are dropped, and an empty table gives an empty table."""
    return bpe.bpe_digests(_spread(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]

#: Stages train models and follow links, which SQL can't express; tests hold each against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL}
