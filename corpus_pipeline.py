"""The corpus pipeline: language, toxicity, exact and near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import exact_dedup, language, packing, queries, simhash, toxicity
from tablewright.llm.common import small_batches, table, write


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.keep_identified(docs, queries.language_model(spark, sf_dir))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.keep_civil(docs, queries.toxicity_model(spark, sf_dir))


#: The name of a digest index that outlives the run, for corpora that come in parts; None holds the documents of a
#: run against each other only, in an index that is dropped again.
DIGEST_INDEX: str | None = None


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    index = exact_dedup.DigestIndex(spark, DIGEST_INDEX) if DIGEST_INDEX else None
    return exact_dedup.drop_exact_duplicates(docs, index)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.drop_similar(docs, shingle=5, similarity=0.8)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"))


#: (name, function of spark, the previous stage's documents and the data directory)
STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_duplicates),
    ("simhash", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: Language, toxicity, SimHash and packing have no SQL form; tests/llm/test_similar.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
