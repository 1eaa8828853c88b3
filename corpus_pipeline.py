"""Corpus pipeline: language ID, SimHash near-dedup on word shingles, benchmark decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last one adds the
shard of each row. ``run`` writes each stage's result in the shared folder and reads it back for the next.

* language_id drops documents without a letter, and those whose main language holds under half of their words.
* simhash_dedup keeps, of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, the least doc_id:
  SimHash fingerprints propose what is compared: tables of their bits, all of a bucket bit-sliced; what is near is compared exactly.
* decontaminate drops documents that overlap a benchmark item.
* mix_sources repeats or thins documents by their source's rate; copies keep their doc_id.
* shard adds ``shard`` (0 to 15) and ``slot`` (from 0 in each shard).

A language model of the text decides, so there is no SQL twin; the tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelpie.llm import common, decontamination, language_id, mixing, sharding, shingle_dedup

N_SHARDS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs, (1.0,) * N_SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix),
    ("shard", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir))
    return docs
