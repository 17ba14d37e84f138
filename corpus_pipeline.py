"""A training corpus from raw documents: the stages in order, each on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandwork.llm import decontam, mixing, rules, simhash, tokens
from strandwork.llm.store import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return rules.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id."""
    return simhash.one_of_each(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark: the coverage limit is 0, so a hit document goes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.clean_documents(docs, items, window=10, max_coverage=0.0)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document taken twice is two rows."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, repeats=2)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to files and read back: one digest row per document of the mix."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.read_ids(spark, tokens.write_ids(docs, "doc_id", "text", path, end_id=2), digest=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Fingerprints, components and token ids have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", codec="zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
