"""The registered queries of this package, with their production parameters, and SQL answers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandwork.llm import decontam, dialogs, lm, mixing, pages, periods, rules, shards, simhash, suffixes, tokens, toxicity, vectors
from strandwork.sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, repeats=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"), shards=40)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = tokens.write_ids(table(spark, sf_dir, "documents"), "doc_id", "text", path, end_id=2)
    return tokens.read_ids(spark, folder, digest=True)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), order=2, folds=5, held=1)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"), length=50)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return toxicity.severity(table(spark, sf_dir, "documents"), labels, grade="toxic", weak=True)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages"))


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(table(spark, sf_dir, "documents"), rewrite=periods.planted)


def op13_dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return dialogs.audited(dialogs.damaged(conversations), conversations)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_tokens": op5_tokens,
    "op6_quality": op6_quality,
    "op7_lm": op7_lm,
    "op8_substrings": op8_substrings,
    "op9_toxicity": op9_toxicity,
    "op10_html": op10_html,
    "op11_vectors": op11_vectors,
    "op12_runs": op12_runs,
    "op13_dialogs": op13_dialogs,
}
