"""A corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps with the columns of
``documents``; the last one encodes, decodes what it has encoded, and returns doc_id, ids, n_tokens, the SHA-256 of
the decoded bytes and whether they are the text's. ``run`` writes what a stage returns as
Parquet in the shared folder and reads it back for the next.

Null, empty, long and repeated texts and further columns are treated as each operator says; a document
whose whole text is repeated stays with an empty text; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from longview.llm import decontaminate, minhash, pieces, quality, suffixes
from longview.llm.common import settle
from longview.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep(docs, 5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffixes.keep(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    out = pieces.verified(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", "n_tokens", "decoded_sha256", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("encoding", encoding),
]
#: Connected components, removed byte strings and Viterbi paths are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
