"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from longview.session import ship

from . import chat, decontaminate, lm, minhash, oracles, pieces, quality, sharding, suffixes, tokens, warc

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(f: Query) -> Query:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_preference_format": chat.op1,
        "op2_decontaminate": decontaminate.op2,
        "op3_minhash_dedup": minhash.op3,
        "op4_quality_rules": quality.op4,
        "op5_sentencepiece": pieces.op5,
        "op6_token_counts": tokens.op6,
        "op7_sharding": sharding.op7,
        "op8_warc": warc.op8,
        "op9_suffix_array_dedup": suffixes.op9,
        "op10_lm_scoring": lm.op10,
        "pipeline": corpus_pipeline.run,
    }
    return {name: _shipped(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_format": oracles.OP1, "op3_minhash_dedup": oracles.OP3, "op4_quality_rules": oracles.OP4, "op8_warc": oracles.OP8, "op9_suffix_array_dedup": oracles.OP9}
