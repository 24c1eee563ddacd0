"""Reproducible shuffling into shards by a Feistel permutation over global row numbers.

Rows are numbered 0..N-1 in the order of (doc_id, text_crc32, size). A keyed Feistel network over the
smallest even number of bits that holds N permutes the numbers; a value outside 0..N-1 is walked on
along its cycle until it falls inside, so the result is a permutation of 0..N-1. A row's place ``p``
gives shard ``p % shards`` and slot ``p // shards``: both can be computed for any row number, and from
them the row number (:func:`unpermute`). Shard sizes differ by one row at most (law ``rows``).

Numbering is a range sort of (doc_id, size, crc) without the texts, then one count for each partition;
nothing else is gathered.

Defined cases: a null text has size 1 and the crc of an empty text; null ids come first; rows equal in
id, size and crc are interchangeable and each gets its own slot; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import settle

ROUNDS = 6
SEED = 20240229


def _round_keys(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, ROUNDS, dtype=np.uint64)


def _half(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def _mix(x: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) & mask


def _network(x: np.ndarray, keys: np.ndarray, half: int, back: bool) -> np.ndarray:
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> shift, x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ _mix(left, k, mask), left
        else:
            left, right = right, left ^ _mix(right, k, mask)
    return (left << shift) | right


def _walk(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    keys, half = _round_keys(seed), _half(n)
    with np.errstate(over="ignore"):
        out = _network(np.asarray(x, dtype=np.uint64), keys, half, back)
        outside = np.flatnonzero(out >= n)
        while outside.size:
            out[outside] = _network(out[outside], keys, half, back)
            outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def permute(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Where each row number of 0..n-1 goes."""
    return _walk(x, n, seed, False)


def unpermute(p: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The row number that went to each place."""
    return _walk(p, n, seed, True)


def numbered(rows: DataFrame, order: list[str], partitions: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with a global ``row_number`` from 0 in the given order, and their count."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = settle(placed.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, local = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("__part", part.cast("int")).withColumn("__at", local)
    counts = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())  # a row for each partition
    starts = np.cumsum([0, *[c for _, c in counts]])
    first = {p: int(s) for (p, _), s in zip(counts, starts[:-1])}
    if not first:
        return placed.withColumn("row_number", F.col("__at")).drop("__at", "__part"), 0
    offsets = F.broadcast(spark.createDataFrame(list(first.items()), "__p int, __first long"))
    out = placed.join(offsets, F.col("__part") == F.col("__p")).withColumn("row_number", F.col("__first") + F.col("__at"))
    return out.drop("__at", "__part", "__p", "__first"), int(starts[-1])


def assign(rows: DataFrame, shards: int, order: list[str], seed: int = SEED) -> DataFrame:
    """``rows`` with shard (int) and slot (long)."""
    out, n = numbered(rows, order)

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    p = out.withColumn("__place", place("row_number"))
    return p.withColumn("shard", (F.col("__place") % shards).cast("int")).withColumn("slot", F.floor(F.col("__place") / F.lit(shards)).cast("long")).drop("__place", "row_number")


def op7(spark, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    out = assign(rows, 8, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
