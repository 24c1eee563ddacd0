"""Relational helpers: joins where null matches null, unions of differing tables, first rows, row numbers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

#: Rows of a long series that one task gets; each block also has the rows around it that lags and leads reach.
BLOCK_ROWS = 250_000


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", broadcast: bool = False) -> DataFrame:
    """Join on equal keys, where null equals null; the keys come from ``left``. Other columns must differ."""
    r = right.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on] or [F.lit(True)]
    out = left.join(F.broadcast(r) if broadcast else r, reduce(Column.__and__, same), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{c}" for c in on])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, by column name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key (of the table, without keys) in the given order."""
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def number_rows(df: DataFrame, order: Sequence[str], name: str, groups: Sequence[str] = ()) -> DataFrame:
    """Number rows from 1 in the order of ``order`` (in each group by itself), without one task holding them all.

    Rows are range-partitioned and sorted by (groups, order) and written to the shared folder; then each
    partition's rows are counted and the counts before it are added to the positions inside it. A group with
    most of the rows is spread like any other. Runs two jobs. Rows with equal keys keep one order, but which
    one is open; nulls come first.
    """
    tag = F.monotonically_increasing_id()
    part = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("__tag", tag)
    part = settle(part, "numbered")
    counts = sorted((r["p"], r["n"]) for r in part.groupBy(F.shiftright("__tag", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:  # one pair for each partition
        offsets.append((p, total))
        total += n
    spark = df.sparkSession
    before = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "__p long, __before long"))
    out = part.withColumn("__p", F.shiftright("__tag", 33).cast("long")).join(before, "__p")
    out = out.withColumn(name, F.col("__before") + F.col("__tag").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__p", "__tag", "__before")
    if groups:
        first = out.groupBy(*groups).agg((F.min(name) - 1).alias("__first"))
        out = null_safe_join(out, first, list(groups), "inner").withColumn(name, F.col(name) - F.col("__first")).drop("__first")
    return out


def halo_blocks(df: DataFrame, order: Sequence[str], groups: Sequence[str], reach: int, ahead: int, row: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Window]:
    """Deal rows to blocks of their series so that lags up to ``reach`` and leads up to ``ahead`` stay inside one.

    Gives the rows, numbered in ``row`` (used as it is if a single series has it), and the window to use.
    Rows repeated for a neighbouring block have false in ``__own`` and are to be left out afterwards.
    """
    size = max(block_rows, reach, ahead, 1)
    rows = df if row in df.columns and not groups else number_rows(df, order, row, groups)
    at = F.floor((F.col(row) - 1) / size)
    within = (F.col(row) - 1) - at * size
    blocks = [F.struct(at.alias("b"), F.lit(True).alias("own"))]
    if reach:
        blocks.append(F.when(within >= size - reach, F.struct((at + 1).alias("b"), F.lit(False).alias("own"))))
    if ahead:
        blocks.append(F.when(within < ahead, F.struct((at - 1).alias("b"), F.lit(False).alias("own"))))
    rows = rows.withColumn("__at", F.explode(F.array_compact(F.array(*blocks)))).withColumns({"__block": F.col("__at.b"), "__own": F.col("__at.own")}).drop("__at")
    return rows, Window.partitionBy(*groups, "__block").orderBy(row)


def has_long_series(df: DataFrame, groups: Sequence[str], block_rows: int = BLOCK_ROWS) -> bool:
    """Whether a series has more than four blocks of rows, by a count that is combined before its shuffle."""
    most = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > 4 * block_rows


def in_series(df: DataFrame, order: str, groups: Sequence[str], columns: Callable[[Window], dict[str, Column]], reach: int = 1, ahead: int = 1) -> DataFrame:
    """Add window columns over each series in its order; series that are the whole table, or long, are dealt to blocks."""
    if groups and not has_long_series(df, groups):
        return df.withColumns(columns(Window.partitionBy(*groups).orderBy(order)))
    rows, w = halo_blocks(df, [order], list(groups), reach, ahead, "__row")
    return rows.withColumns(columns(w)).filter("__own").drop("__own", "__block", "__row")
