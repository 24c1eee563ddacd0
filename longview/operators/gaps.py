"""Completing series onto their date grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.spec import SeriesSpec
from .relational import null_safe_join


def fill_gaps(df: DataFrame, spec: SeriesSpec, strict: bool = False) -> DataFrame:
    """One row for each step of the frequency, from a series' first date to the last date of all series.

    Added rows have null outcomes and features; static features of all rows take the series' value at
    its latest date (null if it is null there). Columns keep their order. A null date, and a static
    feature without groups, are errors. Rows off the grid are dropped and repeated dates stay repeated,
    unless ``strict``, which makes both an error (and runs a job). An empty table stays empty.
    Null groups are a series like any other.

    The dates are checked in the plan: the bounds are two small aggregates, the grid is made by
    ``sequence`` on each group's bounds, and the join is by (group, date), which spreads a large group.
    """
    spec.check(df)
    if not spec.date:
        raise ValueError("filling gaps needs a date column")
    d, groups = spec.date, list(spec.groups)
    kind = df.schema[d].dataType
    dated = df.withColumn(d, F.when(F.col(d).isNull(), F.raise_error(F.lit(f"null dates in column {d}"))).otherwise(F.col(d)).cast(kind))
    last = df.agg(F.max(d).alias("__stop"))
    latest = [F.max_by(F.struct(F.col(c)), F.col(d)).getField(c).alias(c) for c in spec.static]
    bounds = df.groupBy(*groups).agg(F.min(d).alias("__start"), *latest)
    grid = bounds.crossJoin(F.broadcast(last)).select(*groups, *spec.static, F.explode(spec.step.grid(F.col("__start"), F.col("__stop"))).alias(d))
    values = dated.drop(*spec.static)
    if strict:
        _strict(df, grid, groups, d)
    return null_safe_join(grid, values, [d, *groups]).select(*df.columns)


def _strict(df: DataFrame, grid: DataFrame, groups: list[str], d: str) -> None:
    keys = [*groups, d]
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if twice:
        raise ValueError("some series have several rows for a date")
    if null_safe_join(df.select(*keys), grid.select(*keys), keys, "left_anti").limit(1).count():
        raise ValueError("some rows are off the date grid")
