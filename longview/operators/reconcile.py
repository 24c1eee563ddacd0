"""Making forecasts of a hierarchy add up, by weighted least squares with structural weights.

Every series' forecast is taken to vary as the number of bottom series below it. In a tree the solution
is two sweeps: upwards each node merges its own forecast with the sum of its children, downwards each
shares what its parent was moved by in proportion to its children's variances. So a nested hierarchy of
any number of series is reconciled by joins and sums, one level at a time. Hierarchies that cross are
solved densely, a date at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType, DoubleType, StructField, StructType, TimestampType

from ..plans.frequency import Frequency
from ..session import ship
from .relational import null_safe_join, union_all


def solve(s: np.ndarray, f: np.ndarray) -> np.ndarray:
    """S (S' W^-1 S)^-1 S' W^-1 f, where W has the row sums of S."""
    w = s.sum(axis=1)
    left = s.T / w
    return s @ np.linalg.solve(left @ s, left @ f)


# --- groups
def reconcile_groups(forecasts: Mapping[str, DataFrame], frequency: str, index: str, outcome: str, keys: Sequence[str] | None = None, dense: bool = False) -> dict[str, DataFrame]:
    """Reconcile levels of a grouped hierarchy at each date; a level's keys are the key columns that it has.

    The result has the levels from the total to the bottom. Series of a level with keys are filled with 0
    at the dates that they lack, from the first to the last date of all levels; a level without keys is
    taken as it is, and a date that it lacks is reconciled without it. Where each level's keys contain
    those of the level above, tables are swept without being gathered; others (or all, with ``dense``) are
    solved by one worker a date, which holds the square of the number of bottom series.
    """
    if len(forecasts) < 2:
        raise ValueError("a hierarchy has two levels or more")
    names = {c for df in forecasts.values() for c in df.columns if c not in (index, outcome)}
    keys = sorted(names) if keys is None else list(keys)
    if not keys or not names & set(keys):
        raise ValueError("grouped forecasts need a key column at one level at least")
    for name, df in forecasts.items():
        if index not in df.columns or outcome not in df.columns:
            raise ValueError(f"level {name} lacks {index} or {outcome}")
    own = {n: [k for k in keys if k in df.columns] for n, df in forecasts.items()}
    order = sorted(forecasts, key=lambda n: len(own[n]))
    sets = [frozenset(own[n]) for n in order]
    if len(set(sets)) < len(sets):
        raise ValueError("two levels have the same keys")
    if not all(x <= sets[-1] for x in sets):
        raise ValueError("the lowest level has to have the keys of all levels")
    filled = _filled({n: forecasts[n].select(index, *own[n], F.col(outcome).cast("double").alias(outcome)) for n in order}, own, Frequency.parse(frequency), index, outcome)
    nested = all(a < b for a, b in zip(sets, sets[1:]))
    found = _sweep(filled, order, own, index, outcome) if nested and not dense else _dense(filled, order, own, index, outcome)
    return {n: found[n].select(*forecasts[n].select(index, *own[n], outcome).columns) for n in order}


def _filled(levels: Mapping[str, DataFrame], own, step: Frequency, index: str, outcome: str) -> dict[str, DataFrame]:
    kind = next(iter(levels.values())).schema[index].dataType
    step.check(kind)
    ends = union_all([df.agg(F.min(index).alias("a"), F.max(index).alias("b")) for df in levels.values()]).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    dates = ends.select(F.explode(step.grid(F.col("a"), F.col("b"))).alias(index))
    out = {}
    for n, df in levels.items():
        if own[n]:
            grid = df.select(*own[n]).distinct().crossJoin(F.broadcast(dates))
            df = null_safe_join(grid, df, [index, *own[n]]).withColumn(outcome, F.coalesce(outcome, F.lit(0.0)))
        out[n] = df
    return out


def _sweep(levels: Mapping[str, DataFrame], order, own, index: str, outcome: str) -> dict[str, DataFrame]:
    bottom = order[-1]
    up = {bottom: levels[bottom].select(index, *own[bottom], F.col(outcome).alias("m"), F.lit(1.0).alias("v"), F.lit(1).cast("long").alias("n"))}
    for lower, upper in reversed(list(zip(order[1:], order))):
        k = [index, *own[upper]]
        below = up[lower].groupBy(*k).agg(F.sum("m").alias("sum_m"), F.sum("v").alias("sum_v"), F.sum("n").alias("n"))
        # A node without a forecast of its own has what its children add up to.
        both = null_safe_join(below, levels[upper].select(*k, F.col(outcome).alias("f")), k)
        v = F.when(F.col("f").isNull(), F.col("sum_v")).otherwise(F.col("sum_v") * F.col("n") / (F.col("sum_v") + F.col("n")))
        m = F.when(F.col("f").isNull(), F.col("sum_m")).otherwise((F.col("sum_m") * F.col("n") + F.col("f") * F.col("sum_v")) / (F.col("sum_v") + F.col("n")))
        up[upper] = both.select(*k, m.alias("m"), v.alias("v"), "n", "sum_m", "sum_v", F.col("f").isNotNull().alias("given"))
    top = order[0]
    down = {top: up[top].withColumn("s", F.col("m"))}
    for upper, lower in zip(order, order[1:]):
        k = [index, *own[upper]]
        move = down[upper].select(*k, ((F.col("s") - F.col("sum_m")) / F.col("sum_v")).alias("move"))
        down[lower] = null_safe_join(up[lower], move, k, "inner").withColumn("s", F.col("m") + F.col("v") * F.col("move"))
    return {n: (down[n].filter("given") if "given" in down[n].columns else down[n]).select(index, *own[n], F.col("s").alias(outcome)) for n in order}


def _dense(levels: Mapping[str, DataFrame], order, own, index: str, outcome: str) -> dict[str, DataFrame]:
    spark = levels[order[0]].sparkSession
    ship(spark)
    keys = own[order[-1]]
    stacked = union_all([levels[n].withColumn("__level", F.lit(i)) for i, n in enumerate(order)])
    stacked = stacked.select(index, "__level", *keys, outcome)
    level_keys, last = [own[n] for n in order], len(order) - 1

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__level", *keys], kind="stable").reset_index(drop=True)
        bottom = pdf[pdf["__level"] == last].reset_index(drop=True)
        rows = np.zeros((len(pdf), len(bottom)))
        for i, own_keys in enumerate(level_keys):
            at = np.flatnonzero(pdf["__level"] == i)
            if not len(at):
                continue
            if not own_keys:
                rows[at] = 1
                continue
            label = lambda d: list(map(tuple, d[own_keys].astype(object).where(d[own_keys].notna(), None).to_numpy()))
            place = {k: j for j, k in enumerate(label(pdf.loc[at]))}
            for column, k in enumerate(label(bottom)):
                if k in place:
                    rows[at[place[k]], column] = 1
        use = rows.sum(axis=1) > 0
        if len(bottom):
            pdf.loc[use, outcome] = solve(rows[use], pdf.loc[use, outcome].to_numpy(dtype=float))
        return pdf

    done = stacked.groupBy(index).applyInPandas(one, stacked.schema)
    return {n: done.filter(F.col("__level") == i).select(index, *own[n], outcome) for i, n in enumerate(order)}


# --- time
def reconcile_temporal(forecasts: Sequence[DataFrame], frequencies: Sequence[str], index: str, outcome: str, keys: Sequence[str] = (), keep_all: bool = True, keep_non_reconciled: bool = False) -> dict[str, DataFrame] | DataFrame:
    """Reconcile forecasts of the same series at several frequencies, each series (``keys``) by itself.

    A step of the highest frequency belongs to the longer period that its start lies in. Forecasts outside
    the lowest frequency's periods are left out, or returned as they were. The highest frequency has to
    have a forecast for each of its steps in these periods, and every period in the middle the steps below
    it; else the job fails. The result maps frequencies, highest first, to tables; without ``keep_all`` it
    is the first of them. A forecast's horizon is short, so one worker solves a series.
    """
    if len(forecasts) < 2 or len(forecasts) != len(frequencies):
        raise ValueError("give two forecasts or more, with a frequency each")
    for df in forecasts:
        if missing := {index, outcome, *keys} - set(df.columns):
            raise ValueError(f"columns not in a forecast: {', '.join(sorted(missing))}")
    steps = [Frequency.parse(f) for f in frequencies]
    if len({s.days for s in steps}) < len(steps):
        raise ValueError("two forecasts have the same frequency")
    order = sorted(range(len(steps)), key=lambda i: steps[i].days)
    dates = all(isinstance(df.schema[index].dataType, DateType) for df in forecasts)
    kind = DateType() if dates else TimestampType()
    for i in order:
        steps[i].check(kind)
    ship(forecasts[0].sparkSession)
    stacked = union_all([forecasts[i].select(*keys, F.col(index).cast(kind).alias(index), F.col(outcome).cast("double").alias(outcome), F.lit(j).alias("__level"), steps[i].after(F.col(index).cast(kind), 1, kind).alias("__stop")) for j, i in enumerate(order)])
    schema = StructType([*stacked.schema.fields[: len(keys)], StructField(index, kind), StructField(outcome, DoubleType()), *[f for f in stacked.schema.fields if f.name == "__level"]])
    names, last, first_name = [frequencies[i] for i in order], len(order) - 1, frequencies[order[0]]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__level", index], kind="stable").reset_index(drop=True)
        start, stop, level = pd.to_datetime(pdf[index]).to_numpy(), pd.to_datetime(pdf["__stop"]).to_numpy(), pdf["__level"].to_numpy()
        low = level == last
        inside = (start >= start[low].min()) & (start < stop[low].max()) if low.any() else np.zeros(len(pdf), bool)
        leaf = np.flatnonzero(inside & (level == 0))
        if low.any():
            # Leaves follow one another and cover the periods; else steps are missing.
            whole = len(leaf) and start[leaf[0]] < start[low].min() + (stop[leaf[0]] - start[leaf[0]]) and stop[leaf[-1]] >= stop[low].max() and (start[leaf[1:]] == stop[leaf[:-1]]).all()
            if not whole:
                raise ValueError(f"the '{first_name}' forecast has missing steps between {start[low].min()} and {stop[low].max()}")
        rows = np.flatnonzero(inside)
        s = ((start[leaf][None, :] >= start[rows][:, None]) & (start[leaf][None, :] < stop[rows][:, None])).astype(float)
        if (s.sum(axis=1) == 0).any():
            raise ValueError("a period has no steps of the highest frequency")
        if len(rows):
            pdf.loc[rows, outcome] = solve(s, pdf.loc[rows, outcome].to_numpy(dtype=float))
        if not keep_non_reconciled:
            pdf = pdf[inside]
        return pdf[[f.name for f in schema.fields]]

    done = stacked.withColumn("__all", F.lit(0)).groupBy(*(keys or ["__all"])).applyInPandas(one, schema)
    out = {names[j]: done.filter(F.col("__level") == j).select(*keys, F.col(index).cast(forecasts[i].schema[index].dataType).alias(index), outcome) for j, i in enumerate(order)}
    return out if keep_all else out[first_name]
