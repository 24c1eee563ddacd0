"""Tables of lagged features for training and forecasting."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.spec import ROW, LaggedFrame, LagSpec, SeriesSpec
from .relational import BLOCK_ROWS, first_rows, halo_blocks, has_long_series, null_safe_join, union_all

Future = Callable[[DataFrame, DataFrame], DataFrame]


def create_lagged(
    df: DataFrame,
    spec: SeriesSpec,
    horizons: int | Sequence[int],
    lookback: int | Sequence[int] | None = None,
    lookback_control: Mapping | None = None,
    kind: str = "train",
    method: str = "direct",
    keep_rows: bool = False,
    predict_future: Future | None = None,
    split_series: bool | None = None,
    block_rows: int = BLOCK_ROWS,
) -> LaggedFrame:
    """Lag features by rows of their series (fill gaps first to make that lags in time).

    Training frames hold row_index, the date, the outcome, groups and features. A direct horizon H
    uses the lags of at least H; a single series loses its first max(lookback) rows unless
    ``keep_rows``. multi_output has a column ``<outcome>_<h>`` for each horizon, h rows ahead, its lag
    k is k - 1 rows back and no rows are dropped. Forecast frames hold index, horizon, groups and the
    features of the steps after the last date of all series (direct), or one row a series with joined
    indices and horizons (multi_output). Static features keep the last value of their series, dynamic
    ones are null in direct forecasts unless ``predict_future(data, dates)`` returns them by index and
    groups.

    Series are lagged by one window each, or spread over tasks in blocks of
    ``block_rows`` rows, with the rows before a block that its lags reach repeated; results are equal. By default
    training rows are counted to see whether a series is long (over four blocks); ``split_series`` says so without
    a count. A single series is always lagged in blocks. Splitting numbers the rows first, which runs two jobs.
    """
    spec.check(df)
    if kind not in ("train", "forecast"):
        raise ValueError("kind is 'train' or 'forecast'")
    if method not in ("direct", "multi_output"):
        raise ValueError("method is 'direct' or 'multi_output'")
    horizons = (horizons,) if isinstance(horizons, int) else tuple(horizons)
    if not horizons or any(not isinstance(h, int) or h < 1 for h in horizons) or len(set(horizons)) < len(horizons):
        raise ValueError("horizons have to be different positive whole numbers")
    if predict_future is not None and not spec.date:
        raise ValueError("predict_future needs a date column")
    if method == "multi_output" and spec.outcome_levels:
        raise ValueError("multi_output needs a numeric outcome")
    roles = frozenset({*spec.groups, *spec.static, *spec.dynamic})
    lags = LagSpec.resolve(spec.lagged(df), horizons, lookback, lookback_control, method, roles)
    make = _train if kind == "train" else _forecast
    if split_series is None and spec.groups and kind == "train":
        split_series = has_long_series(df, list(spec.groups), block_rows)
    frames = make(df, spec, horizons, lags, method, keep_rows, predict_future, split_series or not spec.groups, block_rows)
    return LaggedFrame(frames, spec, horizons, lags, kind, method)


def _lag(c: str, k: int, method: str, w) -> Column:
    return F.lag(F.col(c), k if method == "direct" else k - 1).over(w).alias(f"{c}_lag_{k}")


def _kept(df: DataFrame, spec: SeriesSpec, per: Mapping[str, tuple[int, ...]], dropped: frozenset[str]) -> list[tuple[str, tuple[int, ...] | None]]:
    """Feature columns in the table's order, the outcome's lags first: (column, lags), None for one that is not lagged."""
    out = [(spec.outcome, per[spec.outcome])] if spec.outcome in per else []
    for c in df.columns:
        if c in spec.static or c in spec.dynamic:
            if c not in dropped:
                out.append((c, None))
        elif c in per and c != spec.outcome:
            out.append((c, per[c]))
    return out


def _train(df, spec, horizons, lags, method, keep_rows, predict_future, split, block_rows) -> dict[Any, DataFrame]:
    groups, ahead = list(spec.groups), max(horizons) if method == "multi_output" else 0
    reach = max((k for per in lags.by_horizon.values() for ks in per.values() for k in ks), default=0)
    if split:
        base, w = halo_blocks(df, [spec.sort], groups, reach, ahead, ROW, block_rows)
        own = [F.col("__own")]
    else:
        w = Window.partitionBy(*groups).orderBy(F.col(spec.sort).asc_nulls_last())
        base, own = df.withColumn(ROW, F.row_number().over(w).cast("long")), []
    frames = {}
    for key, per in lags.by_horizon.items():
        if method == "direct":
            targets = [F.col(spec.outcome)]
        else:
            targets = [F.lead(F.col(spec.outcome), h).over(w).alias(f"{spec.outcome}_{h}") for h in horizons]
        features = [x for c, ks in _kept(df, spec, per, lags.dropped[key]) for x in ([F.col(c)] if ks is None else [_lag(c, k, method, w) for k in ks])]
        f = base.select(ROW, *filter(None, [spec.date]), *targets, *groups, *features, *own)
        f = f.filter("__own").drop("__own") if split else f
        if method == "direct" and not groups and not keep_rows and lags.head:
            f = f.filter(F.col(ROW) > lags.head)
        frames[key] = f
    return frames


def _tail(df: DataFrame, spec: SeriesSpec, n: int) -> DataFrame:
    """The last ``n`` rows of each series: all that a forecast's lags can reach."""
    return first_rows(df, spec.groups, [F.col(spec.sort).desc_nulls_first()], max(n, 1))


def _forecast(df, spec, horizons, lags, method, keep_rows, predict_future, split, block_rows) -> dict[Any, DataFrame]:
    groups = list(spec.groups)
    reach = max((k for per in lags.by_horizon.values() for ks in per.values() for k in ks), default=0)
    tail = _tail(df, spec, reach)
    w = Window.partitionBy(*groups, *([] if groups else ["__one"])).orderBy("__future", F.col("__pos"))
    kind = df.schema[spec.date].dataType if spec.date else None
    last = df.agg(F.max(spec.date).alias("__last")) if spec.date else df.agg(F.count(F.lit(1)).alias("__last"))
    one = F.lit(1).alias("__one")
    past_w = Window.partitionBy(*groups, *([] if groups else ["__one"])).orderBy(F.col(spec.sort).asc_nulls_last())
    past = tail.withColumn("__one", F.lit(1)).withColumn("__pos", F.row_number().over(past_w)).withColumn("__future", F.lit(0))
    frames = {}

    def index(h: Column) -> Column:
        return spec.step.after(F.col("__last"), h, kind) if spec.date else F.col("__last") + h

    for key, per in lags.by_horizon.items():
        cols = _kept(df, spec, per, lags.dropped[key])
        if method == "direct":
            steps = df.sparkSession.range(1, key + 1).select(F.col("id").cast("int").alias("__pos"))
            if groups:
                fixed = [F.max_by(F.struct(F.col(c)), F.col(spec.date)).getField(c).alias(c) for c in spec.static]
                series = df.groupBy(*groups).agg(*(fixed or [F.lit(1).alias("__any")])).drop("__any")
            else:
                series = df.sparkSession.range(1).select().limit(1)
            future = series.crossJoin(F.broadcast(steps)).withColumns({"__future": F.lit(1), "__one": F.lit(1)})
            both = union_all([past.drop(*spec.static), future]) if not spec.static else union_all([past.select(*[c for c in past.columns if c not in spec.static], *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in spec.static]), future])
            features = []
            for c, ks in cols:
                if ks is None:
                    features.append(F.col(c) if c in spec.static else F.lit(None).cast(df.schema[c].dataType).alias(c))
                else:
                    features += [_lag(c, k, method, w) for k in ks]
            f = both.select("__future", F.col("__pos").cast("int").alias("horizon"), *groups, *features).filter("__future = 1").drop("__future")
            f = f.crossJoin(F.broadcast(last)).withColumn("index", index(F.col("horizon")))
            if predict_future is not None:
                f = _future(f, df, spec, predict_future, key)
            f = f.select("index", "horizon", *[c for c in f.columns if c not in ("index", "horizon", "__last")])
        else:
            features = [x for c, ks in cols for x in ([F.col(c)] if ks is None else [_lag(c, k, method, past_w) for k in ks])]
            newest = F.row_number().over(past_w).alias("__rn")
            f = past.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*groups, *([] if groups else ["__one"]))))
            f = f.select(newest, "__n", *groups, *features).filter("__rn = __n").drop("__rn", "__n")
            text = F.array_join(F.array(*[index(F.lit(h)).cast("string") for h in horizons]), ", ")
            f = f.crossJoin(F.broadcast(last)).select(text.alias("index"), F.lit(", ".join(map(str, horizons))).alias("horizon"), *f.columns)
        frames[key] = f
    return frames


def _future(f: DataFrame, df: DataFrame, spec: SeriesSpec, predict_future: Future, horizon: int) -> DataFrame:
    """Overwrite features with those that ``predict_future`` returns by index (and groups)."""
    new = predict_future(df, f.select("index").distinct())
    on = ["index", *[g for g in spec.groups if g in new.columns]]
    if "index" not in new.columns:
        raise ValueError("predict_future has to return a column named index")
    over = [c for c in new.columns if c not in on]
    order = f.columns
    return null_safe_join(f.drop(*over), new.select(*on, *over), on).select(*order, *[c for c in over if c not in order])
