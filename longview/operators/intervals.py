"""Bootstrap prediction intervals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import picks
from ..session import settle
from .models import Results
from .relational import null_safe_join, number_rows


def intervals(
    forecasts: Results | DataFrame,
    residuals: DataFrame,
    levels: Sequence[float] = (0.95,),
    times: int = 100,
    seed: int = 0,
    keep_samples: bool = False,
    index: str | None = None,
    outcome: str | None = None,
    keys: Sequence[str] | None = None,
    pick: str = "hashed",
    max_packed: int = 100_000,
):
    """Quantiles of ``times`` sums of a prediction and a residual picked at random from those of its keys.

    Keys of results are the model (unless it is an ensemble), groups and model horizon. For other tables
    name ``index``, the column ``outcome`` to bound and the keys. Bounds of level .95 are
    ``<outcome>_pred_lower_95`` and ``_upper_95``; lower bounds come first, wide before narrow, then upper
    ones, narrow before wide. With ``keep_samples`` the sums are returned too. Null residuals are never
    picked; a forecast that is null or has no residuals has null bounds.

    The residuals of a key go as one sorted array to its forecasts, which pick from it and take quantiles in
    place, so that only forecasts are shuffled. Where a key has more than ``max_packed`` residuals (they are counted) they are
    numbered within their keys by a distributed sort instead and joined to the picks by number; the result is the same, and
    a key may have any share of them. A pick depends on its keys, index, sample number and ``seed`` alone: "hashed" hashes them;
    "linear" is a linear rule over the horizon for checks in SQL.
    """
    levels = sorted(levels)
    if not levels or any(not 0 < x < 1 for x in levels):
        raise ValueError("levels lie between 0 and 1")
    if times < 1:
        raise ValueError("times has to be 1 or more")
    if isinstance(forecasts, Results):
        if forecasts.spec.outcome_levels is not None:
            raise ValueError("classes have no bootstrap intervals")
        df, index, outcome = forecasts.df, "forecast_period", forecasts.pred
        base = outcome
        if keys is None:
            keys = [*([] if forecasts.models == ("Ensemble",) else ["model"]), *forecasts.spec.groups, forecasts.horizon]
    else:
        df, base = forecasts, f"{outcome}_pred"
        if not index or not outcome:
            raise ValueError("name the index and outcome columns")
    if pick not in ("hashed", "linear"):
        raise ValueError("pick is 'hashed' or 'linear'")
    keys = list(keys or ())
    values = [c for c in residuals.columns if c not in (*keys, index, outcome, "index", "model")]
    if len(values) != 1:
        raise ValueError("residuals have the keys and one column of residuals")
    pool = residuals.select(*keys, F.col(values[0]).cast("double").alias("__e")).filter("__e IS NOT NULL AND NOT isnan(__e)")
    # Everything that tells a forecast's rows apart takes part in the pick.
    own = [c for c in dict.fromkeys([*keys, index, "horizon"]) if c in df.columns]

    def number(m: Column, t: Column) -> Column:
        return picks.linear(seed, m, F.col("horizon"), t) if pick == "linear" else picks.hashed(seed, m, *[F.col(c).cast("string") for c in own], t)

    points = sorted({0.5 - x / 2 for x in levels} | {0.5 + x / 2 for x in levels})
    pool = settle(pool, "residuals")
    most = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    with_quantiles = _in_rows if most <= max_packed else _by_number
    samples, out = with_quantiles(df, pool, keys, own, outcome, times, number, points)
    text = [f"{x * 100:g}" for x in levels]
    names = [f"{base}_lower_{t}" for t in reversed(text)] + [f"{base}_upper_{t}" for t in text]
    out = out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    out = replace(forecasts, df=out) if isinstance(forecasts, Results) else out
    return (out, samples) if keep_samples else out


def _in_rows(df: DataFrame, pool: DataFrame, keys, own, outcome: str, times: int, number, points) -> tuple[DataFrame, DataFrame]:
    """(samples, ``df`` with quantiles of them) with each key's residuals beside its forecasts."""
    packed = pool.groupBy(*keys).agg(F.sort_array(F.collect_list("__e")).alias("__pool"))
    both = null_safe_join(df, packed, keys) if keys else df.crossJoin(packed)
    m = F.size("__pool").cast("long")
    drawn = F.transform(F.sequence(F.lit(1), F.lit(times)), lambda t: F.col(outcome) + F.get("__pool", (number(m, t) - 1).cast("int")))
    both = both.withColumn("__drawn", F.when(m > 0, drawn))
    samples = both.select(*own, F.posexplode("__drawn").alias("__t", outcome)).select(*own, (F.col("__t") + 1).alias("sample"), outcome)
    ranked = both.withColumn("__drawn", F.sort_array(F.filter("__drawn", lambda x: x.isNotNull())))

    def at(p: float) -> Column:
        place = (F.size("__drawn") - 1) * F.lit(float(p))
        low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
        a, b = F.get("__drawn", low), F.get("__drawn", high)
        return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)

    return samples, ranked.withColumn("__q", F.array(*[at(p) for p in points]))


def _by_number(df: DataFrame, pool: DataFrame, keys, own, outcome: str, times: int, number, points) -> tuple[DataFrame, DataFrame]:
    """The same with residuals joined to picks by their number within the key."""
    pool = number_rows(pool, ["__e"], "__rn", keys)
    sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    sized = null_safe_join(df, sizes, keys, "inner") if keys else df.crossJoin(F.broadcast(sizes)).filter("__m > 0")
    drawn = sized.withColumn("__t", F.explode(F.sequence(F.lit(1), F.lit(times))))
    drawn = drawn.select(*own, outcome, "__t", number(F.col("__m"), F.col("__t")).alias("__rn"))
    drawn = null_safe_join(drawn, pool, [*keys, "__rn"], "inner")
    samples = drawn.select(*own, F.col("__t").alias("sample"), (F.col(outcome) + F.col("__e")).alias(outcome))
    return samples, null_safe_join(df, samples.groupBy(*own).agg(F.percentile(outcome, F.array(*[F.lit(float(p)) for p in points])).alias("__q")), own)
