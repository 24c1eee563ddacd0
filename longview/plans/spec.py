"""Roles of the columns of a table of series, lags of its features, and tables of lagged features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from .frequency import Frequency

#: Column with the position of a row in its series, from 1.
ROW = "row_index"


def _names(x: str | Sequence[str] | None) -> tuple[str, ...]:
    return () if x is None else (x,) if isinstance(x, str) else tuple(x)


@dataclass(frozen=True)
class SeriesSpec:
    """What the columns of a table of series mean.

    ``outcome`` is forecast; ``groups`` tell series apart and are features; ``static`` features are
    constant in a series and ``dynamic`` ones known in advance, neither is lagged; ``features`` are
    lagged besides the outcome (None: all other columns). Rows are ordered by ``date``, or by
    ``order`` in a single series without dates. ``outcome_levels`` makes the outcome a class.
    """

    outcome: str
    date: str | None = None
    frequency: str | None = None
    groups: tuple[str, ...] = ()
    static: tuple[str, ...] = ()
    dynamic: tuple[str, ...] = ()
    order: str | None = None
    features: tuple[str, ...] | None = None
    outcome_levels: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        for name in ("groups", "static", "dynamic"):
            object.__setattr__(self, name, _names(getattr(self, name)))
        if not self.outcome or not isinstance(self.outcome, str):
            raise ValueError("name one outcome column")
        if self.static and not self.groups:
            raise ValueError("static features need groups; in a single series they don't vary")
        roles = [self.outcome, *self.groups, *self.static, *self.dynamic, *filter(None, [self.date])]
        if twice := sorted({x for x in roles if roles.count(x) > 1}):
            raise ValueError(f"columns with more than one role: {', '.join(twice)}")
        if self.groups and not self.date:
            raise ValueError("grouped series need a date column")
        if not self.date and not self.order:
            raise ValueError("name a date column, or an order column in a single series without dates: a table has no row order of its own")
        if self.date and not self.frequency:
            raise ValueError("dates need a frequency, such as '1 day'")
        if self.frequency:
            Frequency.parse(self.frequency)

    @property
    def step(self) -> Frequency:
        return Frequency.parse(self.frequency)

    @property
    def sort(self) -> str:
        return self.date or self.order

    def check(self, df: DataFrame) -> None:
        if not isinstance(df, DataFrame):
            raise ValueError("the data has to be a DataFrame")
        named = [self.outcome, *self.groups, *self.static, *self.dynamic, self.sort, *(self.features or ())]
        if missing := [x for x in named if x not in df.columns]:
            raise ValueError(f"columns not in the data: {', '.join(missing)}")
        if self.date:
            self.step.check(df.schema[self.date].dataType)

    def lagged(self, df: DataFrame) -> list[str]:
        """The lagged columns, the outcome first and the others in the table's order."""
        fixed = {self.outcome, *self.groups, *self.static, *self.dynamic, self.sort, ROW}
        rest = [c for c in df.columns if c not in fixed and (self.features is None or c in self.features)]
        return [self.outcome, *rest]

    def numeric(self, df: DataFrame) -> bool:
        return self.outcome_levels is None and isinstance(df.schema[self.outcome].dataType, NumericType)


Lags = Mapping[str, tuple[int, ...]]


@dataclass(frozen=True)
class LagSpec:
    """For each model horizon, the lags of each lagged column; ``head`` is the greatest lag asked for."""

    by_horizon: Mapping[Any, Lags]
    head: int
    dropped: Mapping[Any, frozenset[str]]

    @classmethod
    def resolve(cls, columns: Sequence[str], horizons: Sequence[int], lookback: Sequence[int] | None, control: Mapping | None, method: str, roles: frozenset[str] = frozenset()) -> "LagSpec":
        """``control`` maps columns to lags, for several horizons of the direct method below each horizon;
        None drops a column and columns with a role keep it. A direct horizon uses no lag shorter than itself."""
        if (lookback is None) == (control is None):
            raise ValueError("give either lookback or lookback_control")
        keys: list[Any] = list(horizons) if method == "direct" else [tuple(horizons)]
        if lookback is not None:
            lookback = [lookback] if isinstance(lookback, int) else list(lookback)
            if not lookback or any(not isinstance(k, int) or k < 1 for k in lookback):
                raise ValueError("lookback has to be positive whole numbers")
            if method == "direct" and max(lookback) < min(horizons):
                raise ValueError("the highest lookback has to reach the shortest horizon")
            asked = {h: {c: lookback for c in columns} for h in keys}
        else:
            nested = method == "direct" and len(horizons) > 1
            asked = {h: control[h] if nested else control for h in keys} if not nested or set(control) >= set(keys) else None
            if asked is None:
                raise ValueError("with several horizons, lookback_control has an entry for each horizon")
            for per in asked.values():
                if unknown := set(per) - set(columns) - roles:
                    raise ValueError(f"lookback_control names columns that are not in the data: {', '.join(sorted(unknown))}")
                if missing := set(columns) - set(per):
                    raise ValueError(f"lookback_control has no entry for: {', '.join(sorted(missing))}")
        out, dropped = {}, {}
        for h, per in asked.items():
            dropped[h] = frozenset(c for c, ks in per.items() if ks is None)
            kept = {c: tuple(k for k in ([per[c]] if isinstance(per[c], int) else per[c]) if k > 0 and (method != "direct" or k >= h)) for c in columns if per[c] is not None}
            out[h] = {c: ks for c, ks in kept.items() if ks}
        head = max(lookback) if lookback is not None else max((k for per in out.values() for ks in per.values() for k in ks), default=0)
        return cls(out, head, dropped)


@dataclass(frozen=True)
class LaggedFrame:
    """A table of lagged features for each model horizon (direct) or one for all of them (multi_output)."""

    frames: Mapping[Any, DataFrame]
    spec: SeriesSpec
    horizons: tuple[int, ...]
    lags: LagSpec
    kind: str
    method: str
    keys: tuple[str, ...] = field(default=())
    is_skeleton: bool = False

    @property
    def targets(self) -> list[str]:
        """The columns to learn: the outcome, or one for each horizon."""
        return [self.spec.outcome] if self.method == "direct" else [f"{self.spec.outcome}_{h}" for h in self.horizons]

    @property
    def index(self) -> str:
        """The column that windows are laid over: the date, or the row's position without dates."""
        return self.spec.date or ROW

    def features(self, key: Any) -> list[str]:
        skip = {ROW, self.spec.date, self.spec.order, "index", "horizon", *self.targets}
        return [c for c in self.frames[key].columns if c not in skip]

    def bounds(self) -> tuple[Any, Any]:
        """The first and the last index of the training rows, over all frames."""
        first = next(iter(self.frames.values()))
        row = first.agg(F.min(self.index).alias("a"), F.max(self.index).alias("b")).first()
        return row["a"], row["b"]

    def skeleton(self) -> "LaggedFrame":
        """The outcomes, groups and indices alone, for model functions that fetch features themselves."""
        if self.kind != "train":
            raise ValueError("a skeleton is made from training frames")
        keep = [ROW, *filter(None, [self.spec.date]), *self.targets, *self.spec.groups]
        return replace(self, frames={h: f.select(*[c for c in keep if c in f.columns]) for h, f in self.frames.items()}, is_skeleton=True)

    def summary(self) -> DataFrame:
        """One row for each model: horizon, numbers of targets and predictors, first and last index, number of rows."""
        out = None
        for key, f in self.frames.items():
            found = f.agg(F.min(self.index).cast("string").alias("data_start"), F.max(self.index).cast("string").alias("data_stop"), F.count(F.lit(1)).alias("n_rows")) if self.kind == "train" else f.agg(F.min("index").cast("string").alias("data_start"), F.max("index").cast("string").alias("data_stop"), F.count(F.lit(1)).alias("n_rows"))
            row = found.select(F.lit(self.method).alias("method"), F.lit(", ".join(map(str, key)) if isinstance(key, tuple) else str(key)).alias("horizon"), F.lit(len(self.frames)).alias("n_models"), F.lit(len(self.targets)).alias("n_targets"), F.lit(len(self.features(key))).alias("n_predictors"), "data_start", "data_stop", "n_rows")
            out = row if out is None else out.unionByName(row)
        return out

    def describe(self) -> str:
        """The summary as text."""
        rows = self.summary().collect()
        n = [r["n_predictors"] for r in rows]
        return "\n".join([f"horizons: {', '.join(map(str, self.horizons))}", f"models: {len(rows)} ({self.method})", f"data from {rows[0]['data_start']} to {max(r['data_stop'] for r in rows)}", f"predictors: {min(n)} to {max(n)}"])
