"""Validation windows: contiguous blocks of rows or dates that are held out of training."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, DateType, IntegerType, LongType, StructField, StructType, TimestampType

from ..plans.frequency import Frequency
from ..plans.spec import LaggedFrame


@dataclass(frozen=True)
class Windows:
    """Windows as (start, stop), both included, over the column ``index``.

    ``length`` is None for windows given one by one. ``full`` is the range of the data: a window of
    length 0 over just that range trains on all rows and validates on them too.
    """

    rows: tuple[tuple[Any, Any], ...]
    length: int | None
    skip: int
    index: str
    full: tuple[Any, Any]

    def __len__(self) -> int:
        return len(self.rows)

    def trains_on_all(self, i: int) -> bool:
        return self.length == 0 and self.rows[i] == self.full

    def inside(self, i: int, kind: DataType | None = None) -> Column:
        """Whether a row lies in window ``i`` (from 0)."""
        a, b = (F.lit(x) if kind is None else F.lit(x).cast(kind) for x in self.rows[i])
        return F.col(self.index).between(a, b)

    def table(self, spark: SparkSession, kind: DataType | None = None) -> DataFrame:
        """window_number from 1, start, stop, window_length (null if the window was given as it is), is_custom."""
        first = self.rows[0][0] if self.rows else 0
        kind = kind or (TimestampType() if isinstance(first, dt.datetime) else DateType() if isinstance(first, dt.date) else LongType())
        schema = StructType([StructField("window_number", IntegerType()), StructField("start", kind), StructField("stop", kind), StructField("window_length", IntegerType())])
        df = spark.createDataFrame([(i + 1, a, b, self.length) for i, (a, b) in enumerate(self.rows)], schema)
        return df.withColumn("is_custom", F.col("window_length").isNull())


def create_windows(
    lagged: LaggedFrame,
    window_length: int = 12,
    start: Any | Sequence[Any] = None,
    stop: Any | Sequence[Any] = None,
    skip: int = 0,
    include_partial: bool = True,
) -> Windows:
    """Lay windows of ``window_length`` steps over the training data, ``skip`` steps apart.

    0 makes one window from start to stop; several starts and stops are windows of their own. Start and
    stop default to the data's first and last index, which one small aggregate finds. A window that
    would pass the end is cut there, or left out without ``include_partial``.
    """
    if lagged.kind != "train":
        raise ValueError("windows are laid over training frames")
    if not isinstance(window_length, int) or window_length < 0:
        raise ValueError("window_length has to be a whole number from 0")
    if not isinstance(skip, int) or skip < 0:
        raise ValueError("skip has to be a whole number from 0")
    starts, stops = (list(x) if isinstance(x, (list, tuple)) else [x] for x in (start, stop))
    if len(starts) != len(stops) or not starts:
        raise ValueError("give as many starts as stops")
    first, last = lagged.bounds()
    full = (first, last)
    start, stop = (starts, stops) if len(starts) > 1 else (starts[0], stops[0])
    if len(starts) > 1:
        if any(a > b for a, b in zip(start, stop)):
            raise ValueError("a window's start is after its stop")
        return Windows(tuple(zip(start, stop)), None, skip, lagged.index, full)
    a, b = first if start is None else start, last if stop is None else stop
    if a is None:
        return Windows((), window_length, skip, lagged.index, full)
    if a > b:
        raise ValueError("the windows' start is after their stop")
    if window_length == 0:
        return Windows(((a, b),), 0, skip, lagged.index, full)
    lay = _dates(a, b, window_length, skip, include_partial, lagged.spec.step) if lagged.spec.date else _rows(a, b, window_length, skip, include_partial)
    return Windows(tuple(lay), window_length, skip, lagged.index, full)


def _rows(a: int, b: int, n: int, skip: int, partial: bool) -> list[tuple[int, int]]:
    found = [(s, s + n - 1) for s in range(a, b - n + 2, n + skip)]
    rest = found[-1][1] + 1 + skip if found else a
    return [*found, (rest, b)] if partial and rest <= b else found


def _dates(a, b, n: int, skip: int, partial: bool, step: Frequency) -> list[tuple]:
    grid = step.span(a, b)
    out = []
    for i in range(0, len(grid), n + skip):
        if i + n - 1 < len(grid):
            out.append((grid[i], grid[i + n - 1]))
        elif partial:
            out.append((grid[i], b))
    return out


#: Windows up to which each is an expression of its own; more are looked up in an array that all rows share.
LITERAL_WINDOWS = 64


def expand(frame: DataFrame, windows: Windows, validation: bool) -> DataFrame:
    """Each row once for each window that it validates, or that it trains (the rows outside it).

    Tens of windows are literals, so the rows are multiplied by an array of window numbers in the same
    stage, without a join. More come as one broadcast row with an array, so that the plan does not grow with them.
    """
    kind = frame.schema[windows.index].dataType
    if len(windows) > LITERAL_WINDOWS:
        every = windows.table(frame.sparkSession, kind).agg(F.collect_list(F.struct("window_number", "start", "stop")).alias("__windows"))
        inside = lambda x: F.col(windows.index).between(x["start"], x["stop"])
        found = F.filter("__windows", inside if validation else lambda x: ~inside(x))
        rows = frame.crossJoin(F.broadcast(every))  # one row
        return rows.withColumn("window_number", F.explode(F.transform(found, lambda x: x["window_number"]))).drop("__windows")
    numbers = []
    for i in range(len(windows)):
        inside = windows.inside(i, kind)
        numbers.append(F.when(inside if validation else F.lit(True) if windows.trains_on_all(i) else ~inside, F.lit(i + 1)))
    found = F.array_compact(F.array(*numbers)) if numbers else F.array().cast("array<int>")
    return frame.withColumn("window_number", F.explode(found))
