"""Time steps such as "1 day" or "3 months": parsing, adding and gridding."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

#: Spellings of the units, and what each is in months or seconds.
_UNITS = {"sec": ("second", 0, 1), "min": ("minute", 0, 60), "hour": ("hour", 0, 3600), "day": ("day", 0, 86400), "week": ("week", 0, 604800), "month": ("month", 1, 0), "quarter": ("quarter", 3, 0), "year": ("year", 12, 0)}
_FORM = re.compile(r"^\s*(?:(\d+)\s+)?(secs?|seconds?|mins?|minutes?|hours?|days?|weeks?|months?|quarters?|years?)\s*$")


@dataclass(frozen=True)
class Frequency:
    """A step of ``months`` calendar months or of ``seconds`` seconds; one of the two is 0.

    Month steps count from their origin and clamp to the last day of a month (31 January, 29 February,
    31 March), as Spark's ``sequence`` does.
    """

    text: str
    months: int
    seconds: int

    @classmethod
    def parse(cls, text: str | "Frequency") -> "Frequency":
        if isinstance(text, Frequency):
            return text
        found = _FORM.match(text) if isinstance(text, str) else None
        if not found or int(found[1] or 1) == 0:
            raise ValueError(f"a frequency is a unit (second, minute, hour, day, week, month, quarter, year) with an optional count before it, such as '3 months'; got {text!r}")
        n = int(found[1] or 1)
        name, months, seconds = next(v for k, v in _UNITS.items() if found[2].startswith(k))
        return cls(f"{n} {name}", n * months, n * seconds)

    @property
    def whole_days(self) -> bool:
        return bool(self.months) or self.seconds % 86400 == 0

    def interval(self) -> str:
        """The step as a SQL interval."""
        if self.months:
            return f"INTERVAL {self.months} MONTH"
        return f"INTERVAL {self.seconds // 86400} DAY" if self.whole_days else f"INTERVAL {self.seconds} SECOND"

    def after(self, origin: Column, steps: Column | int, kind: DataType) -> Column:
        """``origin`` plus ``steps`` steps, in ``origin``'s type."""
        steps = F.lit(steps) if isinstance(steps, int) else steps
        if isinstance(kind, DateType):
            if self.months:
                return F.add_months(origin, (steps * F.lit(self.months)).cast("int"))
            self.check(kind)
            return F.date_add(origin, (steps * F.lit(self.seconds // 86400)).cast("int"))
        unit, size = ("MONTH", self.months) if self.months else ("SECOND", self.seconds)
        return F.timestamp_add(unit, steps * F.lit(size), origin)

    def grid(self, start: Column, stop: Column) -> Column:
        """The array of steps from ``start`` to ``stop``; empty where start is after stop, null where either is null."""
        step = F.expr(self.interval())
        return F.when(start <= stop, F.sequence(start, stop, step)).when(start > stop, F.filter(F.array(start), lambda _: F.lit(False)))

    def check(self, kind: DataType) -> None:
        if isinstance(kind, DateType) and not self.whole_days:
            raise ValueError(f"a DATE column can't step by '{self.text}'; make it a TIMESTAMP")
        if not isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            raise ValueError(f"the date column has type {kind.simpleString()}; it has to be a date or a timestamp")

    def plus(self, origin: dt.date, steps: int):
        """The same as ``after``, for a Python date or datetime."""
        if not self.months:
            return origin + dt.timedelta(seconds=self.seconds * steps)
        month = origin.year * 12 + origin.month - 1 + self.months * steps
        year, month = divmod(month, 12)
        return origin.replace(year=year, month=month + 1, day=min(origin.day, calendar.monthrange(year, month + 1)[1]))

    def span(self, start: dt.date, stop: dt.date) -> list:
        """The grid from ``start`` to ``stop`` as a Python list."""
        out, i = [], 0
        while (x := self.plus(start, i)) <= stop:
            out.append(x)
            i += 1
        return out

    @property
    def days(self) -> float:
        """Length in days, a month as a twelfth of 365.25: only for ordering frequencies."""
        return self.months * 365.25 / 12 + self.seconds / 86400
